"""BPE and packing against the tokenizers library and plain checks."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from custseg.llm import bpe, packing
from custseg.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")

ALPHABET = ("ab the ing  \n\t'sdrelmv 019.,!?éüßÑ\xa0 　\x1c\x85​日本語🎉aaaá٠Ⅷ½_"
            "ΣσςİıœŒﬁµ")


def random_texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        x = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30)))
        if rnd.random() < 0.15:
            x = x[:5] + rnd.choice(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]) + x[5:]
        out.append(x)
    return out + ["", " ", "  ", "a" * 5_000, "ab" * 3_000 + " ", " \n" * 500 + "x"]


@pytest.fixture(scope="module")
def byte_tokenizer():
    return tokenizers.Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_tokenizer():
    return tokenizers.Tokenizer.from_file(WORD)


def test_byte_bpe_equals_the_library(byte_tokenizer):
    v = bpe.vocabulary(BYTE)
    for text in random_texts(3_000, 1):
        ids = byte_tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(v.encode(text), "<u4").tolist() == ids, text
        assert v.decode(v.encode(text)) == byte_tokenizer.decode(ids, skip_special_tokens=False)


def test_every_code_point(byte_tokenizer):
    v = bpe.vocabulary(BYTE)
    for c in [*range(0x20, 0x3000), 0x1F600, 0x20000, 0xE0001]:
        text = f"a{chr(c)}1{chr(c)} {chr(c)}"
        assert (np.frombuffer(v.encode(text), "<u4").tolist()
                == byte_tokenizer.encode(text, add_special_tokens=False).ids), hex(c)


def test_invalid_bytes_decode_as_the_library_does(byte_tokenizer):
    v, rnd = bpe.vocabulary(BYTE), random.Random(3)
    for _ in range(500):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 6))]
        assert v.decode(np.array(ids, "<u4").tobytes()) == byte_tokenizer.decode(
            ids, skip_special_tokens=False)


def test_small_caches_change_nothing(monkeypatch, byte_tokenizer):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    v = bpe.Vocabulary(BYTE)
    for text in random_texts(200, 5):
        assert (np.frombuffer(v.encode(text), "<u4").tolist()
                == byte_tokenizer.encode(text, add_special_tokens=False).ids)


def test_digests_and_round_trip(docs_of, byte_tokenizer):
    texts = random_texts(60, 2) + [None]
    docs = docs_of([*enumerate(texts), (0, texts[0]), (None, "x")])
    rows = bpe.digests(docs, BYTE).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "x" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = byte_tokenizer.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(byte_tokenizer.decode(
            ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert all(r["text"] == ("x" if r["doc_id"] is None else texts[r["doc_id"]] or "")
               for r in back)
    assert bpe.digests(docs_of([]), BYTE).count() == 0


def test_word_tokenizer_equals_the_library(word_tokenizer):
    t = packing.tokenizer(WORD)
    for text in random_texts(3_000, 4):
        ids = word_tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(t.encode(text), "<u4").tolist() == ids, text


def test_latin_chunks_equal_the_library(word_tokenizer):
    t, rnd = packing.WordTokenizer(WORD), random.Random(8)
    letters = [*map(chr, range(0x250)), *" İıſ<|'" * 10]
    for _ in range(5_000):
        text = "".join(rnd.choice(letters) if rnd.random() < 0.6 else rnd.choice("abXY09'.-")
                       for _ in range(rnd.randint(1, 8)))
        ids = word_tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(t.encode(text), "<u4").tolist() == ids, text


def test_plain_words_go_straight_to_the_model(monkeypatch, word_tokenizer):
    """Words not seen before are most of the operator's time: letters need no pattern or NumPy."""
    t = packing.WordTokenizer(WORD)
    monkeypatch.setattr(packing, "_WORDS", None)
    monkeypatch.setattr(packing, "np", None)
    text = "Plain Words éTÉ Straße ſo"
    assert t.encode(text) == b"".join(
        i.to_bytes(4, "little") for i in word_tokenizer.encode(text, add_special_tokens=False).ids)


def check_packing(rows, texts, word_tokenizer, limit):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, text in texts.items():
        ids = word_tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // limit)))
        for r in own:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["start"] == r["piece"] * limit and len(part) == r["length"] <= limit
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert all(r["length"] == limit for r in own[:-1])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit


def test_packing(docs_of, word_tokenizer):
    rnd = random.Random(9)
    texts = {i: " ".join(rnd.choice(["word", "Thing", "a", "ü.", "zzzz"])
                         for _ in range(rnd.randint(0, 90))) for i in range(300)}
    texts |= {300: None, 301: "", 302: "many words " * 3_000}
    rows = packing.pack_documents(docs_of([*texts.items()]), WORD, max_tokens=64).collect()
    check_packing(rows, texts, word_tokenizer, 64)
    used = len({r["sequence_id"] for r in rows})
    bound = -(-sum(r["length"] for r in rows) // 64)
    assert bound <= used <= bound * 1.02 + 2


def test_packing_over_several_tasks(docs_of, word_tokenizer):
    texts = {i: "a b c " * (i % 17) for i in range(500)}
    rows = packing.pack_documents(docs_of([*texts.items()]), WORD, max_tokens=64,
                                  pieces_per_task=100).collect()
    check_packing(rows, texts, word_tokenizer, 64)
    assert len({r["sequence_id"] >> 40 for r in rows}) == 5
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 64) + 10


def test_packing_repeated_rows_and_empty_table(docs_of):
    rows = packing.pack_documents(docs_of([(1, "a b"), (1, "a b"), (None, None)]), WORD).collect()
    assert len(rows) == 3 and sum(r["length"] for r in rows) == 7
    assert len({r["sequence_id"] for r in rows}) == 1
    assert sorted(r["offset"] for r in rows) == [0, 3, 6]
    assert packing.pack_documents(docs_of([]), WORD).count() == 0


def test_sum_of_squares_choice():
    """Each placement makes the sum of squares as small as any open sequence allows."""
    rnd, state = random.Random(1), packing.OpenSequences(20)
    fill = {}
    for _ in range(500):
        size = rnd.randint(1, 20)
        before = state.count.copy()
        sequence, offset = state.place(size)
        assert fill.get(sequence, 0) == offset
        fill[sequence] = offset + size
        gap = 20 - offset
        options = [g for g in range(size, 20) if before[g] > 0]
        assert (gap in options) if options else gap == 20

        def squares(g):
            n = before.copy()
            if g < 20:
                n[g] -= 1
            if g > size:
                n[g - size] += 1
            return int((n[1:20] ** 2).sum())

        if options:
            assert squares(gap) == min(map(squares, options))
