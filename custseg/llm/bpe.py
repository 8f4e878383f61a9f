"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one vocabulary token can end the prefix's BPE encoding. An
automaton over the vocabulary reports, position by position, all tokens that are suffixes of the
prefix (longest first); a token is the last one iff it is compatible with the last token of what
stands before it, that is iff no merge across their border would have happened. Following the
stored last tokens backwards from the end of the word gives the ids. Time is linear in the word
for a bounded token length, so a single word of millions of characters is no special case.

Two tokens a, b are compatible iff the merges that build a and b never meet a merge across the
border: on a's right spine and b's left spine each part lives from the rank that made it to the
rank that consumed it, and an applicable cross merge must fall into both lifetimes (at equal rank
the leftmost merge goes first).

Words come from the vocabulary's own splitting pattern; special tokens are cut out before. Each
text is encoded in the task that reads it, with bounded caches for frequent pieces; there is no
shuffle. Defined results: a null or empty text has no tokens; repeated rows give repeated result
rows; a very long text is encoded whole, an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from custseg.llm.common import map_batches, texts

# The splitting pattern of the byte-level vocabularies, white space spelled out.
_WHITE = r"\t-\r \x85\xa0  -     　"
_PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")

CACHE_ENTRIES = 500_000
CACHE_CHARS = 48
_END = 1 << 30


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary file: printable bytes stand for
    themselves, the others take the code points from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(extra)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizer JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        self.map = {b: x for b, x in enumerate(letters)}
        back = {x: b for b, x in enumerate(letters)}
        ids = data["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {
            i: bytes(back[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.special_split = (regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special else None)

        if max(ids.values()) >= 1 << 20:
            raise ValueError("ids of 2**20 and more are not supported")
        self.rank: dict[int, int] = {}                # key of a pair: a << 20 | b
        self._spines: tuple[dict, dict] = {}, {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(data["model"]["merges"]):
            self.rank[ids[a] << 20 | ids[b]] = r
            parts.setdefault(ids[a + b], (ids[a], ids[b], r))
        for pair, r in self.rank.items():
            if any(parts.get(x, (0, 0, -1))[2] > r for x in (pair >> 20, pair & 0xFFFFF)):
                raise ValueError("a merge comes before the merge that makes one of its parts")
        self.parts = parts
        self._compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}
        alive: set[int] = set()
        for token, i in sorted(ids.items(), key=lambda x: parts.get(x[1], (0, 0, -1))[2]):
            made = parts.get(i)
            # a token that its own bytes don't encode to can never come out
            if made is None or (made[0] in alive and made[1] in alive
                                and self._first_cross(made[0], made[1]) == made[2]):
                self.whole[token] = i
                alive.add(i)
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        missing = [x for x in letters if x not in self.whole]
        if missing:
            raise ValueError("the vocabulary lacks single bytes")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank that consumes it) down one side of a token, the byte first."""
        known = self._spines[side].get(token)
        if known is not None:
            return known
        out, part, death = [], token, _END
        while True:
            out.append((part, death))
            made = self.parts.get(part)
            if made is None:
                break
            part, death = made[side], made[2]
        self._spines[side][token] = out[::-1]
        return out[::-1]

    def _first_cross(self, a: int, b: int) -> int:
        """Rank of the first merge across the border of a and b, ``_END`` if there is none."""
        right, left = iter(self._spine(a, 1)), iter(self._spine(b, 0))
        rank = self.rank.get
        x, x_dies = next(right)
        y, y_dies = next(left)
        while True:
            r = rank(x << 20 | y, _END)
            if r < x_dies and r <= y_dies:
                return r
            if x_dies <= y_dies:
                if x_dies == _END:
                    return _END
                x, x_dies = next(right)
            else:
                y, y_dies = next(left)

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= CACHE_ENTRIES:
                self._compatible.clear()
            known = self._compatible[key] = (key not in self.rank
                                             and self._first_cross(a, b) == _END)
        return known

    def word_ids(self, letters: str) -> list[int]:
        """Ids of one word of the splitting pattern, given in vocabulary letters."""
        token = self.whole.get(letters)
        if token is not None:
            return [token]
        last = [-1] * len(letters)
        known = self._compatible.get
        for end, (token, length) in self.automaton.iter(letters):
            if last[end] >= 0:
                continue
            before = end - length
            if before >= 0:
                ok = known(last[before] << 20 | token)
                if ok is None:
                    ok = self.compatible(last[before], token)
                if not ok:
                    continue
            last[end] = token
        ids, at, size = [], len(letters) - 1, self.bytes_of
        while at >= 0:
            ids.append(last[at])
            at -= len(size[last[at]])
        return ids[::-1]

    def _piece(self, text: str) -> bytes:
        """Packed ids of a stretch of text that the pattern splits without its surroundings."""
        out = []
        for word in _PATTERN.findall(text):
            packed = self.words.get(word)
            if packed is None:
                letters = word.encode().decode("latin-1").translate(self.map)
                packed = np.array(self.word_ids(letters), "<u4").tobytes()
                if len(word) <= CACHE_CHARS:
                    if len(self.words) >= CACHE_ENTRIES:
                        self.words.clear()
                    self.words[word] = packed
            out.append(packed)
        return b"".join(out)

    def _segment(self, text: str) -> bytes:
        """Packed ids of a text without special tokens.

        The pattern never joins a character before a blank to it, so the text is cut at single
        blanks and equal pieces are looked up. A piece at whose ends more white space stands
        (two blanks, blank after line end) depends on its neighbours: then the whole text goes
        through the pattern at once.
        """
        head, *rest = text.split(" ")
        if rest and (not head or head[-1].isspace()):
            return self._piece(text)
        out = [self._piece(head), *map(self.pieces.get, rest)]
        if None in out:
            for i, piece in enumerate(rest, 1):
                if out[i] is None:
                    if not piece or piece[0].isspace() or (piece[-1].isspace() and i < len(rest)):
                        return self._piece(text)
                    out[i] = self._piece(" " + piece)
                    if len(piece) <= CACHE_CHARS and not piece[-1].isspace():
                        if len(self.pieces) >= CACHE_ENTRIES:
                            self.pieces.clear()
                        self.pieces[piece] = out[i]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self._segment(text) if text else b""
        return b"".join(
            np.array([self.special[x]], "<u4").tobytes() if x in self.special
            else self._segment(x) for x in self.special_split.split(text) if x)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included."""
        parts = map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(parts).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, built once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of every text, array<int>; a null text has no ids."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = [np.frombuffer(v.encode(t), "<u4").astype("i4") for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))],
                names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to the empty text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            out = [v.decode(np.array(x or [], "<u4").tobytes())
                   for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: number of ids, SHA-256 of the packed ids and of the text decoded from them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in texts(batch, "text"):
                ids = v.encode(text)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(v.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
