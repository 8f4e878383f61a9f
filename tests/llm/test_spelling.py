"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from custseg.llm import spelling


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, ratio=10):
    forms, out = {}, {}
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if near(w, v))
        best = others[0] if others and -others[0][0] >= ratio * n else None
        forms[w] = best[1] if best else None
        out[w] = (n, len(others), -best[0] if best else None)
    rows = []
    for w, (n, n_near, form_n) in out.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n, n_near, form_n))
    return sorted(rows, key=str)


def plain_counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def result(df):
    rows = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in rows), key=str)


def edited(rnd, word, alphabet):
    i = rnd.randrange(len(word) + 1)
    kind = rnd.randrange(3)
    if kind == 0:
        return word[:i] + rnd.choice(alphabet) + word[i:]
    return word[:i] + (rnd.choice(alphabet) if kind == 1 else "") + word[i + 1:]


@pytest.mark.parametrize("alphabet", ["ab", "abcéÿ", "abcdefghijklmnopqrstuvwxyzß"])
def test_all_near_words_are_found(spark, alphabet):
    rnd = random.Random(len(alphabet))
    counts = {}
    for _ in range(60):
        word = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 2, 6, 7, 8, 9, 13, 30])))
        for _ in range(rnd.randint(1, 6)):
            counts[word] = rnd.choice([1, 2, 2, 3, 20, 21, 300, 5000])
            word = edited(rnd, word, alphabet) or "a"
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert result(spelling.variants(words)) == plain_variants(counts)


def test_one_letter_everywhere(spark):
    """Words of one repeated letter share every key; each is near the next two lengths at most."""
    counts = {"a" * k: 10 ** (k % 7) for k in range(1, 40)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(spelling.variants(words)) == plain_variants(counts)


def test_roots_follow_long_chains(spark):
    counts = {"spelling" + "abcdefghijkl"[:k]: 10 ** k for k in range(12)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = result(spelling.variants(words))
    assert rows == plain_variants(counts)
    assert {r[2] for r in rows} == {"spellingabcdefghijk"}


def test_runs_of_texts(docs_of):
    rnd = random.Random(5)
    pool = ["Government", "goverment", "gouvernement", "Élévation", "élévation", "ÉLÉVATION",
            "naïveté", "short", "x" * 300, "under_score", "digits123digits", "straße"]
    rows = [(rnd.choice([i, i, 3]), rnd.choice([" ", "-", "\n", "7", "ā", "×"]).join(
        rnd.choice(pool) for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    rows += [(1000, None), (1001, ""), (None, "Government government"), rows[0], rows[0],
             (1002, "elephants " * 50_000)]
    counts = plain_counts(rows)
    assert {r["word"]: r["n"] for r in spelling.run_counts(docs_of(rows)).collect()} == counts
    assert result(spelling.variants(spelling.run_counts(docs_of(rows)))) == plain_variants(counts)


def test_counting_in_parts(docs_of):
    rows = [(i, f"common{'abc'[i % 3]} commonwealth") for i in range(30)]
    got = {r["word"]: r["n"] for r in
           spelling.run_counts(docs_of(rows), held_words=1).collect()}
    assert got == plain_counts(rows)


def test_empty_table(docs_of, spark):
    assert result(spelling.variants(spelling.run_counts(docs_of([])))) == []
    assert result(spelling.variants(spelling.run_counts(docs_of([None, "", "few"])))) == []


def test_edit_places_are_disjoint():
    for length in range(1, 200):
        places = spelling.edit_places(length)
        assert [i for i, _ in places] == [0] + [j for _, j in places[:-1]]
        assert places[-1][1] == length and len(places) <= 2 ** spelling.DEPTH
