"""Context-tree weighting against a plain recursion over dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from custseg.llm import ctw

END = 255


def symbols(text):
    """(context, nearest byte first; symbol) of every place of a text, its end included."""
    raw = [END] * ctw.DEPTH + list((text or "").encode().lower()) + [END]
    for i in range(ctw.DEPTH, len(raw)):
        yield tuple(raw[i - j] for j in range(1, ctw.DEPTH + 1)), raw[i]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class PlainModel:
    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        self.known = {}
        for text in texts:
            for ctx, x in symbols(text):
                for place in range(8):
                    bits = (1 << place) | (x >> (8 - place))
                    for d in range(ctw.DEPTH + 1):
                        self.counts[ctx[:d], bits][x >> (7 - place) & 1] += 1
                        if d:
                            self.children[ctx[:d - 1], bits].add(ctx[:d])

    def own(self, ctx, bits):
        a, b = self.counts.get((ctx, bits), (0, 0))
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def mixed(self, ctx, bits):
        if (ctx, bits) not in self.known:
            value = self.own(ctx, bits)
            if len(ctx) < ctw.DEPTH:
                below = sum(self.mixed(c, bits) for c in self.children.get((ctx, bits), ()))
                value = np.logaddexp(value, below) - math.log(2)
            self.known[ctx, bits] = value
        return self.known[ctx, bits]

    def p_one(self, ctx, bits):
        def at(d):
            a, b = self.counts.get((ctx[:d], bits), (0, 0))
            estimate = (b + .5) / (a + b + 1)
            if d == ctw.DEPTH:
                return estimate
            weight = math.exp(self.own(ctx[:d], bits) - math.log(2) - self.mixed(ctx[:d], bits))
            return weight * estimate + (1 - weight) * at(d + 1)

        return at(0)

    def log_p(self, ctx, x):
        total = 0.0
        for place in range(8):
            one = self.p_one(ctx, (1 << place) | (x >> (8 - place)))
            total += math.log10(one if x >> (7 - place) & 1 else 1 - one)
        return total


def plain_scores(rows):
    learnt = [t for d, t in rows if not held_out(d)]
    model = PlainModel(learnt)
    def tokens(t):
        return (t or "").encode().lower().split() + [b""]
    c = Counter(x for t in learnt for x in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        own = tokens(t)
        out.append((str(d), held_out(d), len(own), sum(c[x] > 0 for x in own), n,
                    sum(math.log10((c[x] + 1) / (n + v + 1)) for x in own),
                    sum(model.log_p(ctx, x) for ctx, x in symbols(t))))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), *[r[c] for c in ("held_out", "n_tokens", "n_known",
                                                      "train_tokens", "base_score", "score")])
                  for r in df.collect())


def random_rows(rnd, n):
    pool = ["the", "The", "cat", "sat", "on", "zürich", "😀", "a\tb", "\n", "ﬁ", "x" * 20]
    rows = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, "The cat"), (None, "the cat"), (3, "other"),
                   rows[0], rows[0], (n + 2, "aaaaabaaaaab" * 300)]


@pytest.mark.parametrize("block_bytes, pack_bytes", [(32 << 20, 4 << 20), (400, 150), (1, 1)])
def test_scores_match_plain_recursion(docs_of, block_bytes, pack_bytes):
    rows = random_rows(random.Random(3), 40)
    got = result(ctw.score(docs_of(rows), block_bytes=block_bytes, pack_bytes=pack_bytes))
    for g, e in zip(got, plain_scores(rows), strict=True):
        assert g[:5] == e[:5]
        assert g[5:] == pytest.approx(e[5:], rel=1e-9)


def test_buckets_of_any_size(spark):
    """Probabilities do not depend on the buckets, and those of all symbols sum to one."""
    rnd = random.Random(9)
    ctx = [tuple(rnd.choice([32, 97, 98, 255]) for _ in range(ctw.DEPTH)) for _ in range(12)]
    counts = {}
    for c in ctx:
        high = 0
        for byte in c:
            high = high << 8 | byte
        for x in range(256):
            counts[high << 8 | x] = rnd.choice([0, 0, 1, 5, 10 ** 9])
    df = spark.createDataFrame(list(counts.items()), "key long, n long")
    few, many = ({r["key"]: r["logp"] for r in ctw.gram_probabilities(df, len(counts), k).collect()}
                 for k in (10 ** 6, 40))
    assert few.keys() == counts.keys() and few == pytest.approx(many, rel=1e-9)
    sums = Counter()
    for key, logp in few.items():
        sums[key >> 8] += 10 ** logp
    assert all(s == pytest.approx(1, rel=1e-9) for s in sums.values())


def test_held_out_code_is_shorter_than_words(spark):
    """On prose the model is far better than the base, on training and on held-out texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = ctw.score(docs).collect()
    assert len(rows) == docs.count() and any(r["held_out"] for r in rows)
    for held in (True, False):
        own = [r for r in rows if r["held_out"] == held]
        size = sum(r["n_bytes"] for r in own)
        assert -sum(r["score"] for r in own) * math.log2(10) / size < 2.9    # bits a byte


def test_own_rule_and_no_training_text(docs_of):
    rows = [(1, "abc"), (2, "")]
    got = result(ctw.score(docs_of(rows), held_out=F.lit(True)))
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [(True, 2, 0, 0), (True, 1, 0, 0)]
    assert [r[6] for r in got] == pytest.approx([-32 * math.log10(2), -8 * math.log10(2)])
    assert [r[5] for r in got] == [0.0, 0.0]


def test_empty_table(docs_of):
    assert result(ctw.score(docs_of([]))) == []


def test_log_gamma():
    x = np.concatenate([np.arange(1, 4000) / 2, 10.0 ** np.arange(1, 12)])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)
