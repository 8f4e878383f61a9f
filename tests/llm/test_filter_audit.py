"""Filter interaction audit against a plain simulation of every order."""

import random
import re
from itertools import permutations

from custseg.llm import filter_audit as fa

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
           "good_lost", "toxic_lost", "shapley"]


def plain_fails(rows):
    """The set of failed filters of each (doc_id, text, source) row."""
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(w) < 50:
            fails.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        if doc_id is not None and any(d is not None and d < doc_id and (x or "") == t
                                      for d, x, _ in rows):
            fails.add("E")
        out.append(fails)
    return out


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    failed = plain_fails(rows)
    out = []
    for part in {s or "" for _, _, s in rows}:
        own = [(d, f) for (d, _, s), f in zip(rows, failed) if (s or "") == part]
        found, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                total[x] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone),
                              sum(x in f for _, f in own) - len(gone),
                              sum(f == {x} for _, f in own),
                              sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        out += [(*r, total[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def result(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("mask", "part", "digest", "first", "n", "good", "toxic", "step", "at"):
        docs = docs.withColumn(name, docs["doc_id"])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in fa.audit(docs.repartition(3), marks)
                  .select(*COLUMNS).collect())


def random_rows(rnd, n):
    pool = []
    for _ in range(n // 2):
        k = rnd.choice([3, 49, 50, 80])
        words = [f"w{rnd.randrange(rnd.choice([10, 400]))}" for _ in range(k)]
        if rnd.random() < 0.3:
            words = [x.upper() for x in words]
        if rnd.random() < 0.3:
            words[0] = rnd.choice(["#", "a|b", "50%", "fish&chips"])
        pool.append(rnd.choice([" ", "\n", " \t"]).join(words))
    rows = [(i, rnd.choice(pool), rnd.choice(["a", "a", "b", None, ""])) for i in range(n)]
    labels = [(rnd.randrange(n + 5), rnd.choice([0, 1, None]), rnd.choice([0, 1]))
              for _ in range(n)]
    return rows, labels


def test_every_order_matches_simulation(spark):
    rows, labels = random_rows(random.Random(7), 80)
    # repeated rows, one doc_id with two texts, null ids and texts, no-break spaces, a long text
    rows += [rows[0], rows[0], (5, "other text", "a"), (None, "same", "a"), (None, "same", "b"),
             (900, "same", "a"), (901, None, "a"), (902, "", "c"), (903, "a b É", "c"),
             (904, "long " * 200_000, "c")]
    assert result(spark, rows, labels) == plain_audit(rows, labels)


def test_empty_tables(spark):
    assert result(spark, [], []) == []
    rows, _ = random_rows(random.Random(1), 6)
    assert result(spark, rows, []) == plain_audit(rows, [])


def test_intervals_cover_each_order_once():
    names = fa.orders()
    assert names == sorted(names) and len(names) == 120
    assert [fa.lehmer_rank(tuple("ABCDE".index(x) for x in o), 5) for o in names] == list(range(120))
    found = list(fa.removal_intervals())
    assert len(found) == 840
    for mask in range(1, 32):
        at = {}
        for m, step, start, end in found:
            if m == mask:
                for rank in range(start, end):
                    assert rank not in at
                    at[rank] = step
        for rank, order in enumerate(names):
            first = min(i for i, x in enumerate(order, 1) if mask >> "ABCDE".index(x) & 1)
            assert at[rank] == first


def test_copies_of_one_text(spark):
    docs = spark.createDataFrame([(i, "copy", "s") for i in range(50)],
                                 "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    masks = fa.document_masks(docs, marks)
    assert sorted((r["mask"], r["n"]) for r in masks.collect()) == [(1, 1), (1 + 16, 49)]
