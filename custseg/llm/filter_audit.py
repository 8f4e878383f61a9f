"""Filter interaction audit: what each of five filters removes, over all 120 orders of them.

A document fails a set of the filters, its mask:

* A: fewer than 50 words (maximal runs without ASCII white space, case-sensitive)
* B: 100 * distinct words < 65 * words
* C: 100 * characters A-Z > 5 * code points
* D: any of ``# $ % & * |``
* E: the same text as a document of smaller doc_id, anywhere in the table

1. One pass over the texts gives (doc_id, part, mask of A-D, digest of the text). E is decided on
   digests: the smallest doc_id of a digest (minima combine before the shuffle, so copies that
   are a third of all rows are one row per task), joined back on digest *and* doc_id, so that
   all copies of a text never meet in one task.
2. Documents are summed by (part, mask): at most 32 rows per part and task.
3. Orders are ranked by their Lehmer code, which is lexicographic order, so the orders that share
   their first letters are an interval of ranks. A mask is removed at step s by the orders whose
   first s-1 letters are outside the mask and whose letter s is inside: a few intervals, 840
   for all masks. Each (part, mask) adds its counts at the start of an interval and takes them
   off at its end; prefix sums over the 120 ranks give what every order removes at that step.
4. What is kept, redundant and the sum over all orders follow from these sums, on 600 rows
   per part.

Defined results: a null text is empty (it fails A only, and E if it isn't the first); a null part
is the empty string. Rows count one by one, those that share a doc_id too; a null doc_id fails E
nowhere and makes no other fail. A doc_id with several label rows is good (toxic) if any of them
says so. Texts are whole, however long. An empty table has no parts and gives no rows. Other
columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custseg.llm.common import map_batches, materialize, texts

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PCT = 65
MAX_UPPER_PCT = 5
SYMBOLS = b"#$%&*|"

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_COUNTS = ("n", "good", "toxic")


def text_mask(text: str) -> int:
    """The failed filters among A-D as bits, A lowest."""
    raw = text.encode()
    words = raw.split()                 # bytes.split cuts at ASCII white space alone
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < MIN_DISTINCT_PCT * len(words)) << 1
            | (100 * upper > MAX_UPPER_PCT * len(text)) << 2
            | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3)


def _masks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = texts(batch, "text")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"),
             pa.array([text_mask(t) for t in found], pa.int32()),
             pa.array([hashlib.sha256(t.encode()).digest() for t in found], pa.binary())],
            names=["doc_id", "part", "mask", "digest"])


def orders() -> list[str]:
    """All orders of the filters; the place of an order is its Lehmer rank."""
    return ["".join(p) for p in permutations(FILTERS)]


def lehmer_rank(prefix: tuple[int, ...], n: int) -> int:
    """The rank of the first order of ``n`` letters that begins with ``prefix``."""
    rank = 0
    for i, letter in enumerate(prefix):
        smaller = letter - sum(other < letter for other in prefix[:i])
        rank += smaller * factorial(n - 1 - i)
    return rank


def removal_intervals(n: int = len(FILTERS)) -> Iterator[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders that remove a mask at a step."""
    for step in range(1, n + 1):
        for prefix in permutations(range(n), step):
            start = lehmer_rank(prefix, n)
            passed = sum(1 << f for f in prefix[:-1])
            for mask in range(1 << n):
                if mask >> prefix[-1] & 1 and not mask & passed:
                    yield mask, step, start, start + factorial(n - step)


def document_masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failed filters."""
    rows = materialize(map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                    F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")),
        _masks, "doc_id long, part string, mask int, digest binary"), "audit-masks")
    first = (rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("first", F.lit(True)))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    again = (F.col("first").isNull() & F.col("doc_id").isNotNull()).cast("int")
    return (rows.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
            .groupBy("part", (F.col("mask") + again * (1 << FILTERS.index("E"))).alias("mask"))
            .agg(F.count(F.lit(1)).alias("n"),
                 *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in _COUNTS[1:]]))


def order_totals(counts: DataFrame) -> DataFrame:
    """The audit rows from documents by (part, mask): one per part, order and step."""
    spark = counts.sparkSession
    names = orders()
    counts = materialize(counts, "audit-counts")       # read three times below
    # a fixed table of 1,680 rows
    ends = spark.createDataFrame(
        [(mask, step, at, sign) for mask, step, start, end in removal_intervals()
         for at, sign in ((start, 1), (end, -1))], "mask int, step int, at int, sign int")
    added = counts.join(F.broadcast(ends), "mask").select(
        "part", "step", "at", *[(F.col(c) * F.col("sign")).alias(c) for c in _COUNTS])
    parts = counts.select("part").distinct()
    grid = (parts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
            .withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
            .select("part", "step", "at", *[F.lit(0).cast("long").alias(c) for c in _COUNTS]))
    diffs = (added.unionByName(grid).groupBy("part", "step", "at")
             .agg(*[F.sum(c).alias(c) for c in _COUNTS])
             .filter(F.col("at") < len(names)))
    ranks = Window.partitionBy("part", "step").orderBy("at")
    removed = diffs.select(
        "part", "step", "at",
        F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1).alias("filter_order"),
        *[F.sum(c).over(ranks).alias(c) for c in _COUNTS])
    removed = removed.withColumn("letter", F.substr("filter_order", "step", F.lit(1)))

    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0))
             for i in range(len(FILTERS))]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0))
             for i in range(len(FILTERS))]
    totals = counts.groupBy("part").agg(F.sum("n").alias("all"), F.array(*fails).alias("fails"),
                                        F.array(*alone).alias("alone"))
    steps = Window.partitionBy("part", "at").orderBy("step")
    place = F.instr(F.lit(FILTERS), F.col("letter"))
    return removed.join(totals, "part").select(
        "part", "filter_order", "step",
        (F.col("all") - F.sum("n").over(steps)).alias("kept"),
        F.col("n").alias("removed"),
        # a document that fails the filter is removed here, or was removed earlier
        (F.element_at("fails", place) - F.col("n")).alias("redundant"),
        F.element_at("alone", place).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step; see the module's text."""
    return order_totals(document_masks(docs, labels, part))
