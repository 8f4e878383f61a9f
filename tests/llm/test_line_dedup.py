"""Line dedup against a brute-force version."""

import hashlib
import random

import pytest

from custseg.llm import line_dedup
from custseg.llm.common import ASCII_SPACE


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars=40, min_docs=5):
    holders = {}
    rank = lambda d: (d is not None, d or 0)
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = lower(line.strip(ASCII_SPACE))
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(d)
    keeper = {k: max(v, key=rank) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            k = lower(line.strip(ASCII_SPACE))
            if k not in keeper or keeper[k] == d:
                kept.append(line)
        out.append((d, "\n".join(kept)))
    return out


def result(docs):
    return sorted(((r["doc_id"], r["text"] or "") for r in
                   line_dedup.drop_repeated_lines(docs).select("doc_id", "text").collect()),
                  key=str)


LONG = "This line is long enough to be looked at by the operator, Nr. %d."


def corpus(seed):
    rnd = random.Random(seed)
    common = [LONG % i for i in range(6)] + ["short line", "Ä" * 40, "ä" * 40, "x" * 39]
    rows = []
    for i in range(60):
        lines = [rnd.choice(common) if rnd.random() < 0.7 else f"own line of document {i} " * 3
                 for _ in range(rnd.randint(1, 8))]
        lines = [rnd.choice(["", " ", "\t", " "]) + x.swapcase() + rnd.choice(["", " \r", " "])
                 if rnd.random() < 0.3 else x for x in lines]
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("partitions", [1, 13])
def test_matches_brute_force(spark, docs_of, seed, partitions):
    rows = corpus(seed) + [(None, LONG % 1), (None, LONG % 1 + "\n" + LONG % 2), (100, None),
                           (101, ""), (3, LONG % 3), (3, LONG % 3)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(docs_of(rows)) == sorted(brute(rows), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_hot_line_over_many_tasks(spark, docs_of):
    """One line in every document: its run is cut into many tasks and still has one keeper."""
    rows = [(i, LONG % 1 + f"\nown {i}") for i in range(400)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(docs_of(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [d for d, t in got if LONG % 1 in t] == [399]


def test_bitmaps_and_columns(docs_of):
    rows = [(i, f"first\n{LONG % 1}\nlast") for i in range(5)]
    maps = {r["doc_id"]: r for r in line_dedup.keep_bitmaps(docs_of(rows)).collect()}
    assert sorted(maps) == [0, 1, 2, 3] and maps[0]["n_lines"] == 3
    assert line_dedup.n_dropped(maps[0]["keep_bitmap"], 3) == 1 == maps[0]["n_dropped"]
    assert line_dedup.kept_lines(rows[0][1], maps[0]["keep_bitmap"]) == "first\nlast"
    out = line_dedup.drop_repeated_lines(docs_of(rows))
    assert out.columns == docs_of(rows).columns
    assert {r["keep_bitmap"] for r in out.collect()} == {"clash"}


def test_long_text_and_empty_table(spark, docs_of):
    text = "\n".join([LONG % 1] * 30_000 + ["end"])
    rows = [(i, text) for i in range(5)]
    got = dict(result(docs_of(rows)))
    assert [got[i] for i in range(5)] == ["end"] * 4 + [text]
    assert result(docs_of([])) == []


def test_query_digest(spark, tmp_path):
    from custseg.llm.queries import op9_line_dedup
    rows = corpus(3)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    for (d, t), (_, kept) in zip(rows, brute(rows)):
        assert got[d]["n_lines"] == len(t.split("\n"))
        assert got[d]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
