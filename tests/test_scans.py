"""Segmented scan against per-key windows, and the heavy sides of joins."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from custseg.operators import behavior, segments
from custseg.operators.ranks import asc
from custseg.operators.scans import numbered
from custseg.params import Params
from custseg.plans.analysis import CustomerAnalysis
from tests.conftest import CUSTOMERS_SCHEMA, make_tables, order


@pytest.mark.parametrize("partitions", [1, 3, 16, 60, None])
def test_scan_equals_window(spark, partitions):
    rnd = random.Random(1)
    keys = [7, 7, 7, 3, None, *range(100, 140)]
    rows = [(rnd.choice(keys), i, rnd.choice([None, rnd.randrange(300)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, id long, t long")
    w = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_last(), "id")
    exp = (df.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("t").over(w))
           .withColumn("is_last", F.lead("id").over(w).isNull()))
    got = numbered(df, "k", [asc("t"), asc("id")], "t", partitions=partitions)
    assert got.columns == exp.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, exp.collect()))


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "k long, id long, t long")
    assert numbered(df, "k", [asc("t"), asc("id")], "t").collect() == []


def _hot_orders():
    rnd = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    return [order(i, 1 if i % 3 == 0 else 2 + i % 40,
                  start + dt.timedelta(minutes=rnd.randrange(400_000))) for i in range(3000)]


def test_order_gaps_of_a_hot_customer(spark):
    """A customer with a third of all orders is numbered over many tasks."""
    tables = make_tables(spark, _hot_orders(), [(i, "F", "HN", 1990, "app") for i in range(1, 42)])
    weights = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "customer_id long, m long")
    written = []
    got = behavior.order_gaps(tables.orders, weights, Params(rank_partitions=8), written=written)
    own = tables.orders.join(weights, "customer_id").withColumn(
        "copy", F.explode(F.expr("sequence(1L, m)")))
    w = Window.partitionBy("customer_id").orderBy("created_at", "order_id", "copy")
    seconds = F.timestamp_diff("SECOND", "created_at", F.lead("created_at").over(w))
    exp = own.select("customer_id", "order_id", F.row_number().over(w).alias("rn_order"),
                     F.round(seconds / 86400.0, 4).alias("diff"))

    def rows(df):
        return sorted((r["customer_id"], r["rn_order"], r["order_id"],
                       None if r["diff"] is None else round(float(r["diff"]), 4))
                      for r in df.collect())

    assert rows(got) == rows(exp)
    scan = spark.read.parquet(written[0])
    tasks = [r["count"] for r in scan.groupBy("__p").count().collect()]
    assert len(tasks) == 8 and max(tasks) < 2 * statistics.median(tasks)
    hot = scan.filter("customer_id = 1")
    assert hot.select("__p").distinct().count() > 4


def test_first_gap_is_the_first_of_all_gaps(spark):
    tables = make_tables(spark, _hot_orders(), [(i, "F", "HN", 1990, "app") for i in range(1, 42)])
    weights = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "customer_id long, m long")
    first = behavior.first_gaps(tables.orders, weights)
    every = behavior.order_gaps(tables.orders, weights).filter("rn_order = 1")
    assert (sorted(map(tuple, first.collect()))
            == sorted((r["customer_id"], r["diff"]) for r in every.collect()))


# -- heavy dimension ids ---------------------------------------------------------------------
def _heavy_dimension(spark, n=4000):
    rnd = random.Random(8)
    rows = [(5 if i % 5 < 2 else i, rnd.choice(["F", "M"]), rnd.choice(["HN", "HCM", None]),
             rnd.choice([1970, 1990, None]), rnd.choice(["app", "web"])) for i in range(n)]
    rows += [(6, "F", "HN", 1990, "app")] * 3 + [(None, "F", "HN", 1990, "app")] * 50
    return spark.createDataFrame(rows, CUSTOMERS_SCHEMA)


def _scored(spark, n=3000):
    return spark.range(n).selectExpr("nullif(id, 2900) AS customer_id", "1 AS R", "2 AS F",
                                     "3 AS M", "'123' AS rfm", "id AS monetary")


def test_heavy_id_is_dealt_over_many_tasks(spark):
    dim, scored = _heavy_dimension(spark), _scored(spark)
    repeated, heavy = segments.repeated_ids(dim, 100)
    assert heavy == [(5, 1600)] and repeated == 2
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "false")
        dealt = segments.segment_rows(scored, dim, 2024, heavy=heavy, heavy_rows=20)
        plain = segments.segment_rows(scored, dim, 2024)
        tasks = {}
        for name, df in (("dealt", dealt), ("plain", plain)):
            counts = df.groupBy(F.spark_partition_id()).count().collect()
            tasks[name] = [r["count"] for r in counts]
        assert max(tasks["dealt"]) < 2 * statistics.median(tasks["dealt"])
        assert max(tasks["plain"]) > 3 * statistics.median(tasks["plain"])
        compared = [c for c in plain.columns if c != "first_copy"]

        def rows(df, columns):
            return sorted(map(str, df.select(*columns).collect()))

        assert rows(dealt, compared) == rows(plain, compared)
        # the same number of first copies of each customer and persona: one
        persona = ["customer_id", "gender", "city", "age_group"]
        for df in (dealt, plain):
            firsts = df.filter("matched").groupBy(*persona).agg(F.sum("first_copy").alias("n"))
            assert firsts.filter("n <> 1").count() == 0
            assert df.filter("NOT matched AND first_copy = 1").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_analysis_with_a_heavy_id(spark):
    """The whole analysis agrees with and without dealing, and reports the repeated ids."""
    orders = [order(i, i % 60, f"2024-01-{1 + i % 28:02d} 10:00:00", subtotal=10 + i)
              for i in range(300)]
    dim = _heavy_dimension(spark, 400)
    tables = make_tables(spark, orders, [])
    tables = type(tables)(tables.orders, tables.order_items, tables.products, dim)
    results = []
    for heavy_rows in (10, 10_000):
        a = CustomerAnalysis(tables, Params(min_customers=1, heavy_rows=heavy_rows))
        with pytest.warns(UserWarning, match="not unique"):
            found = [sorted(map(str, a.customer_segments().collect()))]
        found += [sorted(map(str, x.collect())) for x in (
            a.segment_gmv_share(), a.persona_groups(), a.best_customers())]
        results.append(found)
    assert results[0] == results[1] and len(results[0][2]) > 2
