"""Distributed exact NTILE / rank selection equals a global window, however partitioned."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from custseg.operators import ranks as ranks_module
from custseg.operators.ranks import Order, asc, desc, ntile_ends, select_ranks, sorted_keys, \
    with_ntile, with_ntiles
from custseg.params import Params
from custseg.session import materialize

PATHS = {
    "session": Params(),
    "narrowed": Params(rank_rows=300),
    "narrowed_far": Params(rank_rows=8, rank_partitions=7),
}


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(4000):
        heavy = rnd.choice([None, 1, 2, 2, 3, 3, 3, 3, 3, 4])      # a value held by ~40 % of rows
        rows.append((None if i == 11 else i, heavy, rnd.randint(0, 30), rnd.random(), f"s{i % 700}"))
    return materialize(spark.createDataFrame(rows, "id long, v long, w long, x double, s string"),
                       "test")


def _reference(df, cols, k):
    return df.withColumn("expected", F.ntile(k).over(Window.orderBy(*cols)))


def _sql_order(keys):
    """The reference window order: PostgreSQL NULL placement written out."""
    return [F.col(k.name).asc_nulls_last() if k.ascending else F.col(k.name).desc_nulls_first()
            for k in keys]


@pytest.mark.parametrize("path", sorted(PATHS))
@pytest.mark.parametrize("keys", [
    [asc("v"), asc("id")],
    [desc("v"), asc("id")],
    [asc("w"), desc("x"), asc("id")],
    [asc("s"), asc("id")],
    [desc("v"), asc("s"), asc("id")],
], ids=["v_asc", "v_desc", "w_asc_x_desc", "text", "v_desc_text"])
def test_ntile_matches_window(data, path, keys):
    cols = _sql_order(keys)
    got = with_ntile(data, "tile", keys, 5, params=PATHS[path])
    exp = _reference(data, cols, 5)
    joined = got.join(exp, got["id"].eqNullSafe(exp["id"]))
    assert joined.count() == 4000
    assert joined.filter(F.col("tile") != F.col("expected")).count() == 0


@pytest.mark.parametrize("path", sorted(PATHS))
def test_ntile_many_specs_share_passes(data, path):
    got = with_ntiles(data, [("a", [asc("v"), asc("id")]), ("b", [desc("x"), asc("id")])], 7,
                      params=PATHS[path])
    exp = (data.withColumn("ea", F.ntile(7).over(Window.orderBy(F.col("v").asc_nulls_last(),
                                                                 F.col("id").asc_nulls_last())))
           .withColumn("eb", F.ntile(7).over(Window.orderBy(F.col("x").desc_nulls_first(),
                                                            F.col("id").asc_nulls_last()))))
    j = got.join(exp, got["id"].eqNullSafe(exp["id"]))
    assert j.filter((F.col("a") != F.col("ea")) | (F.col("b") != F.col("eb"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 7])
def test_fewer_rows_than_tiles(spark, n):
    df = spark.createDataFrame([(i, float(i)) for i in range(n)], "id long, x double")
    got = [r["t"] for r in with_ntile(df, "t", [asc("x"), asc("id")], 5).orderBy("x").collect()]
    expected = {0: [], 1: [1], 3: [1, 2, 3], 7: [1, 1, 2, 2, 3, 4, 5]}[n]
    assert got == expected


def test_ntile_ends():
    assert ntile_ends(7, 5) == [2, 4, 5, 6]
    assert ntile_ends(10, 5) == [2, 4, 6, 8]
    assert ntile_ends(3, 5) == [1, 2, 3, 3]


@pytest.mark.parametrize("path", sorted(PATHS))
def test_select_ranks_values(data, path):
    ranks = [1, 2, 1000, 1999, 2000, 3999, 4000]
    picked = select_ranks(data, [asc("x"), asc("id")], ranks, params=PATHS[path])
    ordered = [r["x"] for r in data.orderBy(F.col("x").asc_nulls_last(), "id").collect()]
    assert {r: picked[r][1] for r in ranks} == {r: ordered[r - 1] for r in ranks}


@pytest.mark.parametrize("path", sorted(PATHS))
@pytest.mark.parametrize("k", [100])
def test_many_tiles(data, path, k):
    keys = [asc("v"), asc("id")]
    got = with_ntile(data, "tile", keys, k, params=PATHS[path])
    exp = _reference(data, _sql_order(keys), k)
    joined = got.join(exp, got["id"].eqNullSafe(exp["id"]))
    assert joined.filter(F.col("tile") != F.col("expected")).count() == 0


def test_selection_never_sorts_all_rows_in_one_task(data):
    order = Order([asc("v"), asc("id")])
    p = sorted_keys(data, [order])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in p and "SinglePartition" not in p and "Window" not in p
    rows = sorted_keys(data, [order], 8).groupBy("__p").count().collect()
    # a value held by 40 % of the rows is cut by the tie-break: partitions stay even
    assert len(rows) == 8 and max(r["count"] for r in rows) < 2 * 4000 / 8


def test_tiles_are_a_projection(data):
    out = with_ntile(data, "tile", [asc("v"), asc("id")], 5)
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in p and "Window" not in p and "Join" not in p


def test_only_wanted_rows_reach_the_driver(data):
    picked = select_ranks(data, [asc("v"), asc("id")], [2000, 2000, 5000, 0])
    assert set(picked) == {2000}


def test_extreme_doubles_and_decimals(spark):
    """Values that a double can't tell apart, infinities, NaN and NULLs keep their exact ranks."""
    rnd = random.Random(2)
    special = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, None, 1e-300]
    rows = [(i, rnd.choice(special + [rnd.random()]),
             Decimal(10) ** 30 + rnd.randrange(400) if rnd.random() < 0.9 else None)
            for i in range(2000)]
    df = materialize(spark.createDataFrame(rows, "id long, x double, d decimal(38,0)"), "test")
    for keys in ([asc("x"), asc("id")], [desc("x"), asc("id")], [asc("d"), asc("id")],
                 [desc("d"), desc("id")]):
        got = with_ntile(df, "tile", keys, 20, params=Params(rank_rows=10))
        exp = _reference(df, _sql_order(keys), 20)
        j = got.join(exp, "id")
        assert j.filter(F.col("tile") != F.col("expected")).count() == 0


def test_numeric_keys_are_never_sorted_as_a_whole(data, monkeypatch):
    """No range exchange: brackets are narrowed, also inside a value held by 40 % of the rows."""
    def fail(*a, **k):
        raise AssertionError("sorted all rows")

    monkeypatch.setattr(ranks_module, "sorted_keys", fail)
    for k in (5, 20, 100):
        with_ntiles(data.filter("id IS NOT NULL"), [("a", [asc("v"), asc("id")]),
                                                    ("b", [desc("w"), asc("id")])], k,
                    params=Params(rank_rows=100)).count()
