"""Physical-plan properties that matter at scale."""

import pytest

from custseg.operators import behavior, personas, segments
from custseg.plans.analysis import CustomerAnalysis
from custseg.session import materialize
from custseg.sources.tables import bind_testdata

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def a(spark):
    return CustomerAnalysis(bind_testdata(spark, SF), shared=True)


def test_scores_are_map_only_over_the_hub(a):
    p = plan(a.quantile_scores())
    assert "SinglePartition" not in p and "Window" not in p and "Exchange" not in p


def test_hub_aggregates_combine_before_shuffle(spark):
    from custseg.operators.metrics import customer_metrics
    t = bind_testdata(spark, SF)
    p = plan(customer_metrics(t.orders))
    # partial aggregation appears below each exchange
    assert p.count("HashAggregate") >= 4


def test_orders_scan_is_column_pruned(spark):
    from custseg.operators.metrics import customer_metrics
    t = bind_testdata(spark, SF)
    scan, = [x for x in plan(customer_metrics(t.orders)).split("\n") if "FileScan" in x]
    for column in ("o_custkey", "o_orderdate", "o_totalprice"):
        assert column in scan
    for column in ("o_orderpriority", "o_orderstatus", "o_clerk", "o_comment"):
        assert column not in scan


def test_persona_scores_read_the_segment_rows_not_the_fact(a):
    p = plan(a.persona_scores())
    scans = [line for line in p.split("\n") if "FileScan" in line]
    assert scans and not any("o_orderkey" in s or "o_custkey" in s for s in scans)
    # partial sums per persona, then the bounds and the final order over the few groups
    groups = plan(personas.persona_groups(a.rows, a.p))
    assert groups.count("Exchange hashpartitioning") == 1 and "customer_id" not in groups


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def _below(text: str, upper: str, lower: str) -> bool:
    """Whether a node ``lower`` stands under a node ``upper`` in a plan's text."""
    lines = text.split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        if upper in x:
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                if lower in lines[j]:
                    return True
    return False


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_first_two_orders_are_limited_before_any_shuffle(spark, threshold):
    """At most two rows per customer and task are shuffled, whatever join picks the cohort."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        t = bind_testdata(spark, SF)
        weights = spark.createDataFrame([(1, 1)], "customer_id long, m long")
        p = plan(behavior.first_two_orders(t.orders, weights))
    finally:
        spark.conf.set(key, old)
    assert _below(p, "Exchange hashpartitioning(customer_id", "WindowGroupLimit")
    partial = p[p.index("Partial"):]
    assert "WindowGroupLimit" in p[:p.index("Partial")] and "Exchange" not in partial.split("FileScan")[0]


def test_bloom_filter_of_the_cohort_reaches_the_items_scan(spark, no_broadcast):
    """Beyond a broadcast, Spark's runtime filter drops items before they are shuffled."""
    conf = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b",
            "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        t = bind_testdata(spark, SF)
        best = spark.createDataFrame([(1, "A")], "customer_id long, cust_group string")
        cohort = materialize(behavior.cohort_orders(t.orders, best), "cohort")
        facts = behavior.cohort_line_facts(cohort, t.order_items, t.products)
        p = facts._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert _below(p, "Join LeftSemi", "might_contain")


def test_items_are_reduced_before_the_left_join(spark, no_broadcast):
    t = bind_testdata(spark, SF)
    best = spark.createDataFrame([(1, "A")], "customer_id long, cust_group string")
    facts = behavior.cohort_line_facts(behavior.cohort_orders(t.orders, best), t.order_items,
                                       t.products)
    assert _below(plan(facts), "LeftOuter", "LeftSemi")


def test_bounds_need_no_join_and_no_window(a):
    """Minima and maxima of the personas combine in the tasks, as a scalar subquery."""
    p = plan(personas.persona_scores(personas.persona_groups(a.rows, a.p), a.p))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p and "Window" not in p
    assert "Subquery" in p and "partial_min" in p


def test_customers_need_no_window_of_their_own(spark, no_broadcast):
    """One exchange a side joins customers and dimension, repeated ids or not."""
    scored = spark.range(100).selectExpr("id AS customer_id", "1 AS R", "1 AS F", "1 AS M",
                                         "'111' AS rfm")
    t = bind_testdata(spark, SF)
    for unique in (True, False):
        p = plan(segments.segment_rows(scored, t.customers, 2000, unique=unique))
        assert ("Window" in p) is not unique
        head = p[:p.index("Scan")] if unique else p
        assert not _below(p, "Window", "Range (0, 100")
        assert head.count("Exchange hashpartitioning(dim_id") + p.count(
            "Exchange hashpartitioning(customer_id") <= 2
