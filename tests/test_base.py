"""Customer base: merged state, versions, layout."""

import datetime as dt
import os
import random
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from custseg.operators.metrics import customer_metrics
from custseg.params import Params
from custseg.plans.analysis import CustomerAnalysis
from custseg.sources.base import CustomerBase, customer_state, merged, state_metrics
from custseg.sources.tables import load_tables
from tests.conftest import make_tables, order

DAYS = [dt.date(2024, 1, 11), dt.date(2024, 1, 11), dt.date(2024, 1, 20), dt.date(2024, 3, 1)]


def _orders():
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        customer = rnd.choice([1, 1, None, rnd.randrange(30)])
        at = f"2024-01-{rnd.randrange(1, 29):02d} {rnd.randrange(24):02d}:30:00"
        rows.append(order(i, customer, at, subtotal=rnd.choice([None, 5, 7.25]),
                          pv=rnd.choice([None, 0, 1]), sd=rnd.choice([None, 0, 2])))
    # a customer without any amount, and one who comes in the last days only
    return rows + [order(900, 77, "2024-01-02 10:00:00", subtotal=None),
                   order(901, 77, "2024-01-25 10:00:00", subtotal=None),
                   order(902, 78, "2024-01-27 10:00:00"), order(903, 79, "2024-01-01 10:00:00")]


@pytest.fixture
def tables(spark):
    return make_tables(spark, _orders(), [(i, "F", "HN", 1990, "app") for i in range(25)])


@pytest.fixture
def base(spark):
    b = CustomerBase(spark, f"base_{uuid.uuid4().hex}", buckets=8,
                     path=tempfile.mkdtemp(prefix="custseg-base-"))
    yield b
    b.drop()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_merged_days_equal_all_orders(base, tables):
    base.create(tables.orders, DAYS[0])
    for until in DAYS[1:]:                    # the first merge adds an empty range of days
        base.merge(tables.orders, until)
    got, seen = base.metrics()
    exp = customer_metrics(tables.orders, with_vouchers=True)
    assert rows(got) == rows(exp)
    assert seen["n"] == exp.count() and seen["as_of"] == exp.agg(F.max("last_date")).first()[0]
    assert base.until == DAYS[-1]


def test_orders_without_a_time_are_counted_when_the_base_is_made(base, tables):
    untimed = tables.orders.withColumn("created_at", F.expr(
        "CASE WHEN order_id % 7 <> 0 THEN created_at END"))
    base.create(untimed, DAYS[0])
    base.merge(untimed, DAYS[-1])
    assert rows(base.metrics()[0]) == rows(customer_metrics(untimed, with_vouchers=True))


def test_merging_is_commutative(tables):
    early = tables.orders.filter("created_at < '2024-01-15'")
    late = tables.orders.filter("created_at >= '2024-01-15'")
    a, b = customer_state(early), customer_state(late)
    assert rows(state_metrics(merged(a, b))) == rows(state_metrics(merged(b, a)))


def test_versions_are_switched_and_removed(base, tables):
    base.create(tables.orders, DAYS[0])
    first = os.listdir(base.path)
    base.merge(tables.orders, DAYS[2])
    second = os.listdir(base.path)
    assert len(first) == len(second) == 1 and first != second
    with pytest.raises(ValueError, match="already holds"):
        base.merge(tables.orders, DAYS[0])
    assert os.listdir(base.path) == second
    base.drop()
    assert os.listdir(base.path) == []


def test_analyses_on_a_base(base, tables):
    params = Params(min_customers=0)
    base.create(tables.orders, DAYS[2])
    base.merge(tables.orders, DAYS[-1])
    plain = CustomerAnalysis(tables, params, with_vouchers=True)
    kept = CustomerAnalysis(tables, params, base=base)
    for name in ("customer_metrics", "customer_segments", "segment_gmv_share", "persona_scores",
                 "voucher_usage", "order_gaps"):
        assert rows(getattr(kept, name)()) == rows(getattr(plain, name)()), name
    with pytest.raises(ValueError, match="time window"):
        CustomerAnalysis(tables, params.with_(orders_from="2024-01-05"), base=base)


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def _exchanged(df) -> list[str]:
    """What stands below each exchange of a plan, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for i, x in enumerate(lines):
        if "Exchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


def test_joins_need_no_exchange_of_the_base(spark, base, tables, no_broadcast):
    base.create(tables.orders, DAYS[2])
    a = CustomerAnalysis(tables, Params(min_customers=0), base=base)
    for df in (a.hub.join(tables.customers, "customer_id"),         # C1
               tables.orders.join(a.hub, "customer_id"),            # C5
               merged(base.state(), customer_state(tables.orders)).filter("customer_id = 1"),
               a.rows):
        below = _exchanged(df)
        assert below and not any(base._current() in x and "isnull(customer_id" not in x
                                 for x in below), below


def test_segment_table_laid_out_by_customer(spark, tables, no_broadcast):
    name = f"segments_{uuid.uuid4().hex}"
    a = CustomerAnalysis(tables, Params(min_customers=0))
    with pytest.raises(ValueError, match="catalog"):
        a.save_customer_segments("/tmp/somewhere", buckets=4)
    a.save_customer_segments(name, buckets=4)
    try:
        table = spark.table(name)
        assert rows(table) == rows(a.customer_segments())
        below = _exchanged(tables.orders.join(table, "customer_id"))
        assert below and not any(name in x for x in below)
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_merge_reads_only_the_new_days(spark, base, tables):
    root = tempfile.mkdtemp(prefix="custseg-days-")
    paths = {}
    for name, df in tables.as_dict().items():
        paths[name] = os.path.join(root, name)
        df.write.parquet(paths[name])
    orders = load_tables(spark, **paths).orders
    base.create(orders, DAYS[0])
    plans = []
    publish = base._publish
    base._publish = lambda state, until: (
        plans.append(state._jdf.queryExecution().executedPlan().toString()), publish(state, until))
    key = "spark.sql.maxMetadataStringLength"
    old = spark.conf.get(key)
    spark.conf.set(key, "5000")
    try:
        base.merge(orders, DAYS[2])
    finally:
        spark.conf.set(key, old)
    scans = [x for x in plans[0].split("\n") if "FileScan" in x and paths["orders"][:20] in x
             and "subtotal" in x]
    assert scans and all("GreaterThanOrEqual(created_at,2024-01-11" in x
                         and "LessThan(created_at,2024-01-20" in x for x in scans)
