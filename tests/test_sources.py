"""Source binding and the logical schema contract."""

import os
import tempfile

import pytest

from custseg.sources.tables import (Tables, bind_testdata, check_contract, load_tables,
                                    warn_duplicate_customers)

SF = "/root/testdata/sf0.001"


def test_binding_meets_contract(spark):
    t = bind_testdata(spark, SF)
    types = dict(t.orders.dtypes)
    assert types["created_at"] == "timestamp_ntz"
    assert types["subtotal"] == "decimal(18,2)"
    assert dict(t.order_items.dtypes)["line_total"] == "decimal(18,4)"
    assert t.orders.filter("hour(created_at) <> 0").count() > 0        # a time of day exists


def test_contract_rejects_floating_money_and_missing_columns(spark):
    t = bind_testdata(spark, SF)
    bad_orders = t.orders.withColumn("subtotal", t.orders.subtotal.cast("double")).drop("shop_discount")
    with pytest.raises(ValueError) as err:
        check_contract(Tables(bad_orders, t.order_items, t.products, t.customers))
    assert "orders.subtotal has type double" in str(err.value)
    assert "orders.shop_discount is missing" in str(err.value)


def test_load_tables_from_paths(spark):
    t = bind_testdata(spark, SF)
    root = tempfile.mkdtemp(prefix="custseg-logical-")
    paths = {}
    for name, df in t.as_dict().items():
        paths[name] = os.path.join(root, name)
        df.write.parquet(paths[name])
    loaded = load_tables(spark, **paths)
    assert loaded.orders.count() == t.orders.count()
    assert loaded.customers.columns == t.customers.columns


def test_duplicate_customer_ids_warn(spark):
    t = bind_testdata(spark, SF)
    assert warn_duplicate_customers(t) == 0
    doubled = Tables(t.orders, t.order_items, t.products, t.customers.unionByName(t.customers))
    with pytest.warns(UserWarning, match="not unique"):
        assert warn_duplicate_customers(doubled) == 1


def test_zoned_timestamps_are_rejected_or_converted(spark):
    t = bind_testdata(spark, SF)
    zoned = Tables(t.orders.withColumn("created_at", t.orders.created_at.cast("timestamp")),
                   t.order_items, t.products, t.customers)
    with pytest.raises(ValueError, match="orders.created_at has type timestamp"):
        check_contract(zoned)
    root = tempfile.mkdtemp(prefix="custseg-zoned-")
    paths = {}
    for name, df in zoned.as_dict().items():
        paths[name] = os.path.join(root, name)
        df.write.parquet(paths[name])
    old = spark.conf.get("spark.sql.session.timeZone")
    seen = []
    try:
        for session_zone in ("UTC", "Asia/Ho_Chi_Minh", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session_zone)
            orders = load_tables(spark, **paths, zone="Asia/Ho_Chi_Minh").orders
            seen.append(orders.selectExpr("sum(hour(created_at))").first()[0])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert len(set(seen)) == 1
