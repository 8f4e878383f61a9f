import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from custseg.session import local_session  # noqa: E402
from custseg.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="custseg-tests")
    yield s


ORDERS_SCHEMA = ("order_id long, customer_id long, created_at timestamp_ntz, order_date_key int, "
                 "subtotal decimal(18,2), platform_voucher decimal(18,2), "
                 "shop_discount decimal(18,2), shipping_discount decimal(18,2)")
ITEMS_SCHEMA = "order_id long, product_id long, line_total decimal(18,4)"
PRODUCTS_SCHEMA = "product_id long, cat1_name string"
CUSTOMERS_SCHEMA = ("customer_id long, gender string, city string, birth_year int, "
                    "preferred_device string")


def order(order_id, customer_id, ts, subtotal="100.00", pv="0", sd=None, sh="0"):
    """An order row; ``ts`` is a datetime or 'YYYY-MM-DD HH:MM:SS'."""
    if isinstance(ts, str):
        ts = dt.datetime.fromisoformat(ts)
    key = ts.year * 10000 + ts.month * 100 + ts.day
    dec = lambda v: None if v is None else Decimal(str(v))
    return (order_id, customer_id, ts, key, dec(subtotal), dec(pv), dec(sd), dec(sh))


def make_tables(spark, orders, customers, items=(), products=()):
    return Tables(
        spark.createDataFrame(list(orders), ORDERS_SCHEMA),
        spark.createDataFrame([(o, p, None if v is None else Decimal(str(v))) for o, p, v in items],
                              ITEMS_SCHEMA),
        spark.createDataFrame(list(products), PRODUCTS_SCHEMA),
        spark.createDataFrame(list(customers), CUSTOMERS_SCHEMA),
    )
