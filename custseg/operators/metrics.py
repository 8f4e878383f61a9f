"""Per-customer recency / frequency / monetary metrics (one pass over the orders fact)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOUCHER_COUNTERS = ("n_ids", "n_platform", "n_shop", "n_shipping", "n_product")


def customer_metrics(orders: DataFrame, *, with_vouchers: bool = False) -> DataFrame:
    """One row per ``customer_id`` (NULL ids form their own row, as GROUP BY does).

    Columns: customer_id, last_date, frequency (distinct order dates), monetary (sum of
    subtotal, NULL when every subtotal is NULL), n_orders (order rows; weights later averages).
    With ``with_vouchers``: n_ids = COUNT(order_id) and the number of orders using each voucher
    kind (used by voucher usage without a second scan of the orders).

    Plan: aggregate by (customer, date) first, then by customer. Both steps combine map-side
    before their shuffle, so a customer holding a large share of all orders is reduced to one
    row per date per map task before it reaches any single reducer.
    """
    order_date = F.to_date("created_at")
    daily = [F.sum("subtotal").alias("s"), F.count(F.lit(1)).alias("n")]
    final = [F.max("order_date").alias("last_date"),
             F.count("order_date").alias("frequency"),
             F.sum("s").alias("monetary"),
             F.sum("n").alias("n_orders")]
    if with_vouchers:
        pv, sd, sh = F.col("platform_voucher"), F.col("shop_discount"), F.col("shipping_discount")
        daily += [F.count("order_id").alias("n_ids"),
                  F.count_if(pv > 0).alias("n_platform"),
                  F.count_if(sd > 0).alias("n_shop"),
                  F.count_if(sh > 0).alias("n_shipping"),
                  F.count_if((pv > 0) | (sd > 0)).alias("n_product")]
        final += [F.sum(c).alias(c) for c in VOUCHER_COUNTERS]
    return (orders.groupBy("customer_id", order_date.alias("order_date")).agg(*daily)
            .groupBy("customer_id").agg(*final))


def with_recency(metrics: DataFrame, as_of: _dt.date | None) -> DataFrame:
    """recency = as-of date - last order date, in whole days."""
    return metrics.withColumn("recency", F.datediff(F.lit(as_of).cast("date"), F.col("last_date")))
