"""How the best customers buy: categories, hours, repeat gaps, vouchers and sale days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custseg.functions.exact import dec, div, exact_round
from custseg.functions.labels import day_type
from custseg.operators.ranks import asc
from custseg.operators.scans import numbered
from custseg.params import DEFAULT, Params


def cohort_orders(orders: DataFrame, best_cust: DataFrame) -> DataFrame:
    """Best customers' orders: (order_id, created_at, cust_group, m).

    Every best-customer row (persona) repeats its orders, as the SQL join does; identical copies
    of a (customer, persona) row collapse into the weight ``m`` first.
    """
    personas = best_cust.groupBy("customer_id", "cust_group").agg(F.count(F.lit(1)).alias("m"))
    return (orders.select("order_id", "customer_id", "created_at").join(personas, "customer_id")
            .select("order_id", "created_at", "cust_group", "m"))


def cohort_line_facts(cohort: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """``cohort_orders`` lines summed by (persona, category, order hour, product matched).

    One pass over the order-items fact serves both the category ranking and the hourly GMV:
    orders LEFT JOIN items LEFT JOIN products keeps orders without items and items without a
    product (NULL category, ``matched`` false); the hourly analysis keeps only matched lines,
    which is its inner join. A semi-join first reduces the items to the cohort's orders. With
    ``cohort`` read from a written table it is a broadcast if its size allows, so the items fact is
    not shuffled. Beyond that Spark can put a Bloom filter of the cohort's order ids on the items
    scan (``spark.sql.optimizer.runtime.bloomFilter.*``); it does so only for a side that a
    predicate makes selective, which the condition on the weight is (``m`` is always positive).
    The output is small: personas x categories x 24 x 2.
    """
    wanted = cohort.filter(F.col("m") > 0).select("order_id")
    own = (items.select("order_id", "product_id", "line_total")
           .join(wanted, "order_id", "left_semi"))
    prod = products.select("product_id", "cat1_name", F.lit(True).alias("matched"))
    lines = cohort.join(own, "order_id", "left").join(prod, "product_id", "left")
    return lines.groupBy(
        "cust_group", "cat1_name", F.hour("created_at").cast("long").alias("hour_"),
        F.coalesce(F.col("matched"), F.lit(False)).alias("matched"),
    ).agg(F.sum(F.col("line_total") * F.col("m")).alias("total"))


def persona_category_gmv(facts: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """GMV (whole units) per (persona, category) over best customers' orders, ranked.

    From ``cohort_line_facts``: an order without items, or an item without a product, lands in
    the NULL category. Rank: GMV DESC with NULL first, then category ASC (NULL last) to break
    ties deterministically. ``drop_null_category`` keeps only rows with a known category.
    """
    if params.drop_null_category:
        facts = facts.filter(F.col("cat1_name").isNotNull())
    agg = facts.groupBy("cust_group", "cat1_name").agg(F.sum("total").alias("total"))
    gmv = exact_round(div(F.col("total"), dec(params.money_scale)), 0)
    w = Window.partitionBy("cust_group").orderBy(F.col("gmv").desc_nulls_first(),
                                                 F.col("cat1_name").asc_nulls_last())
    return (agg.select("cust_group", "cat1_name", gmv.alias("gmv"))
            .withColumn("gmv_rank", F.row_number().over(w)))


def top_categories(ranked: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return ranked.filter(F.col("gmv_rank") <= params.top_k)


def hourly_gmv(facts: DataFrame, params: Params = DEFAULT, ranked: bool = False) -> DataFrame:
    """GMV (whole units) of best customers' order lines by hour of the order (<= 24 rows).

    Only lines with an item and a known product count (the inner joins of the analysis).
    """
    out = (facts.filter(F.col("matched")).groupBy("hour_").agg(F.sum("total").alias("total"))
           .select("hour_", exact_round(div(F.col("total"), dec(params.money_scale)), 0)
                   .alias("gmv")))
    if ranked:
        # At most 24 rows: a single-partition window here is bounded by construction.
        w = Window.orderBy(F.col("gmv").desc_nulls_first(), F.col("hour_").asc())
        out = out.withColumn("gmv_rank", F.row_number().over(w))
    return out


def first_two_orders(orders: DataFrame, weights: DataFrame) -> DataFrame:
    """Per best customer: times of the first and second order (by time, NULL last, then order
    id), order count (<= 2) and weight ``m``.

    The limit comes before any shuffle: Spark keeps two orders per customer and task
    (``WindowGroupLimit`` below the exchange), so a customer with a huge share of the orders is two
    rows per task, and only then are the rows of a customer brought together and the best
    customers picked.
    """
    first = Window.partitionBy("customer_id").orderBy(
        F.col("created_at").asc_nulls_last(), F.col("order_id").asc_nulls_last())
    limited = (orders.select("customer_id", "order_id", "created_at")
               .withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= 2))
    pairs = limited.groupBy("customer_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("created_at"))).alias("first_at"),
        F.max(F.when(F.col("rn") == 2, F.col("created_at"))).alias("second_at"),
        F.count(F.lit(1)).alias("n_first"),
    )
    return pairs.join(weights, "customer_id")


def _gap_days(earlier, later, params: Params):
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return exact_round(div(micros, F.lit(86_400_000_000)), params.gap_decimals)


def first_gaps(orders: DataFrame, weights: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Days between a best customer's first and second order, rounded (NULL with one order, or
    if either has no time).

    One row per best customer. A customer listed m >= 2 times among best customers sees each
    order m times in the SQL join, so its "next order" is a copy of the first: gap 0 (NULL if
    the first order has no time).
    """
    pairs = first_two_orders(orders, weights)
    later = F.when(F.col("m") >= 2, F.col("first_at")).otherwise(F.col("second_at"))
    return pairs.select("customer_id",
                        _gap_days(F.col("first_at"), later, params).alias("diff"))


def order_gaps(orders: DataFrame, weights: DataFrame, params: Params = DEFAULT, *,
               written: list | None = None) -> DataFrame:
    """Every order of the best customers with its number and the days to the next one.

    (customer_id, order_id, rn_order, diff): numbers by time (NULL last), then order id; ``diff``
    is rounded and NULL for the last order or where either time is missing. A customer listed m
    times among best customers has each order m times in a row, as the SQL join repeats it: the gap
    between copies is 0. The numbers come from a segmented scan (``scans``), so a customer with
    a third of all orders is spread over many tasks.
    """
    own = (orders.select("customer_id", "order_id", "created_at").join(weights, "customer_id"))
    scan = numbered(own, "customer_id", [asc("created_at"), asc("order_id")], "created_at",
                    partitions=params.rank_partitions, written=written)
    copies = scan.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    later = F.when(F.col("copy") < F.col("m"), F.col("created_at")).otherwise(F.col("next"))
    return copies.select(
        "customer_id", "order_id",
        ((F.col("rn") - 1) * F.col("m") + F.col("copy")).alias("rn_order"),
        _gap_days(F.col("created_at"), later, params).alias("diff"))


def voucher_usage(hub: DataFrame, weights: DataFrame, labelled: bool = False) -> DataFrame:
    """Share of orders using each voucher kind: best customers' orders, and all orders.

    Both rows come from the per-customer counters of the metrics pass (no second scan of the
    orders): the cohort row sums its customers' counters (times m), the other row sums all.
    A kind used by no order gives NULL (SUM over no qualifying row), 4 decimals otherwise.
    Without ``labelled`` the two rows are UNION-ed distinct and carry no label.
    """
    kinds = [("n_platform", "platform_voucher_usage_pct"), ("n_shop", "shop_discount_usage_pct"),
             ("n_shipping", "shipping_discount_usage_pct"),
             ("n_product", "product_voucher_usage_pct")]

    def rates(df: DataFrame, w, label: str) -> DataFrame:
        sums = [F.sum(F.col(c) * w).alias(c) for c, _ in kinds] + [F.sum(F.col("n_ids") * w)
                                                                   .alias("n_ids")]
        cols = [exact_round(div(F.nullif(F.col(c), F.lit(0)), F.col("n_ids")), 4)
                .alias(name) for c, name in kinds]
        if labelled:
            cols = [F.lit(label).alias("cohort")] + cols
        return df.agg(*sums).select(*cols)

    cohort = rates(hub.join(weights, "customer_id"), F.col("m"), "best_customers")
    everyone = rates(hub, F.lit(1), "all_orders")
    both = cohort.unionByName(everyone)
    return both if labelled else both.distinct()


def day_type_performance(orders: DataFrame, weights: DataFrame,
                         params: Params = DEFAULT) -> DataFrame:
    """Per day type of best customers' orders: GMV per active day and per order (whole units)."""
    cohort = orders.select("order_id", "customer_id", "created_at", "order_date_key",
                           "subtotal").join(weights, "customer_id")
    agg = (cohort.groupBy(day_type(F.col("created_at"), params.sale_day).alias("day_type"))
           .agg(F.sum(F.col("subtotal") * F.col("m")).alias("total"),
                F.count_distinct("order_date_key").alias("days"),
                F.sum(F.when(F.col("order_id").isNotNull(), F.col("m"))).alias("n_orders")))
    scale = dec(params.money_scale)
    return agg.select(
        "day_type",
        exact_round(div(F.col("total"), scale * F.col("days")), 0).cast("long").alias("adgmv"),
        exact_round(div(F.col("total"), scale * F.col("n_orders")), 0).cast("long").alias("aov"),
    )
