"""RFM quintile scores, segment labels, the customer segment table and segment GMV shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custseg.functions.exact import div, exact_round
from custseg.functions.labels import age_group, rfm_code, segment_label
from custseg.operators.ranks import asc, desc, with_ntiles
from custseg.params import DEFAULT, Params
from custseg.session import materialize

TIE_BREAK = "customer_id"


def score_specs(tie_break: str = TIE_BREAK) -> list[tuple[str, list]]:
    """R: recency DESC (NULLS FIRST), F: frequency ASC, M: monetary ASC (NULLS LAST).

    Ties are broken by the customer id (ASC, NULLS LAST) so that every run and every engine
    assigns the same tiles; any tie order is a legal outcome of the unbroken ordering.
    """
    return [("R", [desc("recency"), asc(tie_break)]),
            ("F", [asc("frequency"), asc(tie_break)]),
            ("M", [asc("monetary"), asc(tie_break)])]


def quantile_scores(hub: DataFrame, *, count: int | None = None, params: Params = DEFAULT,
                    written: list | None = None) -> DataFrame:
    """``hub`` (materialized metrics with recency) plus R, F, M tiles and the 3-digit code.

    Map-only over ``hub``: the tiles come from rank selection (see ``ranks``), not a window.
    """
    out = with_ntiles(hub, score_specs(), params.buckets, count=count, params=params,
                      written=written)
    return out.withColumn("rfm", rfm_code(F.col("R"), F.col("F"), F.col("M")))


HEAVY_ROWS = 10_000         # a dimension id with more rows is spread over several join keys
MOST_HEAVY = 1_000


def repeated_ids(customers: DataFrame, rows: int = HEAVY_ROWS,
                 most: int = MOST_HEAVY) -> tuple[int, list[tuple]]:
    """How many dimension ids are repeated, and (id, number of rows) of those with more than
    ``rows`` rows, at most ``most`` and the most frequent first.

    Counts combine before the shuffle. Ids are expected to be unique, so normally the list is empty.
    """
    counts = (customers.filter(F.col("customer_id").isNotNull()).groupBy("customer_id")
              .agg(F.count(F.lit(1)).alias("n")))
    heavy = F.collect_list(F.when(F.col("n") > rows, F.struct("n", "customer_id")))
    found = counts.agg(F.count_if(F.col("n") > 1), F.slice(F.sort_array(heavy, False), 1, most))
    repeated, top = found.first()
    return repeated, [(r["customer_id"], r["n"]) for r in top]


def _dealt(dim: DataFrame, heavy: DataFrame, written: list | None) -> DataFrame:
    """``dim`` with a salt: the rows of a heavy id are dealt out in turn, others have salt 0.

    Written, since the deal depends on how the rows lie in their tasks. ``again`` is raised for rows
    whose persona attributes the same id has under a smaller salt.
    """
    marked = dim.join(F.broadcast(heavy), "dim_id", "left")
    marked = materialize(marked.withColumn("salt", F.when(
        F.col("salts").isNotNull(),
        F.pmod(F.monotonically_increasing_id(), F.col("salts"))).otherwise(F.lit(0))),
        "dealt", written)
    keys = ["dim_id", "gender", "city", "age_group"]
    least = (marked.filter(F.col("salts").isNotNull()).groupBy(*keys)
             .agg(F.min("salt").alias("least")).withColumnsRenamed({k: f"l_{k}" for k in keys}))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"l_{k}"))
    return (marked.join(least, same, "left")
            .withColumn("later", F.coalesce(F.col("salt") > F.col("least"), F.lit(False)))
            .drop("least", "salts", *[f"l_{k}" for k in keys]))


def segment_rows(scored: DataFrame, customers: DataFrame, as_of_year: int | None,
                 params: Params = DEFAULT, heavy: list[tuple] = (), heavy_rows: int = HEAVY_ROWS,
                 unique: bool = False, written: list | None = None) -> DataFrame:
    """Scored customers LEFT JOIN the customer dimension (one row per dimension match).

    ``customer_id`` is the *dimension's* id: NULL for a scored customer missing from the
    dimension, whose row still carries its rfm code and computed label (and the ELSE age band).
    ``matched`` tells such rows apart; ``metrics_id`` keeps the scored id. Duplicate ids in the
    dimension fan out, as the join does in SQL; ``first_copy`` is 1 for one of the copies that
    share the persona attributes (and 0 for unmatched rows), so that its sum over a persona is
    the number of distinct customers.

    It is found on the dimension's side, by sorting it the way the join sorts it anyway, so the
    customers need no window or exchange of their own. ``heavy`` (see ``repeated_ids``): the rows of
    such an id are dealt over one join key per ``heavy_rows`` rows and its scored customer is
    repeated for each, so no task gets more of one id than that; ``first_copy`` is then the
    least of the dealt parts' firsts. All other ids are joined plainly. ``unique``: no id is
    repeated, so every row is a first one.
    """
    year = F.lit(as_of_year).cast("int")
    band = age_group(year, F.col("birth_year"), params.age_bands, params.age_else)
    # null ids match nothing
    dim = customers.filter(F.col("customer_id").isNotNull()).select(
        F.col("customer_id").alias("dim_id"), "gender", "city", band.alias("age_group"),
        "preferred_device")
    keys = ["dim_id"]
    extra = [c for c in scored.columns if c not in ("customer_id", "R", "F", "M", "rfm")]
    joined_on = scored["customer_id"] == F.col("dim_id")
    if heavy:
        table = scored.sparkSession.createDataFrame(
            [(i, -(-n // heavy_rows)) for i, n in heavy],
            f"dim_id {dict(customers.dtypes)['customer_id']}, salts int")
        dim, keys = _dealt(dim, table, written), ["dim_id", "salt"]
        scored = (scored.join(F.broadcast(table.withColumnRenamed("dim_id", "customer_id")),
                              "customer_id", "left")
                  .withColumn("for_salt", F.explode(F.sequence(
                      F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))))
        joined_on = (scored["customer_id"] == F.col("dim_id")) & (F.col("for_salt") == F.col("salt"))
    if unique:
        dim = dim.withColumn("is_first", F.lit(True))
    else:
        # the same keys as the join: its exchange and sort serve both
        copies = Window.partitionBy(*keys).orderBy("gender", "city", "age_group")
        attributes = F.struct("gender", "city", "age_group")
        dim = (dim.withColumn("before", F.lag(attributes).over(copies))
               .withColumn("is_first", F.coalesce(F.col("before") != attributes, F.lit(True))))
    if heavy:
        dim = dim.withColumn("is_first", F.col("is_first") & ~F.col("later"))
    joined = scored.join(dim, joined_on, "left")
    if heavy:           # a key without rows is no missing customer
        joined = joined.filter(F.col("salts").isNull() | F.col("dim_id").isNotNull())
    r, f, m = F.col("R"), F.col("F"), F.col("M")
    no_band = age_group(year, F.lit(None).cast("int"), params.age_bands, params.age_else)
    return joined.select(
        F.col("dim_id").alias("customer_id"),
        F.col("customer_id").alias("metrics_id"),
        F.col("dim_id").isNotNull().alias("matched"),
        F.when(F.col("is_first"), 1).otherwise(0).alias("first_copy"),
        "gender",
        F.when(F.col("dim_id").isNull(), no_band).otherwise(F.col("age_group")).alias("age_group"),
        "city", "preferred_device", "rfm", "R", "F", "M",
        segment_label(r, f, m, params.segment_rules, params.segment_else).alias("segment"),
        *extra,
    )


def customer_segments(rows: DataFrame) -> DataFrame:
    """The customer segment table: one row per (scored customer x dimension match)."""
    return rows.select("customer_id", "gender", "age_group", "city", "preferred_device", "rfm",
                       F.col("segment").alias("segmentation"))


def joined_view(rows: DataFrame) -> DataFrame:
    """Segment rows as the orders fact sees them through ``orders.customer_id = s.customer_id``.

    A scored customer missing from the dimension matches nothing, so its orders carry NULL for
    every segment attribute. Metrics (monetary, n_orders, counters) stay with the row: they
    are its orders' totals (eager aggregation instead of re-joining the orders fact).
    """
    nulled = {"gender", "age_group", "city", "preferred_device", "rfm", "R", "F", "M", "segment"}
    return rows.selectExpr(*[f"CASE WHEN matched THEN `{c}` END AS `{c}`" if c in nulled
                             else f"`{c}`" for c in rows.columns])


def segment_gmv_share(rows: DataFrame, hub: DataFrame) -> DataFrame:
    """Percent of all GMV by segment, 2 decimals; unmatched customers form the NULL segment.

    The denominator is the GMV of *all* orders (a scalar subquery over the metrics), so shares
    add up to more than 100 only when duplicate dimension rows fan orders out.
    """
    total = hub.agg(F.sum("monetary")).scalar()
    view = joined_view(rows)
    return (view.groupBy("segment").agg(F.sum("monetary").alias("gmv"))
            .select("segment",
                    exact_round(div(F.col("gmv"), total) * F.lit(100), 2)
                    .alias("segment_gmv_pct")))
