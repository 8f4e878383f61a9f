"""Row numbers and next rows inside each key, for keys of any size: a segmented scan.

``ROW_NUMBER() / LEAD() OVER (PARTITION BY key ORDER BY ...)`` sends all rows of a key to one task.
Here the rows are range-partitioned by (key, order) instead, so a key that holds a third of all
rows is cut over many partitions; numbers and next rows are found inside each partition, and what
crosses a border is carried by one row per partition:

1. Range partition and sort by (key, order); partition number and place are kept.
2. Inside a (partition, key) segment: number and next row. Segments are no larger than a
   partition.
3. A partition's carry row holds the first key with its first value, and the last key with its row
   count. Along the partitions in order, the counts of a key that fills several of them add up to
   the offset of its next segment, and the first value of the next partition is the next row of the
   last one before it. This table has one row per partition.
4. The carry rows are joined back by partition number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custseg.operators.ranks import Order, SortKey
from custseg.session import materialize


def numbered(df: DataFrame, key: str, order: list[SortKey], value: str, *,
             partitions: int | None = None, written: list | None = None) -> DataFrame:
    """``df`` plus ``rn`` (row number in ``key`` by ``order``, from 1), ``next`` (``value`` of
    the next row) and ``is_last`` (there is no next row).

    A null key is a key like any other. ``order`` should end in a unique column. ``partitions``:
    range partitions; by default the session's shuffle partitions, coalesced adaptively.
    """
    columns = df.columns
    total = Order([SortKey(key, True, False), *order], prefix="__o")
    keyed = df.select("*", *total.tuple_exprs())
    by = total.sort_columns()
    ranged = (keyed.repartitionByRange(partitions, *by) if partitions
              else keyed.repartitionByRange(*by))
    placed = ranged.sortWithinPartitions(*by).select(
        *columns, F.spark_partition_id().alias("__p"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__i"))
    segment = Window.partitionBy("__p", key).orderBy("__i")
    local = materialize(
        placed.withColumn("__n", F.row_number().over(segment))
        # wrapped, so that a null value differs from no row
        .withColumn("__next", F.lead(F.struct(F.col(value).alias("v"))).over(segment)),
        "scan", written)

    edges = local.groupBy("__p").agg(
        F.min_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), "__i").alias("first"),
        F.max_by(F.struct(F.col(key).alias("k"), F.col("__n").cast("long").alias("n")), "__i")
        .alias("last"))
    along = Window.orderBy("__p")                       # one row per partition
    of_key = Window.partitionBy("last.k").orderBy("__p")
    edges = edges.withColumn("filled", F.sum("last.n").over(of_key))
    before = F.lag(F.struct(F.col("last.k").alias("k"), F.col("filled").alias("n"))).over(along)
    after = F.lead("first").over(along)
    # (null <=> null) holds only where a partition before (after) exists
    carry = edges.select(
        "__p", F.col("first.k").alias("__first"), F.col("last.k").alias("__last"),
        F.when(before.isNotNull() & before["k"].eqNullSafe(F.col("first.k")), before["n"])
        .otherwise(0).alias("__offset"),
        F.when(after.isNotNull() & after["k"].eqNullSafe(F.col("last.k")),
               F.struct(after["v"].alias("v"))).alias("__after"))
    own = F.col(key)
    following = F.coalesce(F.col("__next"),
                           F.when(own.eqNullSafe(F.col("__last")), F.col("__after")))
    return local.join(carry, "__p").select(
        *columns,
        (F.col("__n") + F.when(own.eqNullSafe(F.col("__first")), F.col("__offset")).otherwise(0))
        .alias("rn"),
        following["v"].alias("next"), following.isNull().alias("is_last"))
