"""Midpoint quantiles: the average of the rows at floor/ceil of position 1 + p(n - 1).

For sorted values (NULLs last, still counted in n) the p-quantile averages the values at the
floor and ceiling of ``(1 - p) * 1 + p * n`` (one row when the position is whole); NULL values
are ignored by the average. This differs from linear interpolation (``percentile``) and from
``percentile_approx``. The rows at those ranks come from distributed rank selection.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custseg.operators.ranks import SortKey, select_ranks, sql_literal
from custseg.params import DEFAULT, Params


def midpoint_positions(n: int, fraction: str | Fraction) -> tuple[Fraction, list[int]]:
    """Exact position and the distinct ranks (floor, ceil) it averages."""
    p = Fraction(str(fraction)) if not isinstance(fraction, Fraction) else fraction
    pos = (1 - p) * 1 + p * n
    ranks = sorted({math.floor(pos), math.ceil(pos)})
    return pos, ranks


def midpoint_picks(df: DataFrame, value: str, tie_break: str, fractions, *,
                   count: int | None = None, params: Params = DEFAULT,
                   written: list | None = None) -> dict:
    """fraction -> (position, [key tuples of the rows to average]), order: value ASC NULLS
    LAST then ``tie_break``. ``df`` should be materialized; the rows come from rank selection.
    """
    n = df.count() if count is None else count
    plan = {f: midpoint_positions(n, f) for f in fractions} if n else {}
    wanted = sorted({r for _, ranks in plan.values() for r in ranks})
    picked = select_ranks(df, [SortKey(value, True, False), SortKey(tie_break, True, False)],
                          wanted, count=n, params=params, written=written)
    return {f: (pos, [picked[r] for r in ranks]) for f, (pos, ranks) in plan.items()}


def is_picked(value: str, tie_break: str, keys: list[tuple]) -> Column:
    """Row predicate: the row is one of the picked rows (null-safe equality on both keys)."""
    if not keys:
        return F.lit(False)
    tests = [f"(`{value}` <=> {'NULL' if t[1] is None else sql_literal(t[1])} AND "
             f"`{tie_break}` <=> {'NULL' if t[3] is None else sql_literal(t[3])})" for t in keys]
    return F.expr(" OR ".join(tests))


def midpoint_frame(df: DataFrame, value: str, tie_break: str, fractions, *,
                   count: int | None = None, params: Params = DEFAULT,
                   written: list | None = None) -> DataFrame:
    """One row per fraction: fraction, position, and AVG(value) over the picked rows.

    An aggregation over ``df`` itself: each picked row is tagged with the fractions it serves
    (a row can serve several), so the averages are computed by Spark from the data.
    """
    picks = midpoint_picks(df, value, tie_break, fractions, count=count, params=params,
                           written=written)
    if not picks:
        return df.sparkSession.createDataFrame([], "fraction double, position double, value "
                                               + dict(df.dtypes)[value])
    tags = F.array(*[F.when(is_picked(value, tie_break, keys), F.lit(j))
                     for j, (_, keys) in enumerate(picks.values())])
    fraction = F.lit(None).cast("double")
    position = F.lit(None).cast("double")
    for j, (f, (pos, _)) in enumerate(picks.items()):
        fraction = F.when(F.col("__q") == j, F.lit(float(Fraction(str(f))))).otherwise(fraction)
        position = F.when(F.col("__q") == j, F.lit(float(pos))).otherwise(position)
    tagged = df.select(F.col(value), F.explode(F.array_compact(tags)).alias("__q"))
    return (tagged.groupBy("__q").agg(F.avg(value).alias("value"))
            .select(fraction.alias("fraction"), position.alias("position"), "value"))
