"""Exact global ranks without a single-task window.

``NTILE(k) OVER (ORDER BY ...)`` and ``ROW_NUMBER() OVER (ORDER BY ...)`` with no PARTITION BY
make Spark move every row into one task (``Exchange SinglePartition``). Here both are reduced
to *rank selection*: find the rows that sit at a handful of global ranks, then decide
everything else with comparisons against those rows.

* NTILE: with n rows and k tiles, tile t ends at rank ``E_t = t*q + min(t, r)`` where
  ``q, r = divmod(n, k)``. A row's tile is ``1 + #{t < k : key > key(E_t)}``. Once the k-1
  boundary keys are known, the tiles are a map-only projection (no shuffle at all).
* Midpoint quantiles need the values at a few ranks, which is the same selection.

Selection (``select_ranks_many``) narrows brackets around the wanted ranks, for all orders (e.g. R, F
and M) together, without moving rows:

1. ``percentile_approx`` over the bracket's rows gives, for each wanted rank, two values that enclose
   it with a margin of the sketch's rank error. Sketches combine before the shuffle.
2. One counting pass makes that exact: rows before the bracket, rows inside. If the target is not
   inside after all, the margin is widened.
3. A bracket of more than ``rank_rows`` rows is narrowed again (each round divides it by several
   hundred); if all its rows share one value, the next sort key takes over inside that value, so
   a value held by 40 % of all rows is no obstacle.
4. Only the rows inside the final brackets are ranked, one bracket at a time in size; one row for
   each wanted rank reaches the driver.

Keys must end in a unique column (the tie-break). A bracket whose key is not numeric, or whose values
a double can't tell apart, can't be narrowed; its rows alone are range-partitioned and sorted
(``sorted_keys``), which ranks any number of rows over many tasks. NULLs are ordered by an explicit
flag per key, so no engine default is involved.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from decimal import Decimal
from math import inf, nextafter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custseg.params import DEFAULT, Params
from custseg.session import materialize


@dataclass(frozen=True)
class SortKey:
    """One ORDER BY item. NULL placement defaults to PostgreSQL's (ASC last, DESC first)."""

    name: str
    ascending: bool = True
    nulls_first: bool | None = None

    @property
    def nulls_go_first(self) -> bool:
        return (not self.ascending) if self.nulls_first is None else self.nulls_first


    def flag(self, value) -> int:
        """Orders NULLs before (0) or after (1) the values."""
        return int((value is None) != self.nulls_go_first)

    def code_sql(self, kind: str) -> str | None:
        """SQL text: the key as a double that never falls along the order; None if it has none."""
        v = _q(self.name)
        if kind.startswith("decimal") or kind in ("tinyint", "smallint", "int", "bigint"):
            code, nan = f"CAST({v} AS DOUBLE)", ""
        elif kind in ("float", "double"):
            code = f"CAST({v} AS DOUBLE)"
            nan = f"WHEN isnan({v}) THEN {sql_literal(inf if self.ascending else -inf)} "
        else:
            return None
        null = sql_literal(-inf if self.nulls_go_first else inf)
        return (f"(CASE WHEN {v} IS NULL THEN {null} {nan}"
                f"ELSE {code if self.ascending else '-' + code} END)")


def asc(name: str, nulls_first: bool | None = None) -> SortKey:
    return SortKey(name, True, nulls_first)


def desc(name: str, nulls_first: bool | None = None) -> SortKey:
    return SortKey(name, False, nulls_first)


def sql_literal(v) -> str:
    """Exact Spark SQL text for a Python value taken from a collected row."""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return f"{v}L"
    if isinstance(v, Decimal):
        return f"{format(v, 'f')}BD"
    if isinstance(v, float):
        text = {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}.get(repr(v), repr(v))
        return f"CAST('{text}' AS DOUBLE)"
    if isinstance(v, _dt.datetime):
        if v.tzinfo is not None:
            raise TypeError("zoned timestamps are not supported as rank keys")
        return f"TIMESTAMP_NTZ'{v.isoformat(sep=' ')}'"
    if isinstance(v, _dt.date):
        return f"DATE'{v.isoformat()}'"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise TypeError(f"unsupported rank key value {v!r}")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Order:
    """A total order over rows, compiled to Spark comparisons against literal key tuples.

    A key tuple is ``(flag_0, value_0, flag_1, value_1, ...)``: ``flag`` puts NULLs first
    (flag 0 for NULL) or last (flag 1 for NULL), ``value`` is the column value. Selection
    sorts a frame holding these columns (``{prefix}f{i}``, ``{prefix}v{i}``).
    """

    def __init__(self, keys: list[SortKey], prefix: str = "__"):
        if not keys:
            raise ValueError("at least one sort key is needed")
        self.keys = list(keys)
        self.width = 2 * len(self.keys)
        self.prefix = prefix
        self.names = [n for i in range(len(self.keys)) for n in (f"{prefix}f{i}", f"{prefix}v{i}")]

    # -- Spark side -------------------------------------------------------------------------
    def _flag_expr(self, i: int) -> Column:
        k = self.keys[i]
        null_flag, value_flag = (0, 1) if k.nulls_go_first else (1, 0)
        return F.when(F.col(k.name).isNull(), F.lit(null_flag)).otherwise(F.lit(value_flag))

    def tuple_exprs(self) -> list[Column]:
        cols = []
        for i, k in enumerate(self.keys):
            cols += [self._flag_expr(i).alias(self.names[2 * i]),
                     F.col(k.name).alias(self.names[2 * i + 1])]
        return cols

    def sort_columns(self) -> list[Column]:
        """Sort order of a frame of ``tuple_exprs`` (flags make NULL placement explicit)."""
        cols = []
        for i, k in enumerate(self.keys):
            v = F.col(self.names[2 * i + 1])
            cols += [F.col(self.names[2 * i]).asc(),
                     v.asc_nulls_last() if k.ascending else v.desc_nulls_last()]
        return cols

    def greater_sql(self, t: tuple) -> str:
        """SQL text: row key > literal key tuple ``t`` (strictly later in this order).

        Built as text so that one expression costs one call into the JVM, however many keys.
        """
        expr = None
        for i in reversed(range(len(self.keys))):
            fl, val, k = t[2 * i], t[2 * i + 1], self.keys[i]
            vcol = _q(k.name)
            null_flag, value_flag = (0, 1) if k.nulls_go_first else (1, 0)
            fcol = f"(CASE WHEN {vcol} IS NULL THEN {null_flag} ELSE {value_flag} END)"
            if val is None:
                gt_i, eq_i = f"{fcol} > {fl}", f"{fcol} = {fl}"
            else:
                lit = sql_literal(val)
                op = ">" if k.ascending else "<"
                gt_i = f"({fcol} > {fl} OR ({fcol} = {fl} AND {vcol} {op} {lit}))"
                eq_i = f"({fcol} = {fl} AND {vcol} = {lit})"
            expr = gt_i if expr is None else f"({gt_i} OR ({eq_i} AND {expr}))"
        return expr

    def equal_sql(self, fixed: tuple) -> str:
        """SQL text: the first keys equal the (flag, value) pairs of ``fixed``."""
        return " AND ".join(
            f"{_q(k.name)} IS NULL" if v is None else f"{_q(k.name)} = {sql_literal(v)}"
            for k, v in zip(self.keys, fixed[1::2]))

    def inside_sql(self, fixed: tuple, code: str | None, low: float, high: float) -> str:
        """SQL text: the first keys equal ``fixed`` and the next key's code is in a range."""
        parts = [self.equal_sql(fixed)] if fixed else []
        if code and (low, high) != (-inf, inf):
            parts.append(f"{code} BETWEEN {sql_literal(low)} AND {sql_literal(high)}")
        return " AND ".join(parts) or "TRUE"

    def row_tuple(self, row) -> tuple:
        return tuple(row[name] for name in self.names)


def select_ranks(df: DataFrame, keys: list[SortKey], ranks, *, count: int | None = None,
                 params: Params = DEFAULT, written: list | None = None) -> dict[int, tuple]:
    """Key tuples (see ``Order``) of the rows at the given 1-based global ranks.

    Ranks outside 1..n are ignored.
    """
    return select_ranks_many(df, [(keys, ranks)], count=count, params=params,
                             written=written)[0]


def sorted_keys(df: DataFrame, orders: list[Order], partitions: int | None = None) -> DataFrame:
    """The keys of every order, range-partitioned and sorted: (__j, __p, __i, keys).

    ``__j``: the order; ``__p``, ``__i``: partition and place in it, ascending in that order.
    """
    out = None
    for j, order in enumerate(orders):
        cols = order.sort_columns()
        part = df.select(*order.tuple_exprs())
        part = (part.repartitionByRange(partitions, *cols) if partitions
                else part.repartitionByRange(*cols))
        kinds = dict(part.dtypes)
        part = part.sortWithinPartitions(*cols).select(
            F.lit(j).alias("__j"), F.spark_partition_id().alias("__p"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__i"), *kinds)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _select_sorted(df: DataFrame, order: Order, wanted: list[int], params: Params,
                   written: list | None) -> dict[int, tuple]:
    """Rank selection by a range partition and sort of all rows of ``df``."""
    keys = materialize(sorted_keys(df, [order], params.rank_partitions), "ranks", written)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the number of partitions
    starts = (keys.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
              .select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    picked = (keys.join(F.broadcast(starts), "__p")
              .withColumn("__rank", F.col("__start") + F.col("__i") + 1)
              .filter(F.col("__rank").isin(wanted)))
    return {r["__rank"]: order.row_tuple(r) for r in picked.collect()}


SKETCH_ACCURACY = 1000          # percentile_approx: rank error of 1/1000 of the rows


@dataclass(frozen=True)
class _Bracket:
    """Rows of an order whose first keys equal ``fixed`` and whose next key's code is in a range.

    The code is the key as a double, so that larger codes come later; rows before ``low`` come
    before all rows inside, those after ``high`` after them.
    """

    order: int
    fixed: tuple = ()
    low: float = -inf
    high: float = inf

    def same_prefix(self, orders: list[Order]) -> str:
        return orders[self.order].equal_sql(self.fixed) or "TRUE"


class _Target:
    """A wanted rank of an order, with what is known about its bracket."""

    def __init__(self, bracket: _Bracket, rank: int, inside: int):
        self.bracket, self.rank = bracket, rank
        self.before, self.inside = 0, inside        # rows before the bracket, rows in it
        self.margin, self.stuck = 2.0, False

    @property
    def place(self) -> int:
        return self.rank - self.before


def _double_text(x: float) -> str:
    return sql_literal(float(x))


def _narrow(df: DataFrame, orders: list[Order], codes: list[list[str | None]],
            targets: list[_Target]) -> None:
    """One round: two sketched bounds for each target, then exact counts."""
    groups: dict[_Bracket, list[_Target]] = {}
    for t in targets:
        groups.setdefault(t.bracket, []).append(t)
    sketches = []
    for i, (bracket, own) in enumerate(groups.items()):
        code = codes[bracket.order][len(bracket.fixed) // 2]
        fractions = []
        for t in own:
            slack = t.margin * t.inside / SKETCH_ACCURACY + 1
            fractions += [max(0.0, (t.place - 1 - slack) / t.inside),
                          min(1.0, (t.place + slack) / t.inside)]
        sketches.append(
            f"percentile_approx({code}, array({', '.join(f'{x!r}D' for x in fractions)}), "
            f"{SKETCH_ACCURACY}) FILTER (WHERE {bracket.same_prefix(orders)} AND {code} BETWEEN "
            f"{_double_text(bracket.low)} AND {_double_text(bracket.high)}) AS b{i}")
    found = df.selectExpr(*sketches).first()

    tries: dict[_Bracket, list[_Target]] = {}
    for i, own in enumerate(groups.values()):
        for k, t in enumerate(own):
            low, high = found[i][2 * k], found[i][2 * k + 1]
            if t.place - 1 <= t.margin * t.inside / SKETCH_ACCURACY + 1:
                low = t.bracket.low
            if t.place + t.margin * t.inside / SKETCH_ACCURACY + 1 >= t.inside:
                high = t.bracket.high
            tries.setdefault(_Bracket(t.bracket.order, t.bracket.fixed, low, high), []).append(t)
    # both ends are counted apart: a value at an end may be held by very many rows
    counts, parts = [], []
    for i, (bracket, own) in enumerate(tries.items()):
        level = len(bracket.fixed) // 2
        code, name = codes[bracket.order][level], _q(orders[bracket.order].keys[level].name)
        prefix = bracket.same_prefix(orders)
        counts.append(f"count_if({prefix} AND {code} >= {_double_text(own[0].bracket.low)} "
                      f"AND {code} < {_double_text(bracket.low)}) AS passed{i}")
        low, high = bracket.low, bracket.high
        ranges = [(low, low)] if low == high else [
            (low, low), (nextafter(low, inf), nextafter(high, -inf)), (high, high)]
        parts.append([_Bracket(bracket.order, bracket.fixed, *r) for r in ranges if r[0] <= r[1]])
        for j, part in enumerate(parts[-1]):
            inside = (f"{prefix} AND {code} BETWEEN {_double_text(part.low)} "
                      f"AND {_double_text(part.high)}")
            counts += [f"count_if({inside}) AS inside{i}_{j}",
                       f"count_if({inside} AND {name} IS NULL) AS nulls{i}_{j}",
                       f"min({name}) FILTER (WHERE {inside}) AS min{i}_{j}",
                       f"max({name}) FILTER (WHERE {inside}) AS max{i}_{j}"]
    row = df.selectExpr(*counts).first()
    for i, own in enumerate(tries.values()):
        for t in own:
            place = t.place - row[f"passed{i}"]
            for j, part in enumerate(parts[i]):
                inside = row[f"inside{i}_{j}"]
                if 1 <= place <= inside:
                    break
                place -= inside
            else:
                t.margin *= 4                       # the sketch missed: try again
                t.stuck = t.margin > SKETCH_ACCURACY
                continue
            t.stuck = part == t.bracket
            t.before, t.inside, t.bracket = t.rank - place, inside, part
            nulls, least, most = (row[f"{x}{i}_{j}"] for x in ("nulls", "min", "max"))
            if nulls == inside or (nulls == 0 and least == most):
                # one value: the next key decides inside it
                key = orders[part.order].keys[len(part.fixed) // 2]
                t.bracket = _Bracket(part.order, (*part.fixed, key.flag(least), least))
                t.stuck = False


def select_ranks_many(df: DataFrame, specs: list[tuple[list[SortKey], list[int]]], *,
                      count: int | None = None, params: Params = DEFAULT,
                      written: list | None = None) -> list[dict[int, tuple]]:
    """Rank selection for several orders over the same rows (``df`` should be materialized)."""
    n = df.count() if count is None else count
    orders = [Order(keys, prefix=f"__s{j}_") for j, (keys, _) in enumerate(specs)]
    kinds = dict(df.dtypes)
    codes = [[k.code_sql(kinds[k.name]) for k in keys] for keys, _ in specs]
    results: list[dict[int, tuple]] = [{} for _ in specs]
    targets = [_Target(_Bracket(j), rank, n) for j, (_, ranks) in enumerate(specs)
               for rank in sorted({int(r) for r in ranks if 1 <= int(r) <= n})]

    def open_ones():
        out = []
        for t in targets:
            level = len(t.bracket.fixed) // 2
            if t.inside > params.rank_rows and not t.stuck:
                if level < len(orders[t.bracket.order].keys) and codes[t.bracket.order][level]:
                    out.append(t)
                else:
                    t.stuck = True
        return out

    while todo := open_ones():
        _narrow(df, orders, codes, todo)

    # rank the rows inside the brackets
    groups: dict[_Bracket, list[_Target]] = {}
    for t in targets:
        groups.setdefault(t.bracket, []).append(t)
    brackets = list(groups)
    inside = [b.same_prefix(orders) if len(b.fixed) == orders[b.order].width else
              orders[b.order].inside_sql(b.fixed, codes[b.order][len(b.fixed) // 2], b.low, b.high)
              for b in brackets]
    ranked = None
    for j, order in enumerate(orders):
        own = [i for i, b in enumerate(brackets)
               if b.order == j and not groups[b][0].inside > params.rank_rows]
        if not own:
            continue
        marks = ", ".join(f"CASE WHEN {inside[i]} THEN {i} END" for i in own)
        rows = (df.select(F.expr(f"explode(array_compact(array({marks})))").alias("__b"),
                          *order.tuple_exprs())
                .withColumn("__rank", F.row_number().over(
                    Window.partitionBy("__b").orderBy(*order.sort_columns()))))
        hit = F.lit(False)
        for i in own:
            places = sorted({t.place for t in groups[brackets[i]]})
            hit = hit | ((F.col("__b") == i) & F.col("__rank").isin(places))
        rows = rows.filter(hit)
        ranked = rows if ranked is None else ranked.unionByName(rows, allowMissingColumns=True)
    for row in ranked.collect() if ranked is not None else []:      # the wanted ranks only
        bracket = brackets[row["__b"]]
        for t in groups[bracket]:
            if t.place == row["__rank"]:
                results[bracket.order][t.rank] = orders[bracket.order].row_tuple(row)
    for i, bracket in enumerate(brackets):
        own = groups[bracket]
        if own[0].inside > params.rank_rows:
            picked = _select_sorted(df.filter(inside[i]), orders[bracket.order],
                                    sorted({t.place for t in own}), params, written)
            for t in own:
                results[bracket.order][t.rank] = picked[t.place]
    return results


def ntile_ends(n: int, k: int) -> list[int]:
    """Last rank of tiles 1..k-1 for NTILE(k) over n rows (standard SQL NTILE)."""
    q, r = divmod(n, k)
    return [t * q + min(t, r) for t in range(1, k)]


def with_ntiles(df: DataFrame, specs: list[tuple[str, list[SortKey]]], k: int, *,
                count: int | None = None, params: Params = DEFAULT,
                written: list | None = None) -> DataFrame:
    """``df`` plus one ``NTILE(k) OVER (ORDER BY keys)`` column per (name, keys) spec.

    Computed without a global window: ``df`` should be materialized (it is read once per order),
    and the result is a narrow projection of it (no shuffle).
    """
    n = df.count() if count is None else count
    if n == 0:
        return df.select("*", *[F.lit(None).cast("int").alias(name) for name, _ in specs])
    ends = [e for e in ntile_ends(n, k) if e >= 1]
    picked = select_ranks_many(df, [(keys, ends) for _, keys in specs], count=n, params=params,
                               written=written)
    cols = []
    for (name, keys), chosen in zip(specs, picked):
        order = Order(keys)
        terms = "".join(f" + CAST({order.greater_sql(chosen[e])} AS INT)"
                        for e in ends)
        cols.append(f"CAST(1{terms} AS INT) AS {_q(name)}")
    return df.selectExpr("*", *cols)


def with_ntile(df: DataFrame, out: str, keys: list[SortKey], k: int, *, count: int | None = None,
               params: Params = DEFAULT) -> DataFrame:
    """``df`` plus ``out = NTILE(k) OVER (ORDER BY keys)`` (see ``with_ntiles``)."""
    return with_ntiles(df, [(out, keys)], k, count=count, params=params)
