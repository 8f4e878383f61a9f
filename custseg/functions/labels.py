"""Label expressions: segment rules, age bands, RFM code and day types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from custseg.params import DEFAULT_AGE_BANDS, DEFAULT_AGE_ELSE, DEFAULT_SEGMENT_ELSE, \
    DEFAULT_SEGMENT_RULES

_OPS = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    ">=": lambda c, v: c >= v,
    ">": lambda c, v: c > v,
}


def _cond(col: Column, spec) -> Column | None:
    if spec is None:
        return None
    op, value = spec
    return _OPS[op](col, F.lit(value))


def segment_label(r: Column, f: Column, m: Column, rules=DEFAULT_SEGMENT_RULES,
                  otherwise: str = DEFAULT_SEGMENT_ELSE) -> Column:
    """Ordered rule table -> label; the first rule whose conditions all hold wins."""
    expr = None
    for label, rc, fc, mc in rules:
        parts = [c for c in (_cond(r, rc), _cond(f, fc), _cond(m, mc)) if c is not None]
        cond = parts[0]
        for p in parts[1:]:
            cond = cond & p
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(otherwise) if expr is None else expr.otherwise(F.lit(otherwise))


def age_group(as_of_year: Column, birth_year: Column, bands=DEFAULT_AGE_BANDS,
              otherwise: str = DEFAULT_AGE_ELSE) -> Column:
    """Age band of ``as_of_year - birth_year`` (a year difference, not an exact birthday).

    An unknown birth year fails every comparison and lands in the ELSE band.
    """
    age = as_of_year - birth_year
    expr = None
    for op, bound, label in bands:
        cond = _OPS[op](age, F.lit(bound))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(otherwise) if expr is None else expr.otherwise(F.lit(otherwise))


def rfm_code(r: Column, f: Column, m: Column) -> Column:
    """Three-digit code such as '543' (inputs are never NULL, so CONCAT is safe)."""
    return F.concat(r.cast("string"), f.cast("string"), m.cast("string"))


def day_type(ts: Column, sale_day: int = 25) -> Column:
    """'Double Day' when day == month, 'EOM Sale Day' on ``sale_day``, else 'Normal Day'."""
    day = F.dayofmonth(ts)
    return (F.when(day == F.month(ts), F.lit("Double Day"))
            .when(day == F.lit(sale_day), F.lit("EOM Sale Day"))
            .otherwise(F.lit("Normal Day")))
