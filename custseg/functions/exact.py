"""Exact decimal arithmetic with explicit rounding.

The original analysis runs on exact numerics: a quotient is exact to many digits and ROUND
rounds half away from zero. Spark keeps DECIMAL exact but trims a quotient's scale to as few
as 6 digits when precision runs out, so every quotient here is formed from a numerator widened
to DECIMAL(38,18), which keeps >= 16 fractional digits for the small-scale denominators used.
Before a ROUND the value passes through DECIMAL(38,10); the oracle does the same, so both
sides round the same 10-digit value (HALF_UP on decimals in both engines).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
WIDE = "decimal(38,18)"
ROUND_BASE = "decimal(38,10)"


def dec(text: str | int | Decimal) -> Column:
    """An exact decimal literal (``dec("27000.0")`` is DECIMAL(6,1), not a double)."""
    return F.lit(Decimal(str(text)))


def div(num: Column, den: Column, *, guard_zero: bool = True) -> Column:
    """Exact quotient ``num / den``.

    ``guard_zero`` turns a zero denominator into NULL (NULLIF); without it Spark's ANSI mode
    raises DIVIDE_BY_ZERO, as the original engine would. A NULL operand gives NULL either way.
    """
    if guard_zero:
        den = F.nullif(den, F.lit(0))
    return num.cast(WIDE) / den


def exact_round(x: Column, digits: int = 0) -> Column:
    """ROUND(x, digits), half away from zero, via the shared DECIMAL(38,10) step."""
    return F.round(x.cast(ROUND_BASE), digits)
