"""Analysis parameters. Defaults are the constants of the original analysis."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values that must equal the original analysis for identical results.
# Segment rule table, first match wins. Each rule: label, then the condition on R, F and M
# as (operator, value); None means "no condition".
DEFAULT_SEGMENT_RULES: tuple = (
    ("Champions", (">=", 4), (">=", 4), (">=", 4)),
    ("Loyalists", (">=", 4), (">=", 3), (">=", 3)),
    ("Slipping Loyalists", ("=", 3), (">=", 3), (">=", 3)),
    ("New Customers", (">=", 4), ("<=", 2), None),
    ("Whales", (">=", 3), ("<=", 2), (">=", 4)),
    ("Cannot lose them", ("<=", 2), (">=", 4), (">=", 4)),
    ("Lost", ("<=", 2), ("<=", 2), ("<=", 2)),
)
DEFAULT_SEGMENT_ELSE = "Potential / At Risk"

# Age bands on (as-of year - birth year), first match wins; the last label is the ELSE
# branch (also taken when the birth year is unknown).
DEFAULT_AGE_BANDS: tuple = (
    ("<", 18, "small students (<18)"),
    ("<=", 24, "big students (18-24)"),
    ("<=", 34, "young people (25-34)"),
    ("<=", 44, "middle aged (35-44)"),
)
DEFAULT_AGE_ELSE = "seniors (>44)"


@dataclass(frozen=True)
class Params:
    """All tunables of the analyses (defaults = the original constants)."""

    buckets: int = 5                       # quantile tiles for R, F, M
    money_scale: str = "27000.0"           # GMV divisor (kept as decimal text: exact)
    min_customers: int = 50                # HAVING COUNT(DISTINCT customer) > min_customers
    weight_r: str = "0.1"
    weight_f: str = "0.25"
    weight_m: str = "0.25"
    weight_gmv: str = "0.4"
    best_threshold: str = "0.69"           # best persona: ROUND(score, 2) >= threshold
    top_k: int = 1                         # categories kept per persona
    drop_null_category: bool = False       # True: ignore orders/items without a category
    sale_day: int = 25                     # "EOM Sale Day" day of month
    gap_decimals: int = 4                  # first-to-second order gap precision (days)
    quantile_fractions: tuple[str, ...] = ("0.25", "0.5", "0.75")
    segment_rules: tuple = DEFAULT_SEGMENT_RULES
    segment_else: str = DEFAULT_SEGMENT_ELSE
    age_bands: tuple = DEFAULT_AGE_BANDS
    age_else: str = DEFAULT_AGE_ELSE
    strict_division: bool = False          # True: raise when a min-max range is zero
    # Optional analysis window on order time, [orders_from, orders_until); default: all orders.
    # Given as 'YYYY-MM-DD[ HH:MM:SS]' text; the filter reaches the fact scan (pushdown).
    orders_from: str | None = None
    orders_until: str | None = None
    # Physical knobs (never change results). Rank selection ranks brackets of at most rank_rows rows
    # and narrows larger ones; rank_partitions: range partitions where rows must be sorted, None
    # leaves it to spark.sql.shuffle.partitions and adaptive coalescing.
    # A dimension id with more than heavy_rows rows is dealt over several join keys.
    rank_rows: int = 100_000
    rank_partitions: int | None = None
    heavy_rows: int = 10_000

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()
