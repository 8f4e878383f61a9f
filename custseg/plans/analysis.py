"""The analyses as one object that materializes the shared customer hub once.

``CustomerAnalysis(tables, params)`` exposes the eight analyses (customer segments, segment
GMV share, persona scores, top categories, hourly GMV, repeat-purchase gap statistics, voucher
usage, sale-day performance) and their intermediate stages. Public outputs have explicit
types: counts and whole-unit money as BIGINT, other money and rounded ratios as exact DECIMAL.

Physical shape: the orders fact is aggregated to one row per customer (two partial-aggregate
shuffles), written once under the checkpoint folder, and every later stage reads that hub
(customer grain) instead of the fact. Only the behaviour analyses that need order lines or
order timestamps read the facts again, and only joined to the best-customer weights.

A stage is written only if it is read more than once: the hub and, with ``shared=True``, the segment
rows, best customers and line facts that several analyses read.
"""

from __future__ import annotations

import warnings
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custseg.operators import behavior, metrics, personas, segments
from custseg.operators.quantiles import is_picked, midpoint_frame, midpoint_picks
from custseg.functions.exact import exact_round
from custseg.params import DEFAULT, Params
from custseg.session import delete_path, materialize, materialize_observed
from custseg.sources.base import CustomerBase
from custseg.sources.tables import Tables


def _windowed(tables: Tables, p: Params) -> Tables:
    """Restrict the orders fact to the optional analysis window (all orders by default)."""
    if p.orders_from is None and p.orders_until is None:
        return tables
    orders = tables.orders
    if p.orders_from is not None:
        orders = orders.filter(F.col("created_at") >= F.lit(p.orders_from).cast("timestamp_ntz"))
    if p.orders_until is not None:
        orders = orders.filter(F.col("created_at") < F.lit(p.orders_until).cast("timestamp_ntz"))
    return Tables(orders, tables.order_items, tables.products, tables.customers)


class CustomerAnalysis:
    def __init__(self, tables: Tables, params: Params = DEFAULT, *, with_vouchers: bool = False,
                 shared: bool = False, base: CustomerBase | None = None):
        """``shared``: several analyses will be asked for, so write the stages they have in common.

        ``base``: a kept customer base whose metrics take the place of the pass over the orders; it
        must cover the orders of ``tables``, and no time window may be set."""
        if base is not None and (params.orders_from, params.orders_until) != (None, None):
            raise ValueError("a customer base covers all its orders: no time window can be set")
        self.base = base
        self.source = tables
        self.t = _windowed(tables, params)
        self.p = params
        self.with_vouchers = with_vouchers
        self.shared = shared
        self._written: list[str] = []          # folders this analysis wrote, for release()

    def with_params(self, params: Params) -> "CustomerAnalysis":
        """An analysis with other parameters that reads this one's hub, and its segment rows if
        they depend on none of the changed ones. Only this analysis releases what it wrote."""
        other = CustomerAnalysis(self.source, params, with_vouchers=self.with_vouchers,
                                 shared=self.shared, base=self.base)
        if (params.orders_from, params.orders_until) == (self.p.orders_from, self.p.orders_until):
            other._hub = self._hub
            rules = ("buckets", "segment_rules", "segment_else", "age_bands", "age_else",
                     "heavy_rows")
            if all(getattr(params, r) == getattr(self.p, r) for r in rules):
                if all(getattr(params, r) == getattr(self.p, r)
                       for r in ("rank_rows", "rank_partitions")):
                    other.scored, other.rows = self.scored, self.rows
        return other

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name, self._written)

    # -- hub ---------------------------------------------------------------------------------
    @cached_property
    def _hub(self) -> tuple[DataFrame, dict]:
        if self.base is not None:
            return self.base.metrics()
        # The customer count and the as-of date are observed while the hub is written.
        return materialize_observed(
            metrics.customer_metrics(self.t.orders, with_vouchers=self.with_vouchers), "metrics",
            self._written, n=F.count(F.lit(1)), as_of=F.max("last_date"))

    @property
    def _raw_hub(self) -> DataFrame:
        return self._hub[0]

    @property
    def _as_of_count(self):
        return self._hub[1]["as_of"], self._hub[1]["n"]

    @cached_property
    def as_of(self):
        return self._as_of_count[0]

    @cached_property
    def hub(self) -> DataFrame:
        return metrics.with_recency(self._raw_hub, self.as_of)

    @cached_property
    def n_customers(self) -> int:
        return self._as_of_count[1]

    @cached_property
    def scored(self) -> DataFrame:
        return segments.quantile_scores(self.hub, count=self.n_customers, params=self.p,
                                        written=self._written)

    @cached_property
    def _repeated(self) -> tuple[int, list[tuple]]:
        """Repeated dimension ids; they are reported, since joins fan out as in SQL."""
        found = segments.repeated_ids(self.t.customers, self.p.heavy_rows)
        if found[0]:
            warnings.warn(f"customers.customer_id is not unique: {found[0]} ids are repeated and "
                          "joins will fan out", stacklevel=2)
        return found

    @cached_property
    def rows(self) -> DataFrame:
        spark = self.source.orders.sparkSession
        with ThreadPoolExecutor(1) as pool:         # meanwhile the hub is written and ranked
            counted = pool.submit(inheritable_thread_target(spark)(lambda: self._repeated))
            scored = self.scored
            repeated, heavy = counted.result()
        year = self.as_of.year if self.as_of is not None else None
        rows = segments.segment_rows(scored, self.t.customers, year, self.p, heavy,
                                     self.p.heavy_rows, not repeated, self._written)
        return self._write(rows, "segments") if self.shared else rows

    # -- Q1, Q2 ------------------------------------------------------------------------------
    def as_of_frame(self) -> DataFrame:
        return self._raw_hub.agg(F.max("last_date").alias("as_of_date"))

    def customer_metrics(self) -> DataFrame:
        return self.hub.select(
            "customer_id", F.col("recency").cast("long").alias("recency"), "frequency",
            "monetary", "n_orders")

    def quantile_scores(self) -> DataFrame:
        return self.scored.select("customer_id", *[F.col(c).cast("long").alias(c) for c in "RFM"],
                                  "rfm")

    def segment_labels(self) -> DataFrame:
        """One label per scored customer (before any dimension join)."""
        from custseg.functions.labels import segment_label
        s = self.scored
        return s.select("customer_id", *[F.col(c).cast("long").alias(c) for c in "RFM"],
                        segment_label(F.col("R"), F.col("F"), F.col("M"), self.p.segment_rules,
                                      self.p.segment_else).alias("segment"))

    def age_bands(self) -> DataFrame:
        from custseg.functions.labels import age_group
        year = F.lit(self.as_of.year if self.as_of else None).cast("int")
        return self.t.customers.select(
            "customer_id", "birth_year",
            age_group(year, F.col("birth_year"), self.p.age_bands, self.p.age_else)
            .alias("age_group"))

    def customer_segments(self) -> DataFrame:
        return segments.customer_segments(self.rows)

    def segment_gmv_share(self) -> DataFrame:
        return segments.segment_gmv_share(self.rows, self.hub)

    # -- Q3 ----------------------------------------------------------------------------------
    @cached_property
    def groups(self) -> DataFrame:
        # a few rows, which bounds, scores and best personas read; read from files, their size
        # decides the join of the best personas to the customers
        return self._write(personas.persona_groups(self.rows, self.p), "personas")

    @cached_property
    def scores(self) -> DataFrame:
        return personas.persona_scores(self.groups, self.p)

    def persona_groups(self) -> DataFrame:
        g = self.groups
        return g.select("gender", "city", "age_group", "customers",
                        F.col("gmv").cast("long").alias("gmv"),
                        *"RFM")

    def persona_bounds(self) -> DataFrame:
        b = personas.persona_bounds(self.groups)
        return b.select(*[F.col(c).cast("long").alias(c) if c.endswith("gmv") else c
                          for c in b.columns])

    def persona_scores(self) -> DataFrame:
        s = self.scores
        out = s.select("city", "gender", "age_group", "customers",
                       F.col("gmv").cast("long").alias("gmv"),
                       "score_R", "score_F", "score_M", "score_GMV", "final_persona_score")
        return out.orderBy(F.col("final_persona_score").desc_nulls_first(), "city", "gender",
                           "age_group")

    def best_personas(self) -> DataFrame:
        return personas.best_personas(self.scores, self.p)

    @cached_property
    def best_cust(self) -> DataFrame:
        best = personas.best_customers(self.rows, self.best_personas())
        return self._write(best, "best") if self.shared else best

    def best_customers(self) -> DataFrame:
        return self.best_cust

    @cached_property
    def weights(self) -> DataFrame:
        return personas.best_customer_weights(self.best_cust)

    # -- Q4 - Q8 -----------------------------------------------------------------------------
    @cached_property
    def line_facts(self) -> DataFrame:
        cohort = self._write(behavior.cohort_orders(self.t.orders, self.best_cust), "cohort")
        facts = behavior.cohort_line_facts(cohort, self.t.order_items, self.t.products)
        return self._write(facts, "lines") if self.shared else facts

    def persona_category_gmv(self) -> DataFrame:
        r = behavior.persona_category_gmv(self.line_facts, self.p)
        return r.select("cust_group", "cat1_name", F.col("gmv").cast("long").alias("gmv"),
                        F.col("gmv_rank").cast("long").alias("gmv_rank"))

    def top_categories(self) -> DataFrame:
        return behavior.top_categories(self.persona_category_gmv(), self.p)

    def hourly_gmv(self, ranked: bool = False) -> DataFrame:
        h = behavior.hourly_gmv(self.line_facts, self.p, ranked=ranked)
        cols = ["hour_", F.col("gmv").cast("long").alias("gmv")]
        if ranked:
            cols.append(F.col("gmv_rank").cast("long").alias("gmv_rank"))
        return h.select(*cols)

    @cached_property
    def gaps(self) -> DataFrame:
        gaps, self._gap_stats = materialize_observed(
            behavior.first_gaps(self.t.orders, self.weights, self.p), "gaps", self._written,
            n=F.count(F.lit(1)))
        return gaps

    @cached_property
    def n_gaps(self) -> int:
        self.gaps
        return self._gap_stats["n"]

    def first_gap(self) -> DataFrame:
        return self.gaps.select("customer_id", "diff")

    @cached_property
    def _order_gaps(self) -> DataFrame:
        return behavior.order_gaps(self.t.orders, self.weights, self.p, written=self._written)

    def order_gaps(self) -> DataFrame:
        """Every order of the best customers: its number and the days to the next one."""
        return self._order_gaps

    def _picks(self):
        return midpoint_picks(self.gaps, "diff", "customer_id", self.p.quantile_fractions,
                              count=self.n_gaps, params=self.p, written=self._written)

    def midpoint_quantiles(self) -> DataFrame:
        """One row per fraction: exact position and the midpoint value (5 decimals)."""
        q = midpoint_frame(self.gaps, "diff", "customer_id", self.p.quantile_fractions,
                           count=self.n_gaps, params=self.p, written=self._written)
        return q.select("fraction", "position", exact_round(F.col("value"), 5).alias("value"))

    def repeat_gap_stats(self) -> DataFrame:
        """min/max (4 dp), avg/q1/median/q3 (2 dp) of the first-to-second order gap.

        One aggregation over the gap table; each quantile is AVG(diff) over the rows picked at
        its floor/ceil ranks (NULL gaps are ignored by AVG, as the positions count them).
        """
        picks = self._picks()
        names = dict(zip(self.p.quantile_fractions, ("q1_diff", "median_diff", "q3_diff")))
        quantiles = []
        for f, name in names.items():
            keys = picks[f][1] if f in picks else []
            avg = F.avg(F.when(is_picked("diff", "customer_id", keys), F.col("diff")))
            quantiles.append(exact_round(avg, 2).alias(name))
        return self.gaps.agg(
            F.min("diff").alias("min_diff"),
            F.max("diff").alias("max_diff"),
            exact_round(F.avg("diff"), 2).alias("avg_diff"),
            *quantiles,
        )

    def voucher_usage(self, labelled: bool = False) -> DataFrame:
        if not self.with_vouchers and self.base is None:
            raise ValueError("build the analysis with with_vouchers=True for voucher usage")
        return behavior.voucher_usage(self.hub, self.weights, labelled=labelled)

    def day_type_performance(self) -> DataFrame:
        return behavior.day_type_performance(self.t.orders, self.weights, self.p)

    # -- all eight analyses off one hub ------------------------------------------------------
    def report(self) -> dict[str, DataFrame]:
        """The eight analyses, in order. Build with ``with_vouchers=True, shared=True`` so the
        hub, segment rows, best customers and line facts are each computed once for all."""
        return {
            "customer_segments": self.customer_segments(),
            "segment_gmv_share": self.segment_gmv_share(),
            "persona_scores": self.persona_scores(),
            "top_categories": self.top_categories(),
            "hourly_gmv": self.hourly_gmv(),
            "repeat_gap_stats": self.repeat_gap_stats(),
            "voucher_usage": self.voucher_usage(),
            "day_type_performance": self.day_type_performance(),
        }

    # -- sink and cleanup --------------------------------------------------------------------
    def save_customer_segments(self, target: str, *, fmt: str = "parquet",
                               mode: str = "overwrite", buckets: int | None = None) -> None:
        """Write the customer segment table to a path (contains '/') or a catalog table.

        ``buckets``: lay a catalog table out by customer id, so that later joins on it need no
        exchange of the table."""
        out = self.customer_segments()
        if buckets:
            if "/" in target:
                raise ValueError("only catalog tables can be bucketed")
            out = out.repartition(buckets, "customer_id")
        writer = out.write.mode(mode).format(fmt)
        if buckets:
            writer = writer.bucketBy(buckets, "customer_id").sortBy("customer_id")
        if "/" in target:
            writer.save(target)
        else:
            writer.saveAsTable(target)

    def release(self) -> int:
        """Delete exactly the folders this analysis wrote under the checkpoint folder; it and
        analyses derived from it can't be used afterwards."""
        spark = self.source.orders.sparkSession
        gone = sum(bool(delete_path(spark, path)) for path in self._written)
        self._written.clear()
        return gone
