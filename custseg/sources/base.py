"""A customer base that is kept between runs: laid out once by customer, merged with new days.

The base is a catalog table of per-customer state, bucketed and sorted by ``customer_id``, so joins
on the customer id (to the dimension, to the orders) need no exchange of the base. The state of a
customer is mergeable and exact: the set of order days, sums and counts. A set of days is bounded
by the calendar, however many orders a customer has. Merging the state of new days gives what
all orders together give, and reads the orders fact for the new days only (the day range is a
filter on the scan).

Every merge writes a new version of the table beside the old one; the view ``name`` is then
switched to it, so readers see the old or the new state and never a part of either, and a merge
that fails changes nothing. The orders covered, the customer count and the last order day are
table properties, observed while the version is written.

Orders without a time belong to no day: ``create`` counts them, ``merge`` can't see new ones.
Orders that arrive for days already merged need a new ``create``. A null customer id is a
customer like any other, as in the analyses.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from custseg.operators.metrics import VOUCHER_COUNTERS
from custseg.session import checkpoint_dir, delete_path

_SUMS = ("monetary", "n_orders", *VOUCHER_COUNTERS)


def customer_state(orders: DataFrame) -> DataFrame:
    """Mergeable state per customer: days (sorted, distinct), monetary, n_orders and the voucher
    counters. Aggregated by (customer, day) first, so a hot customer is one row per day and task."""
    pv, sd, sh = F.col("platform_voucher"), F.col("shop_discount"), F.col("shipping_discount")
    daily = orders.groupBy("customer_id", F.to_date("created_at").alias("day")).agg(
        F.sum("subtotal").alias("monetary"), F.count(F.lit(1)).alias("n_orders"),
        F.count("order_id").alias("n_ids"), F.count_if(pv > 0).alias("n_platform"),
        F.count_if(sd > 0).alias("n_shop"), F.count_if(sh > 0).alias("n_shipping"),
        F.count_if((pv > 0) | (sd > 0)).alias("n_product"))
    return daily.groupBy("customer_id").agg(
        F.sort_array(F.collect_list("day")).alias("days"),
        *[F.sum(c).alias(c) for c in _SUMS])


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The state of both sets of orders, which must not share an order.

    A join on plain equality, which the layout of the base serves; the one row that each side may
    have for a null customer id is merged apart."""
    none = F.array().cast("array<date>")

    def plus(a, b, kind):
        # a missing side adds nothing; two missing sums stay missing
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b).cast(kind)

    known = F.col("customer_id").isNotNull()
    o, n = old.filter(known).alias("o"), new.filter(known).alias("n")
    both = o.join(n, F.col("o.customer_id") == F.col("n.customer_id"), "full").select(
        F.coalesce("o.customer_id", "n.customer_id").alias("customer_id"),
        F.sort_array(F.array_union(F.coalesce("o.days", none), F.coalesce("n.days", none)))
        .alias("days"),
        *[plus(F.col(f"o.{c}"), F.col(f"n.{c}"), old.schema[c].dataType).alias(c) for c in _SUMS])
    nobody = (old.filter(~known).unionByName(new.filter(~known)).groupBy("customer_id")
              .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("days")))).alias("days"),
                   *[F.sum(c).cast(old.schema[c].dataType).alias(c) for c in _SUMS]))
    return both.unionByName(nobody)


def state_metrics(state: DataFrame) -> DataFrame:
    """``operators.metrics.customer_metrics`` (voucher counters included) from the state."""
    size = F.size("days")
    return state.select(
        "customer_id", F.when(size > 0, F.element_at("days", -1)).alias("last_date"),
        size.cast("long").alias("frequency"), *_SUMS)


class CustomerBase:
    """The base named ``name`` in the session's catalog.

    ``buckets``: files by customer; choose them so that a bucket of the base and the orders that
    join it fit a task, and no fewer than the shuffle partitions of the jobs that read the base, or
    Spark deals the base out again to have as many tasks. ``path``: folder for the versions; by default the shared checkpoint folder.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 16, path: str | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.path = (path or f"{checkpoint_dir(spark)}/custseg-base").rstrip("/")

    # -- versions ----------------------------------------------------------------------------
    def _properties(self) -> dict[str, str]:
        table = self._current()
        return {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}

    def _current(self) -> str:
        return self.spark.sql(f"SHOW TBLPROPERTIES {self.name} ('custseg.version')").first()["value"]

    def _publish(self, state: DataFrame, until: _dt.date) -> None:
        old = self._current() if self.spark.catalog.tableExists(self.name) else None
        version = f"{self.name}_{uuid.uuid4().hex}"
        seen = Observation("custseg-base")
        observed = state.observe(seen, F.count(F.lit(1)).alias("n"),
                                 F.max(F.when(F.size("days") > 0, F.element_at("days", -1)))
                                 .alias("as_of"))
        (observed.repartition(self.buckets, "customer_id").write
         .bucketBy(self.buckets, "customer_id").sortBy("customer_id")
         .option("path", f"{self.path}/{version}").format("parquet").saveAsTable(version))
        as_of = seen.get["as_of"]
        self.spark.sql(
            f"ALTER TABLE {version} SET TBLPROPERTIES ('custseg.until' = '{until.isoformat()}', "
            f"'custseg.n' = '{seen.get['n']}', 'custseg.as_of' = "
            f"'{as_of.isoformat() if as_of else ''}')")
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} TBLPROPERTIES "
                       f"('custseg.version' = '{version}') AS SELECT * FROM {version}")
        if old:
            self._remove(old)

    def _remove(self, version: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {version}")
        delete_path(self.spark, f"{self.path}/{version}")

    # -- use ---------------------------------------------------------------------------------
    def create(self, orders: DataFrame, until: _dt.date) -> "CustomerBase":
        """The base of all orders before the day ``until`` (and of those without a time)."""
        at = F.col("created_at")
        self._publish(customer_state(orders.filter(at.isNull() | (at < F.lit(until).cast(
            "timestamp_ntz")))), until)
        return self

    def merge(self, orders: DataFrame, until: _dt.date) -> "CustomerBase":
        """Adds the orders of the days from the last ``until`` to before this one."""
        if until < self.until:
            raise ValueError(f"{self.name} already holds the orders before {self.until}")
        at = F.col("created_at")
        new = orders.filter((at >= F.lit(self.until).cast("timestamp_ntz"))
                            & (at < F.lit(until).cast("timestamp_ntz")))
        self._publish(merged(self.state(), customer_state(new)), until)
        return self

    @property
    def until(self) -> _dt.date:
        """The first day whose orders are not in the base."""
        return _dt.date.fromisoformat(self._properties()["custseg.until"])

    def state(self) -> DataFrame:
        return self.spark.table(self.name)

    def metrics(self) -> tuple[DataFrame, dict]:
        """Customer metrics with their count and as-of date, as the analyses' hub has them."""
        p = self._properties()
        as_of = p["custseg.as_of"]
        return state_metrics(self.state()), {
            "n": int(p["custseg.n"]), "as_of": _dt.date.fromisoformat(as_of) if as_of else None}

    def drop(self) -> None:
        """Removes the view, its table and their files."""
        if self.spark.catalog.tableExists(self.name):
            version = self._current()
            self.spark.sql(f"DROP VIEW {self.name}")
            self._remove(version)
