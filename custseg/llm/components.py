"""Connected components of a link table, by hooking and pointer jumping over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custseg.llm.common import materialize


def _roots(parents: DataFrame) -> DataFrame:
    """(c, p) with every p the root of its tree; ``parents`` has a row for every node."""
    while True:
        up = parents.select(F.col("c").alias("p"), F.col("p").alias("q"))
        parents = materialize(parents.join(up, "p").select("c", F.col("q").alias("p"),
                                                           (F.col("p") != F.col("q"))
                                                           .alias("moved")), "cc-jump")
        if parents.filter("moved").isEmpty():
            return parents.select("c", "p")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(c, p): the smallest node ``p`` of the component of every node ``c`` in ``links`` (a, b).

    ``labels``: components known so far, which are extended. Each round contracts the links to
    links between component roots, hooks every root to its smallest neighbour if that is smaller
    (minima combine before the shuffle, so a node with very many links is one row per task) and
    jumps to the new roots; the tables shrink with the number of components that still grow.
    """
    ends = links.select(F.col("a").alias("c")).unionByName(links.select(F.col("b").alias("c")))
    nodes = ends.distinct().withColumn("p", F.col("c"))
    if labels is not None:
        nodes = labels.unionByName(nodes).groupBy("c").agg(F.min("p").alias("p"))
    labels = materialize(nodes, "cc-labels")
    while True:
        a = labels.select(F.col("c").alias("a"), F.col("p").alias("pa"))
        b = labels.select(F.col("c").alias("b"), F.col("p").alias("pb"))
        links = materialize(
            links.join(a, "a").join(b, "b").filter("pa <> pb")
            .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
            .distinct(), "cc-links")
        if links.isEmpty():
            return labels
        hooks = links.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("p"))
        touched = links.select(F.col("b").alias("c")).distinct().join(hooks, "c", "left_anti")
        forest = _roots(materialize(
            hooks.unionByName(touched.withColumn("p", F.col("c"))), "cc-hooks"))
        up = forest.select(F.col("c").alias("p"), F.col("p").alias("root"))
        labels = materialize(labels.join(up, "p", "left")
                             .select("c", F.coalesce("root", "p").alias("p")), "cc-labels")
