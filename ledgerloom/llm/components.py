"""Distributed connected components by contraction.

Each round every vertex points to its least neighbour, if that is less than itself, and then to what
that one points to. Links become links between the vertices pointed to, and those that have become
loops go. Vertices without a lesser neighbour are at most half of those with links, so the number of
rounds grows with the logarithm of the number of vertices, whatever the diameter; a component's least
vertex never moves, so it ends as the label. A hub is never one task's: least neighbours are summed up
before they are dealt, and joins on a hub are between a unique side and one that Spark can split.

What a round leaves is a written table in the shared folder: read again, its plan has no history. The
tables of the round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import drop_path, shared_path


class _Tables:
    def __init__(self, spark: SparkSession):
        self.spark, self.old = spark, []

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, f"components-{name}")
        df.write.parquet(path)
        self.old.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int) -> None:
        """Delete all but the last ``n`` tables."""
        while len(self.old) > n:
            drop_path(self.spark, self.old.pop(0))


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): (id, component) of every linked vertex; component is the smallest id reachable.

    Repeated links, links in both directions and links of a vertex with itself do no harm. Links are
    written before they are turned round: computed twice, a forest of links may be two forests.
    """
    tables = _Tables(links.sparkSession)
    turned = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = tables.kept(one(links), "links")
    labels = tables.kept(turned(edges).select(F.col("a").alias("id"), F.col("a").alias("component")).distinct(), "labels")
    while not edges.isEmpty():
        least = turned(edges).groupBy("a").agg(F.min("b").alias("near")).select("a", F.least("a", "near").alias("p"))
        least = tables.kept(least, "least")
        to = tables.kept(least.join(least.select(F.col("a").alias("p"), F.col("p").alias("to")), "p").select("a", "to"), "to")
        moved = edges.join(to.withColumnRenamed("to", "a2"), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("b2")), "b")
        edges = tables.kept(one(moved.select(F.col("a2").alias("a"), F.col("b2").alias("b"))), "links")
        labels = labels.join(to.withColumnRenamed("a", "component"), "component", "left")
        labels = tables.kept(labels.select("id", F.coalesce("to", "component").alias("component")), "labels")
        tables.drop(2)
    return labels
