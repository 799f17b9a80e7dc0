"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import joined, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that ``links`` (a, b: long) connects each node with.

    Alternating large-star and small-star steps: every node hands its larger neighbours, then its
    smaller ones, to the smallest it knows, until the links are stars. The number of steps grows with the
    logarithm of the longest chain; a step shuffles links only, with minima combined in the map. The
    links of a node that very many share are not brought together.
    """
    links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = stored(joined(both, least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined(large, least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            labels = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
        before = now
