"""Chains of versions from proposed links, with the reason of each link that cannot be made.

Links are proposed as (node, previous) and taken in the order of the nodes: a chain neither branches nor
closes. The outcome is that of taking them one by one, found in rounds of joins: of the nodes that name
the same previous one the smallest links; what is left are paths and rings, a ring is opened at its
largest node, and whoever waited for that node's previous one may try in the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import stored

#: Why a link is not made. Fixed values, as users of such records expect them.
SAME, MISSING, TAKEN, CYCLE = "same content as the current file", "no current file of this name", "already the previous version of another file", "would make a cycle"


def _settled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, root, depth of nodes on paths; n, most: the largest node of the ring that each other node is in).

    links: n, p; every node has one row at most as n and as p, p null at a path's end. Pointer doubling: a
    round looks twice as far ahead, so it takes log2 of the longest path and ring.
    """
    end = F.col("p").isNull()
    state = stored(links.select("n", "p", F.when(end, F.col("n")).alias("root"), F.when(end, 0).otherwise(1).cast("long").alias("depth"), F.greatest("n", "p").alias("most")), "links")
    done, waiting = state.filter("p is null"), state.filter("p is not null")
    while True:
        onward = done.unionByName(waiting).select(F.col("n").alias("p"), F.col("p").alias("_p"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("most").alias("_most"))
        moved = waiting.join(onward, "p").select("n", F.col("_p").alias("p"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.greatest("most", "_most").alias("most"), (F.col("_most") > F.col("most")).alias("_grew"))
        moved = stored(moved, "links")
        arrived, waiting, grew = moved.filter("p is null").drop("_grew"), moved.filter("p is not null").drop("_grew"), moved.filter("p is not null and _grew")
        new = not arrived.isEmpty()
        done = done.unionByName(arrived)
        if not new and grew.isEmpty():
            return done.select("n", "root", "depth"), waiting.select("n", "most")


def linked_chains(files: DataFrame, node: str, previous: str) -> DataFrame:
    """node, previous (of the links that are made), root, depth, reason (null where nothing is refused).

    ``node`` is unique; rows without one are left out. A node whose link is refused begins a chain.
    """
    rows = stored(files.filter(F.col(node).isNotNull()).select(F.col(node).cast("long").alias("n"), F.col(previous).cast("long").alias("p")), "links")
    there = rows.select(F.col("n").alias("p"), F.lit(True).alias("_there"))
    judged = rows.join(there, "p", "left").withColumn("reason", F.when(F.col("p") == F.col("n"), SAME).when(F.col("p").isNotNull() & F.col("_there").isNull(), MISSING)).drop("_there")
    judged = stored(judged, "links")
    asked = judged.filter("reason is null and p is not null").select("n", "p")
    opened = asked.select("n").limit(0)
    while True:
        open_now = asked.join(opened, "n", "left_anti")
        made = open_now.groupBy("p").agg(F.min("n").alias("n"))
        links = judged.select("n").join(made.select("n", "p"), "n", "left")
        paths, rings = _settled(links)
        cut = rings.filter("n = most").select("n")
        if cut.isEmpty():
            break
        opened = stored(opened.unionByName(cut), "links")
    out = judged.join(links.withColumnRenamed("p", "_made"), "n").join(paths, "n").join(opened.withColumn("_ring", F.lit(True)), "n", "left")
    reason = F.coalesce("reason", F.when(F.col("p").isNotNull() & F.col("_made").isNull(), F.when(F.col("_ring"), CYCLE).otherwise(TAKEN)))
    return out.select(F.col("n").alias(node), F.col("_made").alias(previous), "root", "depth", reason.alias("reason"))
