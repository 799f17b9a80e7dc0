"""Half-open valid-time intervals: lookups with gaps, diffs, publishing, timelines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.folds import version_timeline
from plumbline.session import stored


def in_interval(day: Column, start: Column, end: Column) -> Column:
    """start <= day < end; a null bound is open."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (day < end))


def versions_of(changes: DataFrame, key: str, at: str) -> DataFrame:
    """Changes as intervals [valid_from, valid_to): each lasts until the key's next one."""
    w = Window.partitionBy(key).orderBy(at)
    return changes.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))


def as_of(queries: DataFrame, versions: DataFrame, gaps: DataFrame, key: str, day: str, latest: DataFrame | None = None) -> DataFrame:
    """The queries with status found, gap, not_in_force or unknown (and stale after the key's newest
    snapshot). Versions are searched before gaps; a repealed version is not in force.

    ``versions``: key, valid_from, valid_to, repealed and any columns; ``gaps``: key, gap_from,
    gap_to. All sides meet by equi-joins: each distinct (key, day) is answered once, so that equal
    queries get equal answers. A null key is unknown; on a null day nothing is in force.
    """
    asked = queries.select(F.col(key), F.col(day).alias("_day")).distinct()
    hit = asked.join(versions, key).filter(in_interval(F.col("_day"), F.col("valid_from"), F.col("valid_to")))
    first = hit.groupBy(key, "_day").agg(F.min_by(F.struct(*[c for c in versions.columns if c != key]), "valid_from").alias("version"))
    gap = asked.join(gaps, key).filter(in_interval(F.col("_day"), F.col("gap_from"), F.col("gap_to"))).select(key, "_day", F.lit(True).alias("_gap")).distinct()
    known = versions.select(key).unionByName(gaps.select(key)).distinct().withColumn("_known", F.lit(True))
    out = queries.withColumn("_day", F.col(day)).join(first, [key, "_day"], "left").join(gap, [key, "_day"], "left").join(known, key, "left")
    status = F.when(F.col("version.repealed"), "not_in_force").when(F.col("version").isNotNull(), "found").when(F.col("_gap"), "gap").when(F.col("_known"), "not_in_force").otherwise("unknown")
    out = out.withColumn("status", status).drop("_day", "_gap", "_known")
    if latest is not None:
        out = out.join(latest.select(key, "latest_snapshot"), key, "left").withColumn("stale", F.coalesce(F.col(day) > F.col("latest_snapshot"), F.lit(True)))
    return out


def overlapping_neighbours(periods: DataFrame, key: str) -> DataFrame:
    """Pairs of neighbouring periods (by start, then end) of a key that intersect."""
    open_from, open_to = F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")
    p = periods.withColumn("_a", F.coalesce("valid_from", open_from)).withColumn("_b", F.coalesce("valid_to", open_to))
    w = Window.partitionBy(key).orderBy("_a", "_b")
    return p.withColumn("next_from", F.lead("_a").over(w)).filter("next_from < _b").drop("_a", "_b")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, old_value, new_value, kind: added, removed, changed, unchanged."""
    a, b = old.select(key, F.col(value).alias("old_value"), F.lit(True).alias("_o")), new.select(key, F.col(value).alias("new_value"), F.lit(True).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").withColumn("kind", kind).drop("_o", "_n")


def publish(live: DataFrame, wanted: DataFrame, key: str, value: str, at: Column) -> DataFrame:
    """The live table after publishing ``wanted``: same rows stay, others are superseded or inserted.

    live: key, value, recorded_at, superseded_at. Running it twice changes nothing more.
    """
    current = live.filter("superseded_at is null")
    closed = live.filter("superseded_at is not null").select(key, value, "recorded_at", "superseded_at")
    both = current.select(key, F.col(value).alias("_old"), "recorded_at").join(wanted.select(key, F.col(value).alias("_new"), F.lit(True).alias("_w")), key, "full_outer")
    same = F.col("_old").eqNullSafe(F.col("_new")) & F.col("recorded_at").isNotNull() & F.col("_w").isNotNull()
    kept = F.struct(F.col("_old").alias(value), F.col("recorded_at"), F.lit(None).cast("timestamp_ntz").alias("superseded_at"))
    retired = F.struct(F.col("_old").alias(value), F.col("recorded_at"), at.alias("superseded_at"))
    added = F.struct(F.col("_new").alias(value), at.alias("recorded_at"), F.lit(None).cast("timestamp_ntz").alias("superseded_at"))
    rows = F.when(same, F.array(kept)).otherwise(F.filter(F.array(F.when(F.col("recorded_at").isNotNull(), retired), F.when(F.col("_w"), added)), lambda x: x.isNotNull()))
    return closed.unionByName(both.select(key, F.explode(rows).alias("x")).select(key, f"x.{value}", "x.recorded_at", "x.superseded_at"))


def exception_dates(items: DataFrame, acts: DataFrame, exceptions: DataFrame, act: str, part: str) -> DataFrame:
    """items with the day they take effect: an exception for the part wins over the act's own day."""
    e = exceptions.select(act, part, F.col("effective").alias("_e"))
    a = acts.select(act, F.col("effective").alias("_a"))
    out = items.join(a, act, "left").join(e, [act, part], "left")
    basis = F.when(F.col("_e").isNotNull(), "exception").when(F.col("_a").isNotNull(), "act").otherwise("unknown")
    return out.withColumn("effective", F.coalesce("_e", "_a")).withColumn("basis", basis).drop("_e", "_a")


def timeline(snapshots: DataFrame, key: str, tolerance: float = 0.0, ranges: int | None = None) -> DataFrame:
    """Versions and gaps of each key from its texts in dated snapshots (key, snapshot, text; a null
    text means the key is absent from that snapshot), by a fold that can be cut (``version_timeline``).

    A text has changed if more than ``tolerance`` of its words differ from the text that the running
    version holds. Texts are compared word by word in time that grows with the product of their
    lengths where they differ: cut long texts before (into articles, as ``parsing.articles`` does).
    """
    return version_timeline(snapshots, key, lambda held, text: _share_changed(held, text) > tolerance, ranges)


def _share_changed(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    if x == y:
        return 0.0
    import difflib

    same = sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
    return 1 - same / max(len(x), len(y), 1)


def interleaved(versions: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """Versions and gaps of a key by start; a version before a gap on the same day."""
    rows = versions.select(key, F.lit("version").alias("kind"), "valid_from", "valid_to").unionByName(gaps.select(key, F.lit("gap").alias("kind"), "valid_from", "valid_to"))
    w = Window.partitionBy(key).orderBy(F.asc_nulls_first("valid_from"), F.desc("kind"))
    return rows.withColumn("place", F.row_number().over(w))


def chains(versions: DataFrame, node: str, previous: str) -> DataFrame:
    """node, root, depth: each version's place in its chain, of any length.

    Pointer doubling: each round a version jumps to where the one it points to points, so a chain of
    n versions takes log2(n) joins. Versions that reach no root (in or behind a cycle, or behind a
    version that is not there) have no row. ``node`` is a key.
    """
    n, p = F.col(node), F.col(previous)
    rows = versions.filter(n.isNotNull()).select(n.alias("n"), p.alias("p"), F.when(p.isNull(), n).alias("root"), F.when(p.isNull(), 0).otherwise(1).alias("depth"))
    state = stored(rows, "chain")
    done, waiting = state.filter("p is null"), state.filter("p is not null")
    while True:
        onward = done.unionByName(waiting).select(F.col("n").alias("p"), F.col("p").alias("_p"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        moved = stored(waiting.join(onward, "p").select("n", F.col("_p").alias("p"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth")), "chain")
        arrived, waiting = moved.filter("p is null"), moved.filter("p is not null")
        if arrived.isEmpty():
            return done.select(F.col("n").alias(node), "root", "depth")
        done = done.unionByName(arrived)


def days_of_gaps(gaps: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Closed gaps' days and open gaps per key."""
    return gaps.groupBy(*keys).agg(F.sum(F.datediff("gap_to", "gap_from")).alias("gap_days"), F.count_if(F.col("gap_from").isNull()).alias("open_gaps"))
