"""When a text changed: notes that fall between two snapshots, and the days their acts took effect.

Notes meet the spans between snapshots in a range join on dyadic blocks of days. A span of days is the
union of at most two blocks of each length 1, 2, 4, ...; a day lies in one block of each length. So a
note and a span that holds it share exactly one (key, length, block), the join is an equi-join without
false candidates, and a key with very many notes and spans is spread over as many join keys as it has
blocks. Everything after it is a sum, a minimum or a maximum, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of blocks are powers of two up to that of all days of four-digit years.
LEVELS = 23
_DAY_ONE = "0001-01-01"

#: Why a boundary is not the act's plain day. Fixed values, as users of such records expect them.
UNEXPLAINED, UNKNOWN, MANY, OUTSIDE, PARTIAL, SPLIT, EXCEPTION = "unexplained_change", "yururluk_unknown", "multi_amendment_in_window", "yururluk_outside_window", "partial_entry_into_force", "split_effective_dates", "exception_effective"
BEFORE_FIRST, UNVERIFIED = "before_earliest_snapshot", "start_unverified"


def _number(day: Column) -> Column:
    return F.datediff(day, F.lit(_DAY_ONE).cast("date"))


def _blocks(low: Column, high: Column) -> Column:
    """(level, block) of the dyadic blocks that make up [low, high) in day numbers."""

    def at(level: int) -> Column:
        size = 1 << level
        a, b = F.floor((low + (size - 1)) / size), F.floor(high / size)
        block = lambda x: F.struct(F.lit(level).alias("level"), x.cast("long").alias("block"))
        return F.array(F.when((a < b) & (a % 2 == 1), block(a)), F.when((a < b) & (b % 2 == 1), block(b - 1)))

    return F.filter(F.flatten(F.array(*[at(i) for i in range(LEVELS)])), lambda x: x.isNotNull())


def notes_in_spans(spans: DataFrame, notes: DataFrame, key: str, after: str, until: str, day: str) -> DataFrame:
    """``spans`` joined with the ``notes`` of the same key whose day lies in (after, until].

    Rows with a null key or day meet nothing; a span whose end is not after its start holds nothing.
    """
    cut = spans.withColumn("_b", F.explode(_blocks(_number(F.col(after)) + 1, _number(F.col(until)) + 1)))
    cut = cut.withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    levels = sorted(r[0] for r in cut.select("_level").distinct().collect())  # 23 at most
    if not levels:
        levels = [0]
    lies = F.array(*[F.struct(F.lit(i).alias("level"), F.floor(_number(F.col(day)) / (1 << i)).cast("long").alias("block")) for i in levels])
    spread = notes.filter(F.col(day).isNotNull()).withColumn("_b", F.explode(lies)).withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    return cut.join(spread, [key, "_level", "_block"]).drop("_level", "_block")


def effective_days(cited: DataFrame, acts: DataFrame, exceptions: DataFrame, key: str) -> DataFrame:
    """``cited`` (law, day, key) with ``days``, when the act took effect for the key, and the basis.

    acts: law, day, effective; exceptions: law, day, key, effective, partial. A whole exception takes
    the place of the act's day, a partial one adds its own. Unknown (null) where the act is missing or
    has no day and no whole exception, or where an exception has no day. Basis: act, exception, partial.
    ``acts`` has one row for each law and day; the days of a key's exceptions to one act are few.
    """
    days = lambda c: F.collect_set(F.when(c, F.col("effective")))
    own = exceptions.groupBy("law", "day", key).agg(F.max(F.col("effective").isNull()).alias("_vague"), days(~F.col("partial")).alias("_whole"), days(F.col("partial")).alias("_part"))
    out = cited.join(acts.select("law", "day", F.col("effective").alias("_act"), F.lit(True).alias("_there")), ["law", "day"], "left").join(own, ["law", "day", key], "left")
    whole, part = F.size("_whole") > 0, F.size("_part") > 0
    base = F.when(whole, F.col("_whole")).when(F.col("_act").isNotNull(), F.array("_act"))
    known = F.col("_there") & ~F.coalesce("_vague", F.lit(False)) & base.isNotNull()
    basis = F.when(part, "partial").when(whole, "exception").otherwise("act")
    out = out.withColumns({"days": F.when(known, F.when(part, F.array_union(base, "_part")).otherwise(base)), "basis": F.when(known, basis)})
    return out.drop("_act", "_there", "_vague", "_whole", "_part")


def _warnings(*parts: Column) -> Column:
    return F.concat_ws(",", *parts)


def explained(spans: DataFrame, notes: DataFrame, acts: DataFrame, exceptions: DataFrame, key: str, span: list[str]) -> DataFrame:
    """Each changed span (d_old, d_new] with its boundary: old_to, new_from, gap_from, gap_to, basis, warnings.

    spans: key, d_old, d_new, inferred (whether d_new is a guess) and what identifies a span (``span``,
    which holds the key); notes: key, day, law, foot. Footnotes alone never date a version: they only
    make the boundary more cautious. What cannot be explained stays an explicit gap.
    """
    pairs = notes_in_spans(spans.select(*span, "d_old", "d_new"), notes.select(key, "day", "law", "foot"), key, "d_old", "d_new", "day")
    pairs = pairs.groupBy(*span, "d_old", "day", "law").agg(F.min("foot").alias("foot"))
    dated = effective_days(pairs, acts, exceptions, key)
    noted, foot, unknown = ~F.col("foot"), F.col("foot"), F.col("days").isNull()
    days = F.filter("days", lambda d: noted | (d > F.col("d_old")))  # what a footnote says was so before is in the old text
    pair = F.struct("day", "law")
    facts = dated.groupBy(*span).agg(
        F.count_if(noted).alias("notes"),
        F.count_if(noted & unknown).alias("_unknown"),
        F.count_if(foot & unknown).alias("_foot_unknown"),
        F.count_if(foot & (F.size(days) > 0)).alias("_wider"),
        F.min(F.array_min(days)).alias("_first"),
        F.max(F.array_max(days)).alias("_last"),
        F.count_if(noted & (F.col("basis") != "act")).alias("_own"),
        F.count_if(noted & (F.col("basis") == "partial")).alias("_partial"),
        (F.min(F.when(noted, pair)) != F.max(F.when(noted, pair))).alias("_several"),
    )
    out = spans.join(facts, span, "left")
    reason = (
        F.when(F.coalesce("notes", F.lit(0)) == 0, UNEXPLAINED)
        .when(F.col("_unknown") > 0, UNKNOWN)
        .when(F.col("_foot_unknown") > 0, MANY)
        .when((F.col("_first") <= F.col("d_old")) | ((F.col("_last") > F.col("d_new")) & ~F.col("inferred")), OUTSIDE)
    )
    several = F.when(F.col("_several") | (F.col("_wider") > 0), MANY).when(F.col("_partial") > 0, PARTIAL).otherwise(SPLIT)
    out = out.withColumn("_why", reason).withColumn("_split", F.when(F.col("_why").isNull() & (F.col("_first") < F.col("_last")), several))
    plain, own = F.col("_why").isNull(), F.col("_why").isNull() & (F.col("_own") > 0)
    old_to, new_from = F.when(plain, F.col("_first")).otherwise(F.date_add("d_old", 1)), F.when(plain, F.col("_last")).otherwise(F.col("d_new"))
    gap = old_to < new_from
    return out.select(
        *spans.columns, F.coalesce("notes", F.lit(0)).alias("notes"), old_to.alias("old_to"), new_from.alias("new_from"), F.when(gap, old_to).alias("gap_from"), F.when(gap, new_from).alias("gap_to"),
        F.when(gap, F.coalesce("_why", "_split")).alias("gap_reason"), F.when(own, "exception").when(plain, "act").otherwise("fallback").alias("basis"), _warnings(F.col("_why"), F.when(own, EXCEPTION), F.col("_split")).alias("warnings"),
    )


def first_versions(firsts: DataFrame, notes: DataFrame, acts: DataFrame, exceptions: DataFrame, key: str) -> DataFrame:
    """The version that each key's earliest snapshot shows, and the gap before it.

    firsts: key (unique), snapshot, added (whether its kind is one that is added later), repealed, law
    and law_day (the original act); notes: key, day, law, kind, scope, place (0: at the head). The last
    day any of its notes took effect starts the version; a note that brings the key in tells that
    nothing was before. Without notes the original act's day starts it, or the snapshot's own.
    """
    real = notes.filter(F.col("kind") != "kabul").select(key, "day", "law", "kind", "scope", "place")
    dated = effective_days(real, acts, exceptions, key).join(firsts.select(key, F.col("added").alias("_added")), key)
    brings = (F.col("kind") == "ek") & (F.coalesce("scope", F.lit("")) == "") & (F.col("_added") | (F.col("place") == 0))
    pair, own = F.struct("day", "law"), F.struct("day", "law", "days")
    facts = dated.groupBy(key).agg(
        F.count("*").alias("notes"), F.count_if(F.col("days").isNull()).alias("_unknown"), F.max(F.array_max("days")).alias("_last"), F.count_if(F.col("basis") != "act").alias("_own"),
        F.min(F.when(brings, own)).alias("_add"), (F.min(pair) == F.max(pair)).alias("_lone"),
    )
    original = firsts.select(key, "law", F.col("law_day").alias("day")).filter("day is not null")
    law = effective_days(original, acts, exceptions, key).select(key, F.array_min("days").alias("_law_from"))
    out = firsts.join(facts, key, "left").join(law, key, "left")
    noted, add = F.coalesce("notes", F.lit(0)) > 0, F.when(F.col("added") | F.col("_lone"), F.col("_add"))
    found = add["days"].isNotNull()
    unknown, outside = noted & (F.col("_unknown") > 0), noted & (F.col("_unknown") == 0) & (F.col("_last") > F.col("snapshot"))
    start = F.when(unknown | outside, F.col("snapshot")).when(noted, F.col("_last")).when(F.col("added") | F.col("_law_from").isNull(), F.col("snapshot")).otherwise(F.col("_law_from"))
    out = out.withColumns({"valid_from": start, "_gap": F.when(noted, F.when(found, F.array_min(add["days"])).otherwise(F.col("_law_from"))).otherwise(F.col("_law_from"))})
    gap = F.when(noted, F.col("_gap").isNull() | (F.col("_gap") < F.col("valid_from"))).when(F.col("added"), ~F.col("_gap").eqNullSafe(F.col("snapshot"))).otherwise(F.col("_gap").isNull())
    partial = noted & found & (F.col("valid_from") == F.array_max(add["days"])) & (F.array_min(add["days"]) < F.col("valid_from"))
    why = F.when(partial, PARTIAL).otherwise(BEFORE_FIRST)
    kind = F.when(~noted, "original").when(F.col("repealed"), "repealed").when(~gap & found, "added").otherwise("amended")
    basis = F.when(unknown | outside, "fallback").when(noted, F.when(F.col("_own") > 0, "exception").otherwise("act")).when(F.col("added") | F.col("_law_from").isNull(), "fallback").otherwise("act")
    warnings = _warnings(
        F.when(unknown, UNKNOWN).when(outside, OUTSIDE).when(noted & (F.col("_own") > 0), EXCEPTION), F.when(noted & gap, why), F.when(noted & gap & F.col("_gap").isNull(), UNKNOWN),
        F.when(~noted & F.col("added"), UNVERIFIED).when(~noted & F.col("_law_from").isNull(), UNKNOWN),
    )
    return out.select(*firsts.columns, F.coalesce("notes", F.lit(0)).alias("notes"), "valid_from", kind.alias("change_kind"), basis.alias("basis"), F.when(gap, F.col("_gap")).alias("gap_from"), F.when(gap, F.col("valid_from")).alias("gap_to"), F.when(gap, F.when(noted, why).otherwise(BEFORE_FIRST)).alias("gap_reason"), warnings.alias("warnings"))
