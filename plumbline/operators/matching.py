"""Records held against an official source, candidates, confidence, citation gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions.dates import compare_dates
from plumbline.operators.skew import joined


def record_matches(ours: DataFrame, official: DataFrame, row: str, keys: list[str], same: list[str], date: str) -> DataFrame:
    """row, verdict over the official rows with equal keys: none, exact, acceptable, ambiguous or mismatch.

    A row is exact if all ``same`` columns and the date agree, acceptable if they agree or are
    absent and the date is near; null columns are absent.
    """
    o = official.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in (*same, date)])
    joined = ours.join(o, keys, "left")
    there = F.col(f"_o_{date}").isNotNull()
    for c in same:
        there = there | F.col(f"_o_{c}").isNotNull()
    d = compare_dates(F.col(date), F.col(f"_o_{date}"))
    exact, near = d == "match", d.isin("match", "fuzzy", "absent")
    for c in same:
        exact = exact & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        near = near & (F.col(c).isNull() | F.col(f"_o_{c}").isNull() | (F.col(c) == F.col(f"_o_{c}")))
    counts = joined.groupBy(row).agg(F.count_if(there).alias("candidates"), F.count_if(there & exact).alias("exact"), F.count_if(there & near).alias("acceptable"))
    verdict = F.when(F.col("candidates") == 0, "none").when(F.col("exact") == 1, "exact").when(F.col("acceptable") == 1, "acceptable").when((F.col("exact") > 1) | (F.col("acceptable") > 1), "ambiguous").otherwise("mismatch")
    return counts.withColumn("verdict", verdict)


def downgraded(old: Column, new: Column) -> Column:
    """The status after a check: a verified record never falls back to not_in_source."""
    return F.when(old.startswith("verified") & (new == "not_in_source"), old).otherwise(new)


def _keyed(df: DataFrame, row: str, keys: dict[str, Column]) -> DataFrame:
    """row, reason, strength (0 is strongest) and key, for each key that a row has."""
    each = F.array(*[F.struct(F.lit(reason).alias("reason"), F.lit(i).alias("strength"), key.alias("key")) for i, (reason, key) in enumerate(keys.items())])
    return df.select(F.col(row), F.explode(each).alias("x")).select(row, "x.*").filter("key <> ''")


def candidates_by(df: DataFrame, row: str, keys: dict[str, Column]) -> DataFrame:
    """row, reason, class_id, others: the classes of rows that share a key, as membership.

    ``class_id`` is the smallest row with the key and ``others`` how many rows share it; rows alone
    with a key are left out. Two rows are candidates of each other if they have a class in common. A
    crowded key is counted before the shuffle, and its members' rows stay where they are.
    """
    keyed = _keyed(df, row, keys)
    classes = keyed.groupBy("reason", "key").agg(F.min(row).alias("class_id"), (F.count("*") - 1).alias("others")).filter("others > 0")
    return joined(keyed, classes, ["reason", "key"], "others").select(row, "reason", "class_id", "others")


def candidates_of(subjects: DataFrame, df: DataFrame, row: str, keys: dict[str, Column]) -> DataFrame:
    """subject, row, reason: all candidates of each of a set of subjects, with the strongest shared key.

    One equi-join on (reason, key), never an OR join.
    """
    asked = _keyed(subjects, row, keys).withColumnRenamed(row, "subject").drop("strength")
    pairs = asked.join(_keyed(df, row, keys), ["reason", "key"]).filter(F.col("subject") != F.col(row))
    return pairs.groupBy("subject", row).agg(F.min_by("reason", "strength").alias("reason"))


def confidence(reasons: Column) -> tuple[Column, Column, Column]:
    """(score, band, reasons in table order) of an array of reason codes (``code:detail`` counts as code)."""
    codes = F.transform(reasons, lambda r: F.split_part(r, F.lit(":"), F.lit(1)))
    fired = F.filter(F.array(*map(F.lit, C.LOW_REASONS + C.MEDIUM_REASONS)), lambda r: F.array_contains(codes, r))
    low = F.size(F.filter(fired, lambda r: r.isin(*C.LOW_REASONS)))
    score = F.greatest(F.lit(0), F.lit(100) - low * C.PENALTY["low"] - (F.size(fired) - low) * C.PENALTY["medium"])
    return score, F.when(low > 0, "low").when(F.size(fired) > 0, "medium").otherwise("high"), fired


def citation_gate(points: DataFrame, sources: DataFrame, point: str, source: str, quote: str) -> DataFrame:
    """Each citation's fate (kept, unread, not_in_force, not_quoted) and whether its point stands.

    ``sources``: source, text, in_force. A point stands if one of its citations is kept.
    """
    from plumbline.functions.text import holds_quote

    s = sources.select(source, F.col("text").alias("_t"), "in_force")
    fate = F.when(F.col("_t").isNull(), "unread").when(~F.col("in_force"), "not_in_force").when(~holds_quote(F.col("_t"), F.col(quote)), "not_quoted").otherwise("kept")
    return points.join(s, source, "left").withColumn("fate", fate).drop("_t", "in_force").withColumn("stands", F.max(F.col("fate") == "kept").over(Window.partitionBy(point)))


def read_up_to(passages: DataFrame, source: str, order: str, text: str, chars: int = 6000) -> DataFrame:
    """Passages of each source cut so that together they hold ``chars`` characters."""
    w = Window.partitionBy(source).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    return passages.withColumn("_b", before).filter(F.col("_b") < chars).withColumn(text, F.substring(F.col(text), F.lit(1), (chars - F.col("_b")).cast("int"))).drop("_b")


def merged_sources(reads: DataFrame, source: str) -> DataFrame:
    """Reads of one source as one: passages once each, complete if any read was."""
    return reads.groupBy(source).agg(F.array_sort(F.collect_set("passage")).alias("passages"), F.bool_or("complete").alias("complete"))


def resolved(*by_priority: Column, unknown: str = "unknown") -> Column:
    return F.coalesce(*by_priority, F.lit(unknown))


def answer_score(cited: Column, must: Column) -> Column:
    """Share of the things that must be cited that are (1 when nothing must)."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(must, cited)), F.size(must)), F.lit(1.0))


def integrity(answers: DataFrame, cited: str, read: str, stated: str) -> DataFrame:
    """answers with ``problems``: cites what was not read, states another number of sources than it cites."""
    unread = F.size(F.array_except(cited, read)) > 0
    miscounted = F.col(stated) != F.size(F.array_distinct(cited))
    found = F.array(F.when(unread, "cites_unread"), F.when(miscounted, "count_differs"))
    return answers.withColumn("problems", F.filter(found, lambda p: p.isNotNull()))


def backfilled(df: DataFrame, kind: str, folder_kind: Column, retype: Column, to: str) -> DataFrame:
    """df with missing kinds from the folder, then retyped where a condition holds; ``filled`` says how."""
    first = F.coalesce(F.col(kind), folder_kind)
    how = F.when(retype & first.isNotNull() & (first != to), "retyped").when(F.col(kind).isNull() & first.isNotNull(), "from_folder").when(first.isNull(), "unknown").otherwise("kept")
    return df.withColumn("filled", how).withColumn(kind, F.when(retype & first.isNotNull(), F.lit(to)).otherwise(first))


def overlay_suggestions(df: DataFrame, user: str, detected: str) -> DataFrame:
    """The user's value wins; a detection that differs stays beside it."""
    shown = F.coalesce(F.col(user), F.col(detected))
    return df.withColumn("shown", shown).withColumn("differs", F.when(F.col(user).isNotNull() & ~F.col(user).eqNullSafe(F.col(detected)), F.col(detected)))
