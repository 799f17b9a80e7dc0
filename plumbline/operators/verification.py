"""Records held against the rows of an official source, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions import text as T
from plumbline.functions.names import appeal_region, canonical_chamber

#: The last year that the source does not hold, and how many older records are asked for to see whether that is so.
OLD_YEAR, SAMPLE = 2009, 20


def _compared(wanted: Column, found: Column) -> Column:
    return F.when(wanted.isNull() | (wanted == ""), "absent").when(wanted.eqNullSafe(found), "match").otherwise("mismatch")


def _dates(wanted: Column, found: Column, days: int) -> Column:
    """A date that the source writes and nobody can read is a mismatch: it is not the same as no date."""
    gap = F.abs(F.datediff(wanted, found))
    return F.when(wanted.isNull(), "absent").when(found.isNull(), "mismatch").when(gap == 0, "match").when(gap <= days, "fuzzy").otherwise("mismatch")


def field_vectors(ours: DataFrame, official: DataFrame, row: str, days: int = C.FUZZY_DAYS) -> DataFrame:
    """row, verdict, ref, candidates, chamber, bam_region, decision_date, fuzzy, ambiguous, date_unparseable.

    ours: row, esas_no, karar_no, chamber, bam_region, decision_date; official: ref (unique), esas_no,
    karar_no, chamber, decision_date. Candidates are official rows with the same two numbers, divisions
    and leading zeros aside. The only exact candidate, else the only acceptable one (its date may be
    fuzzy), verifies; several are ambiguous and, as fields that disagree, a mismatch that shows the
    first candidate by ref. What ours lacks is absent and does not count against a candidate.
    """
    numbers = lambda: (T.number_key(F.coalesce("esas_no", F.lit(""))).alias("_e"), T.number_key(F.coalesce("karar_no", F.lit(""))).alias("_k"))
    o = official.select(*numbers(), "ref", canonical_chamber(F.col("chamber")).alias("_chamber"), appeal_region(F.coalesce("chamber", F.lit(""))).alias("_region"), F.col("decision_date").alias("_date"))
    both = ours.select(row, *numbers(), canonical_chamber(F.col("chamber")).alias("_want"), T.fold(F.coalesce("bam_region", F.lit(""))).alias("_want_region"), "decision_date").join(o, ["_e", "_k"])
    region = F.when((F.col("_want_region") == "") | (F.col("_region") == ""), "absent").when(F.col("_want_region") == F.col("_region"), "match").otherwise("mismatch")
    fields = {"chamber": _compared(F.col("_want"), F.col("_chamber")), "bam_region": region, "decision_date": _dates(F.col("decision_date"), F.col("_date"), days)}
    both = both.select(row, "ref", (F.col("decision_date").isNotNull() & F.col("_date").isNull()).alias("date_unparseable"), *[c.alias(f"_{n}") for n, c in fields.items()])
    place = F.col("_chamber").isin("match", "absent") & F.col("_bam_region").isin("match", "absent")
    exact, near = place & F.col("_decision_date").isin("match", "absent"), place & (F.col("_decision_date") != "mismatch")
    each = F.struct("ref", *[F.col(f"_{n}").alias(n) for n in fields], "date_unparseable")
    found = both.groupBy(row).agg(F.count("*").alias("candidates"), F.count_if(exact).alias("_exact"), F.count_if(near).alias("_near"), F.min(each).alias("_first"), F.min(F.when(exact, each)).alias("_first_exact"), F.min(F.when(near, each)).alias("_first_near"))
    pool = F.when(F.col("_exact") > 0, F.col("_exact")).otherwise(F.col("_near"))
    chosen = F.when(pool == 1, F.coalesce("_first_exact", "_first_near"))
    best = F.coalesce(chosen, "_first")
    out = ours.select(row).join(found, row, "left")
    verdict = F.when(F.col("candidates").isNull(), "not_in_source").when(chosen.isNotNull(), "verified").otherwise("mismatch")
    fuzzy = F.array_compact(F.array(*[F.when(best[n] == "fuzzy", n) for n in fields]))
    return out.select(row, verdict.alias("verdict"), best["ref"].alias("ref"), F.coalesce("candidates", F.lit(0)).alias("candidates"), *[best[n].alias(n) for n in fields], fuzzy.alias("fuzzy"), F.coalesce(pool > 1, F.lit(False)).alias("ambiguous"), F.coalesce(best["date_unparseable"], F.lit(False)).alias("date_unparseable"))


def heading_evidence(heading: Column, number: Column, division: Column) -> Column:
    """Whether a heading names the division that a case came from: match, fuzzy (not found) or absent (nothing to look for).

    All YYYY/D-N of the heading are taken out and compared part by part, so no pattern is built for each row.
    """
    found = F.regexp_extract_all(F.coalesce(heading, F.lit("")), F.lit(r"(?<!\w)\d{4} ?/ ?\d+ ?- ?\d+(?!\w)"), F.lit(0))
    wanted = F.concat(F.substring_index(T.number_key(number), "/", 1), F.lit("/"), division, F.lit("-"), F.substring_index(T.number_key(number), "/", -1))
    plain = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, " ", ""), "-0*", "-"))
    return F.when((F.coalesce(division, F.lit("")) == "") | (F.coalesce(number, F.lit("")) == ""), "absent").when(F.array_contains(plain, wanted), "match").otherwise("fuzzy")


def verified(ours: DataFrame, official: DataFrame, texts: DataFrame, row: str, skip_old: bool = True) -> DataFrame:
    """row, outcome, ref, why, source_chamber, text_sha256 of each of ``ours`` (as in ``field_vectors``, with source_chamber).

    Records of ``OLD_YEAR`` and before are not looked for (not_in_source, pre_2009_heuristic) unless the
    heuristic is off; a mismatch stops before the text is read; texts: ref, body. The body's heading is
    its first 1,500 characters without tags.
    """
    old = F.coalesce(F.year("decision_date") <= OLD_YEAR, F.lit(False)) & F.lit(skip_old)
    looked = field_vectors(ours.filter(~old), official, row)
    read = looked.filter("verdict = 'verified'").join(texts.select("ref", "body"), "ref", "left").join(ours.select(row, "esas_no", "source_chamber"), row)
    evidence = read.select(row, heading_evidence(T.plain_heading(F.coalesce("body", F.lit(""))), F.col("esas_no"), F.col("source_chamber")).alias("_evidence"), F.sha2("body", 256).alias("text_sha256"))
    out = looked.join(evidence, row, "left")
    why = F.concat_ws(",", F.array_join("fuzzy", ","), F.when(F.col("_evidence") == "fuzzy", "source_chamber"), F.when(F.col("ambiguous"), "ambiguous"), F.when(F.col("date_unparseable"), "official_date_unparseable"))
    why = F.regexp_replace(why, "^,", "")
    out = out.select(row, F.col("verdict").alias("outcome"), "ref", why.alias("why"), F.col("_evidence").alias("source_chamber"), "text_sha256")
    skipped = ours.filter(old).select(row, F.lit("not_in_source").alias("outcome"), F.lit(None).cast(out.schema["ref"].dataType).alias("ref"), F.lit("pre_2009_heuristic").alias("why"), F.lit(None).cast("string").alias("source_chamber"), F.lit(None).cast("string").alias("text_sha256"))
    return out.unionByName(skipped)


def heuristic_holds(ours: DataFrame, official: DataFrame, row: str, sample: int = SAMPLE) -> bool:
    """Whether none of a fixed sample of old records (those of the smallest hashes) is in the source after all."""
    old = ours.filter(F.year("decision_date") <= OLD_YEAR).orderBy(F.xxhash64(row), row).limit(sample)
    return field_vectors(old, official, row).filter("verdict <> 'not_in_source'").isEmpty()

