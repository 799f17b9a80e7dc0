"""What reviewers see and do: edits of the right type, cursors, bulk runs, open questions, consistent answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CountChanged(Exception):
    """The records of a bulk run are not as many as its caller has seen."""


def typed_overlay(base: Column, edits: Column, field: str, kind: str) -> Column:
    """The edited value of a field where the edit has the field's type, else ``base``.

    ``edits``: JSON text; kind: ``number`` or ``string``, the type of ``base``. Text that is no JSON, an
    absent field, null and values of other types lay nothing over.
    """
    value = F.try_variant_get(F.try_parse_json(edits), f"$.{field}", "variant")
    types = {"number": ("BIGINT", "DECIMAL", "DOUBLE"), "string": ("STRING",)}[kind]
    fits = F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0).isin(*types), F.lit(False))
    own = F.try_variant_get(F.try_parse_json(edits), f"$.{field}", "string" if kind == "string" else "bigint")
    return F.when(fits & own.isNotNull(), own).otherwise(base)


def cursor(at: Column, row: Column) -> Column:
    """An opaque mark of a row's place: base64 of its time in microseconds and its id."""
    return F.base64(F.encode(F.concat_ws("|", F.unix_micros(at.cast("timestamp")).cast("string"), row.cast("string")), "UTF-8"))


def page_after(df: DataFrame, at: str, row: str, mark: str | None, n: int) -> DataFrame:
    """The next ``n`` rows, newest first, with ``next`` (the mark to go on from; null on the last page).

    One row more than asked for is looked at, which tells whether there are others. A mark that is none
    is refused by its cast. Rows without a time or id are on no page.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = df.filter(F.col(at).isNotNull() & F.col(row).isNotNull())
    if mark is not None:
        parts = F.split(F.decode(F.unbase64(F.lit(mark)), "UTF-8"), r"\|")
        rows = rows.filter(F.struct(micros, F.col(row).cast("string").cast("bigint")) < F.struct(parts[0].cast("bigint"), parts[1].cast("bigint")))
    ahead = rows.orderBy(F.desc(at), F.desc(row)).limit(n + 1)  # few rows from here on
    facts = ahead.agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct((-micros).alias("m"), (-F.col(row)).alias("r"), cursor(F.col(at), F.col(row)).alias("c")))).alias("_x")).select("_n", F.get("_x", F.lit(n - 1))["c"].alias("_c"))
    page = ahead.orderBy(F.desc(at), F.desc(row)).limit(n)
    return page.join(F.broadcast(facts), F.lit(True)).withColumn("next", F.when(F.col("_n") > n, F.col("_c"))).drop("_n", "_c")  # one row of facts


def bulk_page(pending: DataFrame, row: str, after: int | None, expected: int, limit: int) -> tuple[DataFrame, int]:
    """(the first ``limit`` records after a cursor, how many are left behind them); CountChanged if there are not ``expected``."""
    left = pending if after is None else pending.filter(F.col(row) > after)
    total = left.count()
    if total != expected:
        raise CountChanged(f"{total} records are pending, not {expected}")
    return left.orderBy(row).limit(limit), max(0, total - limit)


def open_questions(facts: DataFrame, template: DataFrame, bases: DataFrame, sources: DataFrame) -> DataFrame:
    """case, number, key, text, refs: one question for each critical fact that is still unknown.

    facts: case, topic, key, status; template: topic, key (unique together), place, critical, text; bases:
    topic, key, ref; sources: ref, source. Questions are numbered in the order of the template; of a
    question's bases those are named that the sources resolve, in the order of their refs.
    """
    named = bases.join(sources.select("ref").distinct(), "ref", "left_semi").groupBy("topic", "key").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    asked = template.filter("critical").join(named, ["topic", "key"], "left")
    unknown = facts.filter("status = 'unknown'").select("case", "topic", "key").distinct().join(F.broadcast(asked), ["topic", "key"])  # a template is written by hand
    each = F.array_sort(F.collect_list(F.struct("place", "key", "text", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))))
    out = unknown.groupBy("case").agg(each.alias("x")).select("case", F.posexplode("x").alias("i", "q"))
    return out.select("case", (F.col("i") + 1).alias("number"), "q.key", "q.text", "q.refs")


def consistent(answers: DataFrame) -> DataFrame:
    """``answers`` with ``problems``: the rules that an answer breaks, in this order.

    answers: status, cited and read (arrays of sources), read_kinds (array of each read source's kind),
    stated (map of kind to number), fact_keys and unknown_facts (arrays), missing_info (number), points
    (number), short_points (number), unknown_rows (number), law_day (date), law_text. Null counts as none.
    """
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), none)
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    sources = F.array_distinct(F.zip_with(listed("read"), listed("read_kinds"), lambda s, k: F.struct(s.alias("source"), k.alias("kind"))))
    stated = F.coalesce("stated", F.map_from_arrays(none, F.array().cast("array<int>")))
    kinds = F.array_distinct(F.concat(listed("read_kinds"), F.map_keys(stated)))
    differs = F.exists(kinds, lambda k: F.size(F.filter(sources, lambda x: x["kind"] == k)) != F.coalesce(stated[k], F.lit(0)))
    definite, conditional = F.col("status").eqNullSafe("definite"), F.col("status").eqNullSafe("conditional")
    rules = {
        "repeated_fact_key": F.size(listed("fact_keys")) != F.size(F.array_distinct(listed("fact_keys"))),
        "count_differs": differs,
        "short_count_exceeds_points": number("short_points") > number("points"),
        "conditional_without_missing_info": conditional & (number("missing_info") == 0),
        "definite_with_missing_info": definite & (number("missing_info") > 0),
        "definite_on_unknown_fact": definite & (F.size(listed("unknown_facts")) > 0),
        "definite_with_unknown_row": definite & (number("unknown_rows") > 0),
        "cites_unread": F.size(F.array_except(listed("cited"), listed("read"))) > 0,
        "law_text_without_day": ~F.coalesce(F.contains("law_text", F.date_format("law_day", "dd.MM.yyyy")), F.lit(False)),
    }
    return answers.withColumn("problems", F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])))


def outside_issue(records: DataFrame, issue: str, printed: str, day: str, most: int = 3) -> DataFrame:
    """``records`` with ``reference`` and ``outside``: dates more than ``most`` years from the year printed in the
    issue, or, where none is printed, from the median year of the issue's dates. Rows without a date or
    a reference are not outside. The median is that of all years, the mean of the middle two floored.
    """
    medians = records.filter(F.col(issue).isNotNull() & F.col(day).isNotNull()).groupBy(issue).agg(F.floor(F.median(F.year(day))).cast("int").alias("_median"))
    out = records.join(medians, issue, "left")
    reference = F.coalesce(F.col(printed), F.col("_median"))
    return out.withColumn("reference", reference).withColumn("outside", F.coalesce(F.abs(F.year(day) - reference) > most, F.lit(False))).drop("_median")

