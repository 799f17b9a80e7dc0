"""Quality rules as rows: each names a code, the condition that raises it, its band and its place.

The rows are compiled into one expression, so a table of any number of rules costs one pass without a
shuffle. Rules are data: they are read from a table, checked once, and can be changed without code.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = ("low", "medium", "high")
RULES = "code string, predicate string, band string, place int"


def checked(rules: DataFrame) -> list[tuple[str, str, str]]:
    """(code, predicate, band) in the order of their places; refuses repeated codes, unknown bands, missing parts.

    A rule table is written by people: it is small, and it is what the plan is made from.
    """
    rows = [(r["code"], r["predicate"], r["band"]) for r in rules.orderBy("place", "code").collect()]
    for code, predicate, band in rows:
        if not code or ":" in code or not predicate:
            raise ValueError(f"a rule needs a code without a colon and a predicate: {code!r}")
        if band not in BANDS:
            raise ValueError(f"{code}: {band!r} is none of {', '.join(BANDS)}")
    if len({c for c, *_ in rows}) < len(rows):
        raise ValueError("a code has two rules")
    return rows


def raised(rules: list[tuple[str, str, str]], found: Column | None = None) -> Column:
    """The codes whose conditions hold, in the order of the rules, behind those already ``found``.

    A condition that is null does not hold.
    """
    own = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(c)) for c, p, _ in rules]).cast("array<string>"))
    return own if found is None else F.concat(F.coalesce(found, F.array().cast("array<string>")), own)


def band(codes: Column, bands: Mapping[str, str]) -> Column:
    """The worst band of the codes; what follows a colon is detail. Codes without a band do not lower it."""
    known = lambda name: [c for c, b in bands.items() if b == name]
    plain = F.transform(codes, lambda w: F.substring_index(w, ":", 1))
    holds = lambda name: F.coalesce(F.arrays_overlap(plain, F.array(*map(F.lit, known(name))).cast("array<string>")), F.lit(False))
    return F.when(holds("low"), "low").when(holds("medium"), "medium").otherwise("high")


def judged(df: DataFrame, rules: list[tuple[str, str, str]], found: str | None = None) -> DataFrame:
    """df with ``codes`` and ``band``."""
    out = df.withColumn("codes", raised(rules, F.col(found) if found else None))
    return out.withColumn("band", band(F.col("codes"), {c: b for c, _, b in rules}))


def mapped(value: Column, allowed: list[str], aliases: Mapping[str, str] | None = None) -> tuple[Column, Column]:
    """(value or its alias where it is allowed, else empty; whether something else stood there). Null is empty."""
    plain = F.coalesce(value, F.lit(""))
    if aliases:
        plain = F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[plain], plain)
    fits = plain.isin(allowed)
    return F.when(fits, plain).otherwise(""), (plain != "") & ~fits


def missing(applies: Mapping[str, Column]) -> Column:
    """The names of the applicable columns without a value, in the order given."""
    return F.array_compact(F.array(*[F.when(c & (F.coalesce(F.col(name).cast("string"), F.lit("")) == ""), name) for name, c in applies.items()]))
