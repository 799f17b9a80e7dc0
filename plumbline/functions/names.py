"""Names of chambers, regions and articles in one spelling, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import fold, lower_tr, upper_tr

# Kinds of numbered chambers and named bodies, folded, with their codes.
CHAMBER_KINDS = {"hukuk dairesi": "HD", "hd": "HD", "ceza dairesi": "CD", "cd": "CD", "daire": "D", "d": "D"}
BODIES = {
    "hukuk genel kurulu": "HGK", "hgk": "HGK", "ceza genel kurulu": "CGK", "cgk": "CGK", "ictihadi birlestirme buyuk genel kurulu": "IBK", "ibk": "IBK",
}
COURT, APPEAL = "yargitay ", ("bolge adliye mahkemesi", "bam")


def _lookup(table: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def canonical_chamber(c: Column) -> Column:
    """'9 HD' of "Yargıtay 9. Hukuk Dairesi", 'HGK' of "Hukuk Genel Kurulu"; other names folded, null of an empty one."""
    plain = fold(c)
    numbered = r"(?<![a-z0-9])(\d+) (" + "|".join(CHAMBER_KINDS) + r")(?![a-z0-9])"
    number = F.regexp_extract(plain, numbered, 1)
    body = F.regexp_replace(plain, "^" + COURT, "")
    named = F.coalesce(_lookup(BODIES, body), plain)
    return F.when(number != "", F.concat_ws(" ", number, _lookup(CHAMBER_KINDS, F.regexp_extract(plain, numbered, 2)))).when(plain != "", named)


def appeal_region(c: Column) -> Column:
    """The folded region before the name of a regional court; empty where there is none."""
    return F.trim(F.regexp_extract(fold(c), r"^(.*?)\s*(?<![a-z0-9])(?:" + "|".join(APPEAL) + r")(?![a-z0-9])", 1))


def article_number(c: Column) -> Column:
    """'18', '18/A', 'Ek 2', 'Geçici 4', 'Geçici 79 (2)' of themselves or of aliases such as gecici-79-2; others only trimmed."""
    trimmed = F.trim(F.regexp_replace(c, r"\s+", " "))
    low = lower_tr(trimmed)
    # Fixed values, patterns: the spellings of a series, a number, its letter and its part.
    series, number, letter, part = r"(?:(ek|ge[cç][iı]c[iı])[-_ ])?", r"(\d+)", "[-/]?([a-zçğıöşü])", r"[-_ ]?\((\d+)\)|[-_](\d+)"
    pattern = f"^{series}{number}(?:{letter}|{part})?$"
    at = lambda i: F.regexp_extract(low, pattern, i)
    own = F.when(at(3) != "", F.concat_ws("/", at(2), upper_tr(at(3)))).otherwise(at(2))
    sub = F.when(at(4) != "", at(4)).when(at(5) != "", at(5))
    full = F.concat(F.when(at(1) == "ek", "Ek ").when(at(1) != "", "Geçici ").otherwise(""), own, F.coalesce(F.concat(F.lit(" ("), sub, F.lit(")")), F.lit("")))
    return F.when(low.rlike(pattern), full).otherwise(trimmed)
