"""Structure in legal texts: layouts, document types, amendment notes, article heads, quotes, diffs.

Rules that are single patterns are column expressions. Scanners that carry state along a text run in
batches of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions.text import lower_tr, wording

# The marks that tell layouts and types apart, in the order in which they are tried.
LAYOUTS = (
    ("new_template", r"(?m)^[ \t]*(?:I\.[ \t]*DAVA|V\.[ \t]*GEREKÇE|VI\.[ \t]*KARAR)(?![\p{L}\p{N}])"),
    ("two_column", r"(?mi)^[ \t]*(?:Esas No|Baş\. No|Başvuru No)\.?[ \t]*\n[ \t]*(?:Karar No|Karar Tarihi)\.?:?[ \t]*\n"),
)
SUMMARY = r"(?m)^[ \t]*(?:ÖZETİ|ÖZÜ|ÖZET|Özeti|Özü)(?![\p{L}\p{N}])"
LABEL = r"(?m)^[ \t]*(?:(?:ESAS|Esas|KARAR|Karar)[ \t]*(?:NO|No|Sayısı)|Başvuru[ \t]*No|E\.(?=[ \t]*\d)|K\.(?=[ \t]*\d))"
TYPES = (
    ("statute", r"Kanun Numarası\s*:\s*\d+"),
    ("decision", LABEL),
    ("circular", r"(?m)^[^\n]{0,100}(?<![\p{L}])GENELGE(?![\p{L}])[^\n]{0,40}$"),
    ("regulation", r"YÖNETMELİ[ĞK]|TEBLİĞ"),
    ("letter", r"(?m)^[ \t]*(?:Sayı|Konu)[ \t]*:"),
)
#: What a note's first word says of the article.
NOTE_KINDS = {"değişik": "amended", "ek": "added", "mülga": "repealed", "iptal": "annulled", "yeniden": "amended", "aynen": "adopted", "değiştirilerek": "amended"}


def layout(text: Column) -> Column:
    """The first layout whose mark is found; else by whether the summary stands before the labels."""
    out = F.lit(None).cast("string")
    for name, mark in reversed(LAYOUTS):
        out = F.when(text.rlike(mark), name).otherwise(out)
    at = lambda p: F.when(text.rlike(p), F.length(F.regexp_extract(text, "(?s)^(.*?)" + p.replace("(?m)^", "(?m:^)"), 1)))
    first = F.when(at(LABEL).isNull(), "unknown").when(at(SUMMARY) < at(LABEL), "summary_first").otherwise("classic")
    return F.coalesce(out, first)


def document_type(text: Column) -> Column:
    """struct(type, quote, page) of the first type whose mark is found, with the words that show it."""
    page = lambda q: F.length(F.substring_index(text, q, 1)) - F.length(F.replace(F.substring_index(text, q, 1), F.lit("\f"), F.lit(""))) + 1
    out = F.lit(None).cast("struct<type:string,quote:string>")
    for name, mark in reversed(TYPES):
        quote = F.trim(F.regexp_replace(F.regexp_extract(text, f"({mark})", 1), r"\s+", " "))
        out = F.when(text.rlike(mark), F.struct(F.lit(name).alias("type"), quote.alias("quote"))).otherwise(out)
    return out


NOTES = "id long, kind string, scope string, day date, law string, article string, raw string, char_start int"
_TOKEN = re.compile(r"\d+|[^\W\d_]+|[^\w\s]")
_DAY = re.compile(r"9/9/9")


def brackets(text: str) -> Iterator[tuple[int, str]]:
    """(place, inside) of outermost bracketed parts; an unclosed bracket is skipped."""
    opened: list[int] = []
    closed: list[tuple[int, int]] = []
    for m in re.finditer(r"[()]", text):
        if m[0] == "(":
            opened.append(m.start())
        elif opened:
            start = opened.pop()
            while closed and closed[-1][0] > start:
                closed.pop()
            closed.append((start, m.start()))
    for start, end in closed:
        yield start, text[start + 1 : end]


def _head(item: str) -> tuple[str, str, str] | None:
    """(kind, scope, what follows the colon) of an item that begins with a kind."""
    head, colon, rest = item.partition(":")
    words = head.replace("İ", "i").lower().split()
    if words[:3] == ["başlığı", "ile", "birlikte"]:
        words = words[3:]
    if not colon or not words or words[0] not in NOTE_KINDS:
        return None
    return NOTE_KINDS[words[0]], " ".join(words[1:]), rest


def _items(inside: str) -> list[str]:
    """Parts at ; or , of which each begins with a kind."""
    out: list[str] = []
    for part in re.split(r"(?<=[;,])", inside):
        if out and not _head(part):
            out[-1] += part
        else:
            out.append(part)
    return [x.strip().rstrip(";,").strip() for x in out]


def _shape(rest: str) -> tuple[str, list[str]]:
    """The item's signs with 9 for a number, k for a decree's mark, w for other words; its numbers."""
    tokens = _TOKEN.findall(rest)
    while tokens and tokens[-1].lower() in (".", ",", "md"):
        tokens.pop()
    signs = ["9" if t.isdigit() else "k" if t.upper() == "KHK" else "w" if t.isalpha() else "-" if t in "-–—" else t for t in tokens]
    return "".join(signs), [t for t in tokens if t.isdigit()]


def _note(raw: str, place: int) -> tuple | None:
    """One item: a kind, a scope, a colon, and either day - law / article or a court's ruling of a day."""
    kind, scope, rest = _head(raw)
    shape, n = _shape(rest)
    if re.fullmatch(r"9/9/9-(k\W{0,3})?9/9", shape):
        law, article = ("KHK-" if "k" in shape else "") + n[3], n[4]
    elif kind == "annulled" and (day := _DAY.search(shape)) and "w" in shape[: day.start()]:
        law, n = None, n[shape[: day.start()].count("9") :]
        article = " ".join(f"{a}. {re.sub(r'\s', '', b)}" for a, b in re.findall(r"\b([EK])\s*[.:]+\s*:?\s*(\d+\s*/\s*\d+)", rest))
    else:
        return None
    day = pd.to_datetime(f"{n[2]}-{int(n[1]):02}-{int(n[0]):02}", errors="coerce") if len(n[2]) == 4 else pd.NaT
    return None if pd.isna(day) else (kind, scope, day.date(), law, article, raw, place)


def notes_in(text: str) -> list[tuple]:
    """(kind, scope, day, law, article, raw, offset) of each note item.

    A court's ruling has no law; its article is its case and ruling numbers (E. a/b K. c/d), as far as
    they are given. A bracket with an item that cannot be parsed stays raw as a whole.
    """
    out = []
    for place, inside in brackets(text):
        if not _head(inside):
            continue
        found = [_note(raw, place) for raw in _items(inside)]
        out += [(None, None, None, None, None, inside, place)] if None in found else found
    return out


# The words that begin an article, and its series.
ARTICLE_WORDS, SERIES = ("MADDE", "Madde"), {"EK": "Ek ", "Ek": "Ek ", "GEÇİCİ": "Geçici ", "Geçici": "Geçici "}


def _article_head(line: str) -> tuple[str, str, int] | None:
    """(series, number, where its text begins) of a line such as 'Ek Madde 12/A - text'."""
    words = line.split(None, 2)
    series = SERIES.get(words[0]) if words else None
    at = 1 if series else 0
    if len(words) < at + 2 or words[at] not in ARTICLE_WORDS:
        return None
    rest = line[line.index(words[at], line.index(words[0]) + (len(words[0]) if at else 0)) + len(words[at]) :]
    begin = rest.lstrip(" \t")
    digits = len(begin) - len(begin.lstrip("0123456789"))
    tail = begin[digits:]
    letter = tail[:2] if tail[:1] == "/" and tail[1:2].isalpha() else ""
    after = tail[len(letter) :].lstrip(" \t")
    if not digits or after[:1] not in ("-", "–", "—"):
        return None
    return series or "", begin[:digits] + letter, len(line) - len(after[1:].lstrip(" \t"))


def article_heads(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(place of the line, where the article's text begins, series, number) of each article head."""
    place = 0
    for line in text.split("\n"):
        if head := _article_head(line):
            yield place, place + head[2], head[0], head[1]
        place += len(line) + 1


ARTICLES = "id long, ordinal int, article_no string, heading string, text string, char_start int, warning string"


def articles_in(text: str) -> list[tuple]:
    """(article_no, heading, text, offset, warning) of a statute's articles; numbering breaks are flagged."""
    heads, out, last = list(article_heads(text)), [], {}
    for (place, begin, series, no), after in zip(heads, [*heads[1:], None], strict=True):
        number = int(re.match(r"\d+", no)[0])
        before = last.get(series)
        warning = None if before is None or number == before + 1 or "/" in no else "repeated_number" if number == before else "out_of_order" if number < before else "skipped_number"
        last[series] = max(number, before or 0)
        lines = text[:place].rstrip("\n").rsplit("\n", 1)
        heading = lines[-1].strip() if place and lines[-1].strip() and not lines[-1].strip().endswith((".", ";", ":", ",")) and len(lines[-1]) < 120 else ""
        out.append((f"{series}{no}", heading, text[begin : after[0] if after else len(text)].strip(), place, warning))
    return out


def _exploded(df: DataFrame, row: str, text: str, scan, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, *x) for i, t in zip(pdf["id"], pdf["text"], strict=True) for x in scan(t)], columns=names)

    return df.select(F.col(row).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(run, schema)


def amendment_notes(df: DataFrame, row: str, text: str) -> DataFrame:
    return _exploded(df, row, text, notes_in, NOTES)


def articles(df: DataFrame, row: str, text: str) -> DataFrame:
    return _exploded(df, row, text, lambda t: [(i, *a) for i, a in enumerate(articles_in(t))], ARTICLES)


def locate(text: str, quote: str, ignore_case: bool = False) -> tuple[int, int] | None:
    """(start, end) of ``quote`` in ``text``, white space aside, not inside words."""
    parts = quote.split()
    if not parts:
        return None
    left = r"(?<!\w)" if re.match(r"\w", parts[0]) else ""
    right = r"(?!\w)" if re.match(r"\w", parts[-1][-1]) else ""
    m = re.search(left + r"\s+".join(map(re.escape, parts)) + right, text, re.I if ignore_case else 0)
    return m.span() if m else None


def located(df: DataFrame, text: str, quote: str) -> DataFrame:
    """df and char_start, char_end of each row's quote in its text (null where it is not)."""

    @F.pandas_udf("char_start int, char_end int")
    def find(t: pd.Series, q: pd.Series) -> pd.DataFrame:
        spans = [locate(a or "", b or "") or (None, None) for a, b in zip(t, q, strict=True)]
        return pd.DataFrame(spans, columns=["char_start", "char_end"]).astype("Int32")

    return df.withColumn("_s", find(text, quote)).select("*", "_s.char_start", "_s.char_end").drop("_s")


def word_changes(a: str, b: str) -> int:
    """Words that differ between two texts (a replaced word counts once)."""
    import difflib

    return sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).get_opcodes() if tag != "equal")


def compared(df: DataFrame, old: str, new: str, uncertain: int = 2) -> DataFrame:
    """df and ``change``: unchanged (same wording), changed, or uncertain (a few words differ)."""
    @F.pandas_udf("int")
    def differing(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([word_changes(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="Int32")

    same = wording(F.col(old)).eqNullSafe(wording(F.col(new)))
    return df.withColumn("change", F.when(same, "unchanged").when(differing(wording(F.col(old)), wording(F.col(new))) <= uncertain, "uncertain").otherwise("changed"))


def with_aliases(acts: DataFrame, law: str, alias: str, own: list[str]) -> DataFrame:
    """Rows that repeat another row (``alias`` names its law) take everything but ``own`` from it;
    an alias of nothing is marked ``bad_alias``."""
    others = [c for c in acts.columns if c not in (law, alias, *own)]
    source = acts.filter(F.col(alias).isNull()).select(F.col(law).alias("_law"), *[F.col(c).alias(f"_{c}") for c in others])
    joined = acts.join(source, F.col(alias) == F.col("_law"), "left")
    bad = F.col(alias).isNotNull() & F.col("_law").isNull()
    return joined.select(law, alias, *own, *[F.when(F.col("_law").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in others], bad.alias("bad_alias"))


def missing_references(cited: DataFrame, known: DataFrame, law: str, day: str) -> DataFrame:
    """Cited laws that the registry lacks or has without a date."""
    absent = cited.select(law).distinct().join(known.select(law), law, "left_anti").withColumn("why", F.lit("missing"))
    undated = cited.select(law).distinct().join(known.filter(F.col(day).isNull()).select(law), law, "left_semi").withColumn("why", F.lit("no_date"))
    return absent.unionByName(undated)


def linked_versions(old: DataFrame, current: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Each old file's single current file of the same keys, or the reason why there is none."""
    matches = current.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(row).alias("current"))
    reason = F.when(F.col("_n").isNull(), "no_current_file").when(F.col("_n") > 1, "several_current_files")
    return old.join(matches, keys, "left").withColumn("reason", reason).withColumn("current", F.when(F.col("_n") == 1, F.col("current"))).drop("_n")


def stated_dates(question: Column, day: Column) -> Column:
    """Whether a date literally stands in a text, as d.m.yyyy, dd.mm.yyyy, d/m/yyyy or with its month's name."""
    spelled = [F.date_format(day, p) for p in ("d.M.yyyy", "dd.MM.yyyy", "d/M/yyyy")]
    months = F.element_at(F.array(*map(F.lit, C.MONTHS)), F.month(day))
    named = F.concat_ws(" ", F.dayofmonth(day).cast("string"), months, F.year(day).cast("string"))
    plain = lower_tr(F.regexp_replace(question, r"\s+", " "))
    whole = lambda s: F.regexp_count(plain, F.concat(F.lit(r"(?<!\d)"), F.regexp_replace(s, r"\.", r"\\."), F.lit(r"(?!\d)"))) > 0
    return day.isNotNull() & (whole(spelled[0]) | whole(spelled[1]) | whole(spelled[2]) | whole(named))
