"""Text functions as column expressions (no Python in the plan but for ``composed``)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import config as C

WORD = r"\S+"
LETTERS = r"\p{L}+"


def lower_tr(c: Column) -> Column:
    """Turkish lower case: dotted and dotless i are told apart."""
    return F.lower(F.translate(c, "İI", "iı"))


def upper_tr(c: Column) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))


def _plain(c: Column) -> Column:
    return F.translate(lower_tr(c), "çğışöüâîû", "cgisouaiu")


def fold(c: Column) -> Column:
    """Lower case without diacritics, runs of other characters as one space."""
    return F.trim(F.regexp_replace(_plain(c), "[^a-z0-9]+", " "))


def folded_words(c: Column) -> Column:
    """The words of ``fold``."""
    return F.regexp_extract_all(_plain(c), F.lit("[a-z0-9]+"), F.lit(0))


def name_key(c: Column) -> Column:
    """Letters and digits of a name without case and accents, every run of other characters as one space."""
    return F.trim(F.regexp_replace(_plain(c), r"[^\p{L}\p{N}]+", " "))


def stem_key(c: Column) -> Column:
    return name_key(F.regexp_replace(c, r"\.[^.]+$", ""))


def ref_key(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(_plain(c), r"[^\p{L}\p{N}]", "")


skeleton = ref_key


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def estimate_tokens(c: Column) -> Column:
    return F.bround(word_count(c) * F.lit(C.TOKENS_PER_WORD)).cast("long")


def letter_tokens(c: Column) -> Column:
    return F.regexp_extract_all(lower_tr(c), F.lit(LETTERS), F.lit(0))


def stop_share(tokens: Column, language: Column) -> Column:
    """Share of ``tokens`` among the stop words of their language (0 for other languages); null without tokens."""
    among = lambda stops: F.size(F.filter(tokens, lambda t: t.isin(*stops)))
    hits = F.lit(0)
    for name, stops in C.STOP_WORDS.items():
        hits = F.when(language == name, among(stops)).otherwise(hits)
    return F.when(F.size(tokens) > 0, hits / F.size(tokens))


def bound(value: Column, use) -> Column:
    """use(value) with ``value`` evaluated once, even where lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _grams(w: Column, n: int, last: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, n), " "))


def shingles(c: Column, n: int = C.SHINGLE_WORDS) -> Column:
    """Distinct n-word shingles of the folded text; none below n words."""
    none = F.array().cast("array<string>")
    return bound(folded_words(c), lambda w: F.array_distinct(F.when(F.size(w) >= n, _grams(w, n, F.size(w) - n + 1)).otherwise(none)))


def shingle_hashes(c: Column, n: int = C.SHINGLE_WORDS) -> Column:
    """``shingles`` as 64-bit hashes of their words, without building their texts."""
    none = F.array().cast("array<bigint>")
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))
    return bound(F.transform(folded_words(c), lambda x: F.xxhash64(x)), lambda w: F.array_distinct(F.when(F.size(w) >= n, grams(w)).otherwise(none)))


def raw_shingles(c: Column, n: int = C.SHINGLE_WORDS) -> Column:
    """Shingles of white-space words, at least one."""
    return bound(words(c), lambda w: F.array_distinct(_grams(w, n, F.greatest(F.size(w) - n + 1, F.lit(1)))))


#: Words that may stand alone after a suspended hyphen at a line's end.
CONJUNCTIONS = ("ve", "veya", "ile", "ya", "de", "da", "mi", "mı", "mu", "mü")


def composed(c: Column) -> Column:
    """NFC. Only texts with combining marks leave the JVM."""

    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.coalesce(nfc(F.when(c.rlike(r"\p{M}"), c)), c)


def clean_text(c: Column) -> Column:
    """Invisible characters out, space variants to spaces, NFC, line ends to LF, wrapped words joined, bullets to dashes.

    A word at a line's end is joined with the next one unless that is a conjunction. Joining can make
    another word of a conjunction, so it is done once more than conjunctions follow each other that way.
    """
    c = F.regexp_replace(c, "[\u200b-\u200f\u2060\u00ad\ufeff]", "")
    c = F.regexp_replace(c, "[\u00a0\u2000-\u200a\u202f\u3000]", " ")
    c = F.regexp_replace(composed(c), "\r\n?", "\n")
    stays = "|".join(CONJUNCTIONS)
    join = lambda t: F.regexp_replace(t, rf"(?<=\p{{Ll}})-\n(?!(?:{stays})(?!\p{{L}}))(?=\p{{Ll}})", "")
    again = F.regexp_count(c, F.lit(rf"(?<!\p{{L}})(?:{stays})-\n"))
    c = F.aggregate(F.sequence(F.lit(0), again), join(c), lambda t, _: join(t))
    return F.regexp_replace(c, "(?m)^[ \t]*[•▪●◦‣⚫][ \t]*", "- ")


def wording(c: Column) -> Column:
    """What stays when layout is ignored: quotes and dashes unified, white space and spaces before signs collapsed."""
    c = F.regexp_replace(F.regexp_replace(c, "[“”„‟«»]", '"'), "[‘’`´]", "'")
    c = F.regexp_replace(F.regexp_replace(c, "[–—−‐‑]", "-"), r"\s+", " ")
    return F.trim(F.regexp_replace(c, r" ([,.;:!?)])", "$1"))


def without_markers(c: Column, numbers: Column) -> Column:
    """A text without the footnote markers of the given ``numbers`` (an array of int): in brackets, or glued to a word's or sentence's end.

    Other digits stay, so a changed cross reference is a change. Glued markers may follow each other.
    """
    # Fixed values, patterns: where a marker may stand.
    either = F.concat(F.lit("(?:"), F.array_join(numbers.cast("array<string>"), "|"), F.lit(")"))
    bracketed = F.concat(F.lit(r"(?<=[^\s(])[ \t]*\("), either, F.lit(r"\)(?=\s|$|\()"))
    glued = F.concat(F.lit(r"(?<=[^\s\p{N}_(/\-])"), either, F.lit(r"+(?=\s|$)"))
    return F.when(F.coalesce(F.size(numbers), F.lit(0)) > 0, F.regexp_replace(F.regexp_replace(c, bracketed, F.lit("")), glued, F.lit(""))).otherwise(c)


def canonical_ref(c: Column) -> Column:
    """A reference as it is compared: Turkish lower case, without dates, the court's name and signs at its end."""
    text = F.regexp_replace(lower_tr(c), r"(?<!\d)\d{1,2}[./]\d{1,2}[./]\d{4}(?!\d)", " ")
    text = F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("yargıtay "), F.lit(""))
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^[ ,;.]+|[ ,;.]+$", "")


def content_hash(header: Column, text: Column) -> Column:
    return F.sha2(F.when(F.length(header) > 0, F.concat(header, F.lit("\n\n"), text)).otherwise(text), 256)


def joined(*parts: Column, by: str = " · ") -> Column:
    """Non-empty parts, joined."""
    return F.concat_ws(by, *[F.when(p != "", p) for p in parts])


def case_number(c: Column) -> tuple[Column, Column]:
    """('YYYY/N', division) of the first number such as 2017/12-345, '2017 / 345 (7)' or 2017/(7) 12-345 in a text.

    A bracketed number before the division is a slip and ignored; behind the number it is the division.
    """
    year, slip, division, number = r"(\d{4})\s*/\s*", r"(?:\(\d+\)\s*)?", r"(?:(\d{1,2})\s*-\s*)?", r"0*(\d{1,6})(?!\w)"
    pattern = year + slip + division + number + r"(?:\s*\((\d+)\))?"
    part = lambda i: F.regexp_extract(c, pattern, i)
    found = F.when(part(1) != "", F.concat(part(1), F.lit("/"), part(3)))
    return found, F.when(part(2) != "", part(2)).when(part(4) != "", part(4))


def expanded_articles(c: Column, most: int = 200) -> Column:
    """'18-21, 25' as an array of article numbers; other tokens stay."""
    low = lambda t: F.regexp_extract(t, r"^(\d+)-(\d+)$", 1).try_cast("int")
    high = lambda t: F.regexp_extract(t, r"^(\d+)-(\d+)$", 2).try_cast("int")
    item = lambda t: F.when(F.coalesce((high(t) >= low(t)) & (high(t) - low(t) <= most), F.lit(False)), F.transform(F.sequence(low(t), high(t)), lambda x: x.cast("string"))).otherwise(F.array(t))
    return F.flatten(F.transform(F.filter(F.split(c, r"\s*,\s*"), lambda t: t != ""), item))


def query_terms(text: str, most: int = 16) -> list[str]:
    """Search terms: words of three or more characters; the cut comes before the duplicates go."""
    import re

    found = [m for m in re.findall(r"\w+", text.lower()) if len(m) >= 3][:most]
    return list(dict.fromkeys(found))


def like_pattern(c: Column) -> Column:
    """A substring as a LIKE pattern with its signs escaped."""
    escaped = F.regexp_replace(c, r"([\\%_])", r"\\$1")
    return F.concat(F.lit("%"), escaped, F.lit("%"))


def file_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(c), r"\.([^.]+)$", 1))


def excerpt(c: Column, pages: int = 2, chars: int = 6000) -> Column:
    return F.substring(F.substring_index(c, "\f", pages), 1, chars)


def page_of(c: Column, offset: Column) -> Column:
    before = F.substring(c, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\f"), F.lit(""))) + 1


def plain_heading(html: Column, most: int = 1500) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " ")), 1, most)


def split_ref(c: Column) -> tuple[Column, Column]:
    """'4857 m.18/1' as ('4857 m.18', '/1')."""
    return F.regexp_extract(c, r"^([^/]*)(/.*)?$", 1), F.regexp_extract(c, r"^([^/]*)(/.*)?$", 2)


def covers(ref: Column, read: Column) -> Column:
    """Whether a cited reference is the read one or a part of it."""
    return (ref == read) | ref.startswith(F.concat(read, F.lit("/"))) | ref.startswith(F.concat(read, F.lit(" ")))


def normal_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def holds_quote(text: Column, quote: Column) -> Column:
    """Whether ``text`` holds ``quote``, white space aside."""
    return F.contains(normal_space(text), normal_space(quote))


def number_key(c: Column) -> Column:
    """YYYY/N of a case number of any length, its division and leading zeros left out; anything else folded.

    A division is never taken for the number, whatever follows it.
    """
    pattern = r"(\d{4})\s*/\s*(?:\(\d+\)\s*)?(?:\d+\s*-\s*(?=\d))?+0*(\d+)(?!\w)"
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(part(1) != "", F.concat(part(1), F.lit("/"), part(2))).otherwise(fold(c))


def progressive_forms(c: Column) -> Column:
    """The distinct words with -iyor (or its vowel variants), sorted. The pattern is a fixed value."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?iuU)\b\w*[ıiuü]yor\w*\b"), F.lit(0))))


def email_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def token_digest(c: Column) -> Column:
    return F.sha2(c, 256)
