"""Date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions.text import lower_tr

_SIGN = r"\s*[-/.]\s*"
_NUMERIC = _SIGN.join(f"(?<![0-9])([0-9]{{{n}}})(?![0-9])" for n in ("1,2", "1,2", "4"))  # day, month, year
_NAMED = r"(?<!\d)(\d{1,2})\s+(" + "|".join(C.MONTHS) + r")\s+(\d{4})(?!\d)"


def _of(c: Column) -> Column:
    """The date that a matched string spells, null where there is no such day."""
    month = F.create_map(*[F.lit(x) for i, m in enumerate(C.MONTHS) for x in (m, str(i + 1))])
    part = lambda i: F.when(F.regexp_extract(c, _NUMERIC, i) != "", F.regexp_extract(c, _NUMERIC, i))
    named = lambda i: F.when(F.regexp_extract(lower_tr(c), _NAMED, i) != "", F.regexp_extract(lower_tr(c), _NAMED, i))
    day, year = F.coalesce(part(1), named(1)), F.coalesce(part(3), named(3))
    text = F.concat_ws("-", year, F.lpad(F.coalesce(part(2), month[named(2)]), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


#: Like a date, but with a year of too few or too many digits.
_MISSHAPEN = _SIGN.join(["(?<![0-9])[0-9]{1,2}"] * 2 + ["[0-9]+"])


def parse_date(c: Column) -> tuple[Column, Column]:
    """(the first date in a text, invalid): numeric dates come before named months. Nothing is guessed:
    invalid where something like a date stands that is no day; a text without such a thing is not."""
    date = _of(c)
    like = c.rlike(_NUMERIC) | lower_tr(c).rlike(_NAMED) | c.rlike(_MISSHAPEN)
    return date, F.coalesce(like & date.isNull(), F.lit(False))


def dates_in(c: Column) -> Column:
    """Sorted distinct valid dates of a text."""
    found = F.concat(F.regexp_extract_all(c, F.lit(_NUMERIC), F.lit(0)), F.regexp_extract_all(lower_tr(c), F.lit(_NAMED), F.lit(0)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, _of), lambda d: d.isNotNull())))


_ANY = f"(?:{_NUMERIC}|{_NAMED})"
#: Fixed value, a pattern: what follows the day in a ruling's last sentence (on that day, unanimously or by majority, it was decided).
_RULED = r"\s*(?:gününde|tarihinde)\s+oy\s*(?:birliğiyle|çokluğuyla)\s+karar\s+verildi"


def _last(c: Column, pattern: str, tail: int) -> Column:
    found = F.regexp_extract_all(lower_tr(F.right(c, F.lit(tail))), F.lit(pattern), F.lit(0))
    return F.when(F.size(found) > 0, _of(F.element_at(found, -1)))


def closing_date(c: Column, tail: int = 1500) -> Column:
    """The last date in the text's end, in numbers or with the month's name."""
    return _last(c, _ANY, tail)


def ruling_date(c: Column, tail: int = 1500) -> Column:
    """The date of the last closing formula in the text's end."""
    return _last(c, _ANY + _RULED, tail)


def compare_dates(a: Column, b: Column, days: int = C.FUZZY_DAYS) -> Column:
    gap = F.abs(F.datediff(a, b))
    return F.when(a.isNull() | b.isNull(), "absent").when(gap == 0, "match").when(gap <= days, "fuzzy").otherwise("mismatch")


def outside_year(date: Column, year: Column, most: int = C.OUTLIER_YEARS) -> Column:
    return F.abs(F.year(date) - year) > most


def year_band(date: Column) -> Column:
    return F.when(date.isNull(), "no date").when(F.year(date) <= 2009, "<=2009").when(F.year(date) <= 2014, "2010-14").otherwise("2015+")
