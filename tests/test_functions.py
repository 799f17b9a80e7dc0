"""Column functions on literals."""

import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import dates as D
from plumbline.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("İSTANBUL ILGAZ", "istanbul ilgaz"), ("  Çok--güzel! ", "cok guzel"), ("", "")])
def test_fold(spark, text, want):
    assert value(spark, T.fold(F.lit(text))) == want


def test_turkish_case(spark):
    assert value(spark, T.lower_tr(F.lit("İI"))) == "iı"
    assert value(spark, T.upper_tr(F.lit("iı"))) == "İI"


@pytest.mark.parametrize(("text", "want"), [("12.03.2018", datetime.date(2018, 3, 12)), ("1 / 2 / 2003", datetime.date(2003, 2, 1)), ("5 Mart 2001", datetime.date(2001, 3, 5)), ("31.02.2001", None), ("1.2.20011", None), ("", None)])
def test_parse_date(spark, text, want):
    date, invalid = D.parse_date(F.lit(text))
    assert value(spark, date) == want
    assert value(spark, invalid) == (want is None and text != "")


def test_dates_in_and_closing(spark):
    text = F.lit("on 01.02.2003 and 31.02.2003 and 3 ocak 2001, then 01.02.2003; 04-05-2006")
    assert value(spark, D.dates_in(text)) == [datetime.date(2001, 1, 3), datetime.date(2003, 2, 1), datetime.date(2006, 5, 4)]
    assert value(spark, D.closing_date(text)) == datetime.date(2006, 5, 4)


@pytest.mark.parametrize(("a", "b", "want"), [("2020-01-01", "2020-01-01", "match"), ("2020-01-01", "2020-01-04", "fuzzy"), ("2020-01-01", "2020-01-05", "mismatch"), (None, "2020-01-05", "absent")])
def test_compare_dates(spark, a, b, want):
    assert value(spark, D.compare_dates(F.lit(a).cast("date"), F.lit(b).cast("date"))) == want


def test_shingles_at_the_edges(spark):
    four, five = "a b c d", "a b c d e"
    assert value(spark, T.shingles(F.lit(four))) == []
    assert value(spark, T.shingles(F.lit(five))) == [five]
    assert value(spark, T.raw_shingles(F.lit(four))) == [four]


@pytest.mark.parametrize(("text", "want"), [("2017/12-345", ("2017/345", "12")), ("2017 / 0345 (7)", ("2017/345", "7")), ("2017/8", ("2017/8", None)), ("x", (None, None))])
def test_case_number(spark, text, want):
    number, division = T.case_number(F.lit(text))
    assert (value(spark, number), value(spark, division)) == want


def test_articles_and_parts(spark):
    assert value(spark, T.expanded_articles(F.lit("18-21, 25, ek 2"))) == ["18", "19", "20", "21", "25", "ek 2"]
    assert value(spark, T.expanded_articles(F.lit("1-900"))) == ["1-900"]
    assert value(spark, T.joined(F.lit("a"), F.lit(""), F.lit("b"))) == "a · b"
    assert [value(spark, c) for c in T.split_ref(F.lit("4857 m.18/1"))] == ["4857 m.18", "/1"]


def test_query_terms_cut_before_duplicates_go():
    assert T.query_terms("the the " * 8 + "last") == ["the"]


def test_clean_text(spark):
    assert value(spark, T.clean_text(F.lit("ke-\nlime​ a b\r\n• x"))) == "kelime a b\n- x"
    assert value(spark, T.wording(F.lit("“x” – y ."))) == '"x" - y.'


def test_page_of(spark):
    assert value(spark, T.page_of(F.lit("ab\fcd\fef"), F.lit(6))) == 3


def test_keys_of_numbers_mails_and_forms(spark):
    from plumbline.functions import text as T

    rows = [("2017/016188", "2017/16188"), ("2024/10-389", "2024/389"), (" Esas No: Ç ", "esas no c"), (None, None)]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.number_key(F.col("raw"))).collect())
    one = spark.range(1).select(T.progressive_forms(F.lit("Geliyor, bekliyoruz; geliyor. Yoruldu görüyor görüyor")).alias("f"), T.email_key(F.lit("  A@B.Org ")).alias("m")).first()
    assert one["f"] == ["Geliyor", "bekliyoruz", "geliyor", "görüyor"] and one["m"] == "a@b.org"


@pytest.mark.parametrize(("text", "want", "bad"), [("07.06.2004 tarihinde", datetime.date(2004, 6, 7), False), ("hello", None, False), ("tarihsiz", None, False), (None, None, False), ("21.05 .2013", datetime.date(2013, 5, 21), False), ("07.06.2023T.C", datetime.date(2023, 6, 7), False), ("23.00.2010", None, True), ("08/04/20219", None, True), ("12.05.20", None, True), ("7.6.200", None, True), ("on 8 HAZİRAN 2004", datetime.date(2004, 6, 8), False), ("31 Haziran 2004", None, True), ("5 adet 2004", None, False)])
def test_dates_anywhere(spark, text, want, bad):
    date, invalid = D.parse_date(F.lit(text).cast("string"))
    assert (value(spark, date), value(spark, invalid)) == (want, bad)


def test_closing_dates_with_month_names(spark):
    assert value(spark, D.closing_date(F.lit("x 01.02.2003, sonra 8 Haziran 2004 gününde oy birliğiyle karar verildi"))) == datetime.date(2004, 6, 8)
    ruled = "3.4.2001 gününde oybirliğiyle karar verildi. 8.6.2004 tarihinde oy çokluğuyla karar verildi. 9.9.2009"
    assert value(spark, D.ruling_date(F.lit(ruled))) == datetime.date(2004, 6, 8)
    assert value(spark, D.ruling_date(F.lit("8 Haziran 2004 gününde oybirliğiyle karar verildi"))) == datetime.date(2004, 6, 8)
    assert value(spark, D.ruling_date(F.lit("9.9.2009 tarihinde görüşüldü"))) is None


@pytest.mark.parametrize(("text", "want"), [("2017/(7) 12-345", ("2017/345", "12")), ("E. 2017/345", ("2017/345", None)), ("2001/(7)22-1234", ("2001/1234", "22")), ("2001/27016 E", ("2001/27016", None)), ("2010 / 37635", ("2010/37635", None)), ("2017/1234567", (None, None))])
def test_case_numbers_in_texts(spark, text, want):
    assert tuple(value(spark, c) for c in T.case_number(F.lit(text))) == want


def test_names_without_signs(spark):
    assert value(spark, T.name_key(F.lit("Rapor_v2 (son)"))) == "rapor v2 son"
    assert value(spark, T.stem_key(F.lit("KANUN-5510, ek.udf"))) == value(spark, T.stem_key(F.lit("Kanun 5510 (Ek).pdf"))) == "kanun 5510 ek"
    assert value(spark, T.name_key(F.lit("--- "))) == ""


@pytest.mark.parametrize(("raw", "want"), [("2020/10-001234567", "2020/1234567"), ("2020/1234567", "2020/1234567"), ("2020/10-12a", "2020 10 12a"), ("2017 / 0345 (7)", "2017/345"), ("2017/(7) 12-345", "2017/345"), ("2017/12 - x", "2017/12")])
def test_number_keys_of_any_length(spark, raw, want):
    assert value(spark, T.number_key(F.lit(raw))) == want
