"""Structure in texts."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from plumbline.operators import parsing as P


@pytest.mark.parametrize(("text", "want"), [("I. DAVA\nx", "new_template"), ("Esas No.\nKarar No.\nTarihi:\n", "two_column"), ("Özeti: a\nEsas No: 1", "summary_first"), ("Esas No: 1\nÖzeti: a", "classic"), ("x", "unknown")])
def test_layout(spark, text, want):
    assert spark.range(1).select(P.layout(F.lit(text))).first()[0] == want


def test_document_type(spark):
    kind = lambda t: spark.range(1).select(P.document_type(F.lit(t)).alias("x")).first()["x"]
    assert tuple(kind("a\nKanun  Numarası: 5\nKanun Numarası :  4857 b")) == ("statute", "Kanun Numarası : 4857")
    assert kind("2024/5 SAYILI GENELGE")["type"] == "circular"
    assert kind("nothing") is None


def test_notes(spark):
    text = "Madde (Değişik birinci fıkra: 12/10/2017-7036/11 md.) ve (Ek: 1/2/2003-KHK-5/6 md.; Mülga: 3/4/2005-77/8 md.) (Ek: bozuk) (başka)"
    df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    got = sorted((r["char_start"], r["kind"] or "", r["scope"], r["day"], r["law"]) for r in P.amendment_notes(df, "id", "text").collect())
    at = text.index("(Ek: 1")
    assert got[0] == (6, "amended", "birinci fıkra", date(2017, 10, 12), "7036")
    assert got[1:3] == [(at, "added", "", date(2003, 2, 1), "KHK-5"), (at, "repealed", "", date(2005, 4, 3), "77")]
    assert got[3][1] == "" and got[3][0] == text.index("(Ek: bozuk")


def test_notes_of_courts_and_brackets():
    text = "a (b (c) Madde) (İptal: Anayasa Mahkemesinin 12/3/2010 tarihli ve E.: 2009/1, K.: 2010/2 sayılı Kararı ile.) (Ek fıkra: 31/2/2010-5/6) (Başlığı ile birlikte değişik: 1/2/2003-9/10 md.) ((x) y"
    got = P.notes_in(text)
    assert [g[:5] for g in got] == [("annulled", "", date(2010, 3, 12), None, "E. 2009/1 K. 2010/2"), (None,) * 5, ("amended", "", date(2003, 2, 1), "9", "10")]
    assert [i for _, i in P.brackets("((a) b) c) (d")] == ["(a) b"]


def test_articles(spark):
    text = "Amaç\nMadde 1 – Bir.\nKapsam\nMadde 2 – İki.\nMadde 4 - Dört.\nEk Madde 1 – Ek.\nMadde 3 – Üç."
    rows = P.articles(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").orderBy("ordinal").collect()
    assert [(r["article_no"], r["heading"], r["warning"]) for r in rows] == [("1", "Amaç", None), ("2", "Kapsam", None), ("4", "", "skipped_number"), ("Ek 1", "", None), ("3", "", "out_of_order")]


def test_locate(spark):
    assert P.locate("the  quick\nbrown", "quick brown") == (5, 16)
    assert P.locate("unquick brown", "quick") is None
    assert P.locate("x", "") is None
    df = spark.createDataFrame([("a b", "b"), ("a", None), (None, "a")], "t string, q string")
    assert [(r["char_start"], r["char_end"]) for r in P.located(df, "t", "q").collect()] == [(2, 3), (None, None), (None, None)]


def test_compared(spark):
    rows = [("a b c", "a  b c"), ("a b c d e", "a b x d e"), ("a b c", "x y z w"), (None, "a b c d")]
    got = [r["change"] for r in P.compared(spark.createDataFrame(rows, "o string, n string"), "o", "n").collect()]
    assert got == ["unchanged", "uncertain", "changed", "changed"]


def test_registry_rules(spark):
    acts = spark.createDataFrame([("1", None, "2001", "u1"), ("2", "1", "2002", None), ("3", "9", "2003", None)], "law string, alias string, day string, url string")
    got = {r["law"]: (r["url"], r["day"], r["bad_alias"]) for r in P.with_aliases(acts, "law", "alias", ["day"]).collect()}
    assert got == {"1": ("u1", "2001", False), "2": ("u1", "2002", False), "3": (None, "2003", True)}
    cited = spark.createDataFrame([("1",), ("7",), ("8",)], "law string")
    known = spark.createDataFrame([("1", "x"), ("8", None)], "law string, day string")
    assert {(r["law"], r["why"]) for r in P.missing_references(cited, known, "law", "day").collect()} == {("7", "missing"), ("8", "no_date")}


def test_linked_versions(spark):
    old = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "c")], "folder string, name string")
    current = spark.createDataFrame([("f", "a", 1), ("f", "b", 2), ("f", "b", 3)], "folder string, name string, id long")
    got = {r["name"]: (r["current"], r["reason"]) for r in P.linked_versions(old, current, ["folder", "name"], "id").collect()}
    assert got == {"a": (1, None), "b": (None, "several_current_files"), "c": (None, "no_current_file")}


def test_stated_dates(spark):
    q = F.lit("on 5.3.2020 or 06.07.2021")
    assert tuple(spark.range(1).select(*[P.stated_dates(q, F.lit(d).cast("date")) for d in ("2020-03-05", "2021-07-06", "2022-01-01")]).first()) == (True, True, False)


def test_notes_of_courts_without_numbers_and_brackets_with_a_bad_item():
    text = "(İptal cümle: Anayasa Mahkemesi’nin 25/12/2014 tarihli Kararı ile.) (Ek: 1/2/2003-5/6 md.; Mülga: tarihsiz) (İptal: 3/4/2005) (Ek: 32/13/2017-7036/11 md.)"
    got = P.notes_in(text)
    assert got[0][:5] == ("annulled", "cümle", date(2014, 12, 25), None, "")
    assert [g[:5] for g in got[1:]] == [(None,) * 5] * 3
    assert got[1][5] == "Ek: 1/2/2003-5/6 md.; Mülga: tarihsiz"


def test_article_heads():
    text = "MADDE 1- Bir\n  Ek Madde 12/A – iki\nGEÇİCİ MADDE 3\t—üç\nMadde x - no\nMadde 5 no dash\nEk 6 - no\n Madde 7-\nSözMadde 8 - no\nMadde 9 / A - no"
    got = [(series + no, text[begin:].split("\n")[0]) for _, begin, series, no in P.article_heads(text)]
    assert got == [("1", "Bir"), ("Ek 12/A", "iki"), ("Geçici 3", "üç"), ("7", "")]


def test_stated_dates_with_month_names(spark):
    q = F.lit("15.3.2020 günü, 5  MAYIS 2021 ve 07.08.20190")
    assert tuple(spark.range(1).select(*[P.stated_dates(q, F.lit(d).cast("date")) for d in ("2021-05-05", "2020-03-05", "2020-03-15", "2019-08-07", None)]).first()) == (True, False, True, False, False)
