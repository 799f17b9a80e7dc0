"""Names in one spelling, and records held against an official source."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.operators import verification as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("Yargıtay 9. Hukuk Dairesi", "9 HD"), ("9. HD", "9 HD"), ("12.D.", "12 D"), ("5. Daire", "5 D"), ("3. Ceza Dairesi", "3 CD"), ("Hukuk Genel Kurulu", "HGK"), ("YARGITAY CGK", "CGK"), ("İçtihadı Birleştirme Büyük Genel Kurulu", "IBK"), ("Başka Kurul", "baska kurul"), ("", None), (None, None)])
def test_chambers(spark, raw, want):
    assert value(spark, N.canonical_chamber(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [("İstanbul Bölge Adliye Mahkemesi 5. HD", "istanbul"), ("Istanbul BAM", "istanbul"), ("9. HD", ""), ("bambu", "")])
def test_regions(spark, raw, want):
    assert value(spark, N.appeal_region(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("gecici-4", "Geçici 4"), ("ek-2", "Ek 2"), ("18-a", "18/A"), ("18/A", "18/A"), ("18i", "18/İ"), ("gecici-79-2", "Geçici 79 (2)"), ("79 (2)", "79 (2)"), ("Geçici  79 (2)", "Geçici 79 (2)"), ("GEÇİCİ 4", "Geçici 4"), (" madde  5 ", "madde 5"), ("18", "18")])
def test_articles(spark, raw, want):
    assert value(spark, N.article_number(F.lit(raw))) == want


def test_field_vectors(spark):
    day = date(2015, 3, 4)
    ours = [(i, f"2015/{i}", "2016/9", "9. HD", None, day) for i in range(1, 11)] + [(11, None, None, None, None, None), (12, "2015/12", "2016/9", None, "Ankara", None), (13, "2015/13", "2016/9", "9. HD", None, day)]
    official = [
        ("a1", "2015/01", "2016/10-9", "Yargıtay 9. Hukuk Dairesi", day), ("b2", "2015/2", "2016/9", "9. HD", date(2015, 3, 6)), ("a3", "2015/3", "2016/9", "8. HD", day), ("a4", "2015/4", "2016/9", "9. HD", None), ("a5", "2015/5", "2016/9", "9. HD", day), ("b5", "2015/5", "2016/9", "9. HD", day),
        ("a6", "2015/6", "2016/9", "9. HD", date(2015, 3, 5)), ("b6", "2015/6", "2016/9", "9. HD", day), ("a7", "2015/7", "2016/8", "9. HD", day), ("a8", "2015/8", "2016/9", "9. HD", date(2015, 4, 5)), ("b8", "2015/8", "2016/9", "8. HD", day), ("a12", "2015/12", "2016/9", "Ankara BAM 5. HD", day), ("a13", "2015/13", "2016/9", "İzmir BAM 9. HD", day),
    ]
    keys = "esas_no string, karar_no string, chamber string,"
    df = spark.createDataFrame(ours, f"r int, {keys} bam_region string, decision_date date")
    source = spark.createDataFrame(official, f"ref string, {keys} decision_date date")
    got = {r["r"]: r for r in V.field_vectors(df, source, "r").collect()}
    assert {k: (r["verdict"], r["ref"]) for k, r in got.items() if k < 12} == {1: ("verified", "a1"), 2: ("verified", "b2"), 3: ("mismatch", "a3"), 4: ("mismatch", "a4"), 5: ("mismatch", "a5"), 6: ("verified", "b6"), 7: ("not_in_source", None), 8: ("mismatch", "a8"), 9: ("not_in_source", None), 10: ("not_in_source", None), 11: ("not_in_source", None)}
    assert got[2]["fuzzy"] == ["decision_date"] and got[5]["ambiguous"] and got[4]["date_unparseable"] and got[8]["candidates"] == 2
    assert (got[12]["verdict"], got[12]["bam_region"], got[12]["chamber"], got[12]["decision_date"]) == ("verified", "match", "absent", "absent")
    assert got[13]["bam_region"] == "absent" and got[13]["verdict"] == "verified"


def test_evidence_of_headings(spark):
    heading = F.lit("Yargıtay HGK 2024/10-0389 E., 2023 / 22 - 77 K., 2024/10-3891")
    cases = [("2024/389", "10", "match"), ("2024/389", "9", "fuzzy"), ("2023/22-077", "22", "match"), ("2024/38", "10", "fuzzy"), ("2024/389", "", "absent"), (None, "10", "absent")]
    for number, division, want in cases:
        assert value(spark, V.heading_evidence(heading, F.lit(number).cast("string"), F.lit(division))) == want
    assert value(spark, V.heading_evidence(F.lit(None).cast("string"), F.lit("2024/1"), F.lit("2"))) == "fuzzy"


def test_old_records_are_skipped_while_a_sample_allows_it(spark):
    ours = spark.createDataFrame([(1, "2005/1", "2006/1", "9. HD", None, date(2006, 1, 1), None), (2, "2015/2", "2015/3", "9. HD", None, date(2015, 1, 1), "10"), (3, "2015/9", "2015/9", "9. HD", None, date(2015, 1, 1), None)], "r int, esas_no string, karar_no string, chamber string, bam_region string, decision_date date, source_chamber string")
    source = spark.createDataFrame([("x", "2015/2", "2015/3", "9. HD", date(2015, 1, 2)), ("y", "2015/9", "2015/9", "8. HD", date(2015, 1, 1))], "ref string, esas_no string, karar_no string, chamber string, decision_date date")
    texts = spark.createDataFrame([("x", "<p>2015/10-2</p> text")], "ref string, body string")
    assert V.heuristic_holds(ours, source, "r")
    got = {r["r"]: (r["outcome"], r["ref"], r["why"], r["source_chamber"], r["text_sha256"] is not None) for r in V.verified(ours, source, texts, "r").collect()}
    assert got == {1: ("not_in_source", None, "pre_2009_heuristic", None, False), 2: ("verified", "x", "decision_date", "match", True), 3: ("mismatch", "y", "", None, False)}
    held = source.unionByName(spark.createDataFrame([("z", "2005/1", "2006/1", "9. HD", date(2006, 1, 1))], source.schema))
    assert not V.heuristic_holds(ours, held, "r")
    assert {r["r"]: r["outcome"] for r in V.verified(ours, held, texts, "r", skip_old=False).collect()}[1] == "verified"


def test_numbers_of_seven_digits_are_matched(spark):
    day = date(2015, 3, 4)
    keys = "esas_no string, karar_no string, chamber string,"
    ours = spark.createDataFrame([(i, f"2020/{i}", f"2020/{i}", "9. HD", None, day) for i in (999_999, 1_000_000, 1_000_001, 12_345_678)], f"r int, {keys} bam_region string, decision_date date")
    official = [("a", "2020/10-00999999", "2020/999999", "9. HD", day), ("b", "2020/10-001000000", "2020/1000000", "9. HD", day), ("c", "2020/1000001", "2020/1000001", "9. HD", day), ("d", "2020 / 123 - 12345678", "2020/012345678", "9. HD", day)]
    source = spark.createDataFrame(official, f"ref string, {keys} decision_date date")
    got = {r["r"]: (r["verdict"], r["ref"], r["candidates"]) for r in V.field_vectors(ours, source, "r").collect()}
    assert got == {999_999: ("verified", "a", 1), 1_000_000: ("verified", "b", 1), 1_000_001: ("verified", "c", 1), 12_345_678: ("verified", "d", 1)}
