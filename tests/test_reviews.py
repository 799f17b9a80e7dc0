"""Review screens, cleaned texts and compared forms on awkward values."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import reviews as R


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("edits", "kind", "want"), [('{"f": 5}', "number", 5), ('{"f": "5"}', "number", 1), ('{"f": null}', "number", 1), ("{}", "number", 1), ("bad", "number", 1), (None, "number", 1), ('{"f": [1]}', "number", 1)])
def test_typed_numbers(spark, edits, kind, want):
    assert value(spark, R.typed_overlay(F.lit(1).cast("long"), F.lit(edits).cast("string"), "f", kind)) == want


def test_typed_strings(spark):
    over = lambda edits: value(spark, R.typed_overlay(F.lit("base"), F.lit(edits), "f", "string"))
    assert [over(e) for e in ('{"f": "x"}', '{"f": 5}', '{"f": true}', '{"f": ""}')] == ["x", "base", "base", ""]


def test_pages_go_through_all_rows_once(spark):
    rows = [(i, datetime(2020, 1, 1 + i % 3)) for i in range(11)] + [(None, datetime(2020, 1, 1)), (50, None)]
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz")
    mark, seen, pages = None, [], 0
    while pages < 9:
        page = R.page_after(df, "at", "id", mark, 4).collect()
        seen += [r["id"] for r in page]
        pages, mark = pages + 1, page[0]["next"] if page else None
        assert len({r["next"] for r in page}) <= 1
        if mark is None:
            break
    assert seen == [i for i, _ in sorted(rows[:11], key=lambda r: (r[1], r[0]), reverse=True)] and pages == 3
    assert R.page_after(df.limit(0), "at", "id", None, 4).count() == 0


def test_bulk_runs_stop_when_the_count_has_changed(spark):
    df = spark.range(10)
    page, left = R.bulk_page(df, "id", 3, 6, 4)
    assert sorted(r[0] for r in page.collect()) == [4, 5, 6, 7] and left == 2
    with pytest.raises(R.CountChanged):
        R.bulk_page(df, "id", None, 9, 4)


def test_questions(spark):
    facts = spark.createDataFrame([("c1", "t", "b", "unknown"), ("c1", "t", "a", "unknown"), ("c1", "t", "a", "unknown"), ("c1", "t", "minor", "unknown"), ("c2", "t", "a", "known"), ("c3", "other", "a", "unknown")], "case string, topic string, key string, status string")
    template = spark.createDataFrame([("t", "a", 2, True, "A?"), ("t", "b", 1, True, "B?"), ("t", "minor", 3, False, "M?")], "topic string, key string, place int, critical boolean, text string")
    bases = spark.createDataFrame([("t", "a", "r2"), ("t", "a", "r1"), ("t", "a", "gone")], "topic string, key string, ref string")
    sources = spark.createDataFrame([("r1", "s1"), ("r2", "s2"), ("r2", "s3")], "ref string, source string")
    got = [tuple(r) for r in R.open_questions(facts, template, bases, sources).orderBy("case", "number").collect()]
    assert got == [("c1", 1, "b", "B?", []), ("c1", 2, "a", "A?", ["r1", "r2"])]


def test_answers_break_rules(spark):
    schema = "id int, status string, cited array<string>, read array<string>, read_kinds array<string>, stated map<string,int>, fact_keys array<string>, unknown_facts array<string>, missing_info int, points int, short_points int, unknown_rows int, law_day date, law_text string"
    day, text = date(2026, 10, 3), "03.10.2026 tarihinde"
    rows = [
        (1, "definite", ["a"], ["a", "b", "a"], ["x", "y", "x"], {"x": 1, "y": 1}, ["k"], None, 0, 2, 2, 0, day, text),
        (2, "definite", ["c"], ["a"], ["x"], {"x": 2}, ["k", "k"], ["k"], 1, 1, 2, 1, day, "no day"),
        (3, "conditional", None, ["a"], ["x"], {"x": 1, "z": 0}, None, ["k"], None, None, None, 3, None, None),
        (4, "conditional", None, ["a"], ["x"], None, None, None, 2, 1, 1, None, day, text),
    ]
    got = {r["id"]: r["problems"] for r in R.consistent(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == [] and got[4] == ["count_differs"] and got[3] == ["conditional_without_missing_info", "law_text_without_day"]
    assert got[2] == ["repeated_fact_key", "count_differs", "short_count_exceeds_points", "definite_with_missing_info", "definite_on_unknown_fact", "definite_with_unknown_row", "cites_unread", "law_text_without_day"]


def test_outliers_prefer_the_printed_year(spark):
    rows = [(1, "a", 2010, date(2014, 1, 1)), (2, "a", None, date(2014, 1, 1)), (3, "a", None, date(2013, 1, 1)), (4, "a", None, date(2001, 1, 1)), (5, None, None, date(1900, 1, 1)), (6, "b", None, None), (7, None, 2010, date(2013, 1, 1))]
    got = {r["id"]: (r["reference"], r["outside"]) for r in R.outside_issue(spark.createDataFrame(rows, "id int, issue string, printed int, day date"), "issue", "printed", "day").collect()}
    assert got == {1: (2010, True), 2: (2013, False), 3: (2013, False), 4: (2013, True), 5: (None, False), 6: (None, False), 7: (2010, False)}


@pytest.mark.parametrize(("text", "want"), [("kıdem-\ntazminatı", "kıdemtazminatı"), ("kıdem-\nve ihbar", "kıdem-\nve ihbar"), ("x-\nve-\nc", "xvec"), ("x-\nve-\nde-\nc", "xvedec"), ("a-\nb-\nc", "abc"), ("İşK-\n18", "İşK-\n18"), ("gün", "gün"), ("a⁠b c\r\nd", "ab c\nd"), ("değil-\nya da", "değil-\nya da"), ("e-\nyarın", "eyarın"), (None, None), ("", "")])
def test_clean_text_to_the_end(spark, text, want):
    assert value(spark, T.clean_text(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("text", "numbers", "want"), [("kesilmesi47 ve", [47], "kesilmesi ve"), ("son.4748", [47, 48], "son."), ("fıkra (4) ve (5)", [5], "fıkra (4) ve"), ("madde 47 ve 18/47", [47], "madde 47 ve 18/47"), ("x (47)(48)", [47, 48], "x"), ("a47", [], "a47"), ("a47", None, "a47")])
def test_markers(spark, text, numbers, want):
    assert value(spark, T.without_markers(F.lit(text), F.lit(numbers).cast("array<int>") if numbers is None else F.array(*map(F.lit, numbers)).cast("array<int>"))) == want


def test_references(spark):
    assert value(spark, T.canonical_ref(F.lit("Yargıtay 9. HD  03.10.2026 2015/1 E., "))) == "9. hd 2015/1 e"
    assert value(spark, T.canonical_ref(F.lit("4857 M.18"))) == "4857 m.18"
