"""Published tables and their merges: stale bases, repeats, refusals."""

import datetime
from datetime import date

import pytest
from pyspark.sql import functions as F

from plumbline.operators import snapshots as S
from plumbline.session import shared_dir

at = lambda: F.lit("2022-01-01").cast(S.STAMP)
LIVE = "k int, extraction int, extracted_at timestamp_ntz, valid_from date, valid_to date, text string, recorded_at timestamp_ntz, superseded_at timestamp_ntz"
WANTED = "k int, extraction int, extracted_at timestamp_ntz, verdict string, versions array<struct<valid_from:date,valid_to:date,text:string>>"
T = lambda n: datetime.datetime(2020, 1, n)


def test_one_of_two_publishers_is_refused(spark):
    path = shared_dir(spark, "test")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "n int")
    assert S.newest(spark, path) == (0, None)
    assert S.commit(rows(1), path, 0) == 1
    base, before = S.newest(spark, path)
    assert S.commit(before.unionByName(rows(2)), path, base) == 2
    with pytest.raises(S.StaleBase):
        S.commit(before.unionByName(rows(3)), path, base)
    assert sorted(r[0] for r in before.collect()) == [1]  # a reader keeps its snapshot
    raced = []

    def merge(now):
        if not raced:
            raced.append(S.commit(now.unionByName(rows(7)), path, S.newest(spark, path)[0]))  # someone else is first
        return now.unionByName(rows(4))

    assert S.publish(spark, path, merge) == 4
    assert sorted(r[0] for r in S.newest(spark, path)[1].collect()) == [1, 2, 4, 7]


def test_versions_are_superseded_once_and_refused_with_reasons(spark):
    v = lambda *spans: [(a and date(a, 1, 1), b and date(b, 1, 1), "x") for a, b in spans]
    live = spark.createDataFrame([(1, 5, T(5), date(2001, 1, 1), None, "a", T(9), None), (2, 5, T(5), date(2001, 1, 1), None, "a", T(9), None), (3, 7, T(7), date(2001, 1, 1), None, "a", T(9), None)], LIVE)
    wanted = [
        (1, 6, T(6), "approve", v((2000, 2005), (2005, None))), (2, 5, T(5), None, v((1999, None))), (3, 6, T(6), None, v((2000, None))), (4, 6, T(6), None, v((2000, None))), (5, 6, T(6), "reject", v((2000, None))),
        (6, 6, T(6), None, []), (7, 6, T(6), None, None), (8, 6, T(6), None, v((None, 2000))), (9, 6, T(6), None, v((2000, 2002), (2001, None))), (10, 6, T(6), None, v((2000, None), (2004, None))), (11, 6, T(6), None, v((2000, None))), (11, 8, T(8), None, v((2000, None))),
        (12, 6, T(6), None, v((2005, None), (2000, 2005))),
    ]
    asked = spark.createDataFrame(wanted, WANTED)
    once, outcomes = S.merge_versions(live, asked, "k", ["text"], at())
    want = {1: "superseded", 2: "unchanged", 3: "stale", 4: "inserted", 5: "rejected", 6: "no_version", 7: "no_version", 8: "no_start", 9: "overlap", 10: "overlap", 11: "repeated_key", 12: "inserted"}
    assert {r["k"]: r["outcome"] for r in outcomes.collect()} == want
    assert sorted((r["k"], r["extraction"], r["superseded_at"] is None) for r in once.collect()) == [(1, 5, False), (1, 6, True), (1, 6, True), (2, 5, True), (3, 7, True), (4, 6, True), (12, 6, True), (12, 6, True)]
    twice, again = S.merge_versions(once, asked, "k", ["text"], at())
    assert sorted(twice.collect(), key=str) == sorted(once.collect(), key=str)
    assert {r["k"]: r["outcome"] for r in again.collect()} == want | {1: "unchanged", 4: "unchanged", 12: "unchanged"}


def test_records_with_edits_and_collisions(spark):
    live = spark.createDataFrame([("a", "1", "x", T(1), None), ("b", "1", "x", T(1), T(2))], "court string, no string, text string, recorded_at timestamp_ntz, superseded_at timestamp_ntz")
    rows = [(1, None, "analyzed", "a", "1", "t"), (2, None, "analyzed", "b", "1", "t"), (3, None, "analyzed", "c", "1", "t"), (4, None, "analyzed", "z", "1", "t"), (5, "reject", "analyzed", "d", "1", "t"), (6, None, "failed", "d", "1", "t"), (7, None, None, "d", "1", "t"), (8, None, "analyzed", "", "1", "t"), (9, None, "analyzed", "e", "2", "t"), (10, None, "analyzed", "f", None, "t"), (11, None, "analyzed", "f", None, "t")]
    wanted = spark.createDataFrame(rows, "r int, verdict string, status string, court string, no string, text string")
    edits = spark.createDataFrame([(4, "c", []), (9, None, ["court"])], "r int, set_court string, cleared array<string>")
    out, outcomes = S.merge_records(live, wanted, edits, "r", ["court", "no"], ["court"], at())
    assert {r["r"]: r["outcome"] for r in outcomes.collect()} == {1: "collision", 2: "published", 3: "published", 4: "collision", 5: "rejected", 6: "not_analyzed", 7: "not_analyzed", 8: "incomplete", 9: "incomplete", 10: "published", 11: "published"}
    assert out.count() == 6
    again = S.merge_records(out, wanted, edits, "r", ["court", "no"], ["court"], at())[1].filter("r in (2, 3)")
    assert {r["outcome"] for r in again.collect()} == {"collision"}


def test_refresh_changes_only_what_nobody_edited(spark):
    schema = "k int, version int, text string, whole string, outcome string, recorded_at timestamp_ntz, superseded_at timestamp_ntz"
    live = spark.createDataFrame([(i, None if i == 1 else 5, f"t{i}", "part", None if i != 4 else "won", T(1), None) for i in range(1, 9)] + [(1, 1, "older", "part", None, T(1), T(2))], schema)
    newer = [(1, 1, "n", "full", None), (2, 5, "n", "full", None), (3, 6, "", "full", "lost"), (4, 6, "n", "part", "lost"), (5, 6, "t5", "part", ""), (6, 6, "n", "part", None), (7, 6, "n", "full", "lost")]
    edited = spark.createDataFrame([(6, ["text"]), (7, ["text", "outcome"])], "k int, names array<string>")
    args = (spark.createDataFrame(newer, "k int, version int, text string, whole string, outcome string"), edited, "k", "text", ["whole"], ["outcome"], "version", at())
    once, outcomes = S.refresh(live, *args)
    assert {r["k"]: r["outcome"] for r in outcomes.collect()} == {1: "refreshed", 2: "not_newer", 3: "skipped_same", 4: "refreshed", 5: "skipped_same", 6: "skipped_edits", 7: "refreshed"}
    now = {r["k"]: (r["version"], r["text"], r["whole"], r["outcome"]) for r in once.filter("superseded_at is null").collect()}
    assert now == {1: (1, "n", "full", None), 2: (5, "t2", "part", None), 3: (5, "t3", "part", None), 4: (6, "n", "part", "won"), 5: (5, "t5", "part", None), 6: (5, "t6", "part", None), 7: (6, "t7", "full", None), 8: (5, "t8", "part", None)}
    assert once.count() == 12 and sorted(S.refresh(once, *args)[0].collect(), key=str) == sorted(once.collect(), key=str)


def test_queue_states(spark):
    rows = spark.createDataFrame([(1, "a", T(1)), (2, "a", T(2)), (3, "a", T(2)), (4, "b", T(1)), (5, "b", T(2)), (6, None, T(1))], "extraction int, k string, extracted_at timestamp_ntz")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "extraction int")
    got = {r["extraction"]: r["status"] for r in S.queue_status(rows, ids(1, 1), ids(1, 5), "k").collect()}
    assert got == {1: "approved", 2: "pending", 3: "superseded", 4: "superseded", 5: "rejected", 6: "superseded"}
