"""Operators on small tables with the awkward cases."""

import datetime
import random
import zipfile
from datetime import date

from pyspark.sql import functions as F

from plumbline.operators import intervals as I
from plumbline.operators import matching as M
from plumbline.operators import relational as R
from plumbline.operators import search as S
from plumbline.operators import texts as X
from plumbline.sources import files
from plumbline.streaming import events as E


def test_as_of_statuses(spark):
    v = spark.createDataFrame([("a", date(2001, 1, 1), date(2002, 1, 1), False), ("a", date(2003, 1, 1), None, True)], "k string, valid_from date, valid_to date, repealed boolean")
    g = spark.createDataFrame([("a", date(2002, 1, 1), date(2003, 1, 1)), ("b", None, date(2000, 1, 1))], "k string, gap_from date, gap_to date")
    days = [("a", 2000), ("a", 2001), ("a", 2002), ("a", 2003), ("b", 1999), ("b", 2000), ("c", 2000)]
    q = spark.createDataFrame([(k, date(y, 1, 1)) for k, y in days], "k string, day date")
    got = {(r["k"], r["day"].year): r["status"] for r in I.as_of(q, v, g, "k", "day").collect()}
    assert [got[d] for d in days] == ["not_in_force", "found", "gap", "not_in_force", "gap", "not_in_force", "unknown"]


def test_overlaps(spark):
    p = spark.createDataFrame([("a", date(2001, 1, 1), date(2002, 1, 1)), ("a", date(2002, 1, 1), None), ("b", None, date(2002, 1, 1)), ("b", date(2001, 1, 1), None)], "k string, valid_from date, valid_to date")
    assert [r["k"] for r in I.overlapping_neighbours(p, "k").collect()] == ["b"]


def test_publish_is_idempotent(spark):
    at = F.lit("2020-01-01").cast("timestamp_ntz")
    live = spark.createDataFrame([(1, "x", datetime.datetime(2019, 1, 1)), (2, "y", datetime.datetime(2019, 1, 1)), (3, "z", datetime.datetime(2019, 1, 1))], "k int, v string, recorded_at timestamp_ntz").withColumn("superseded_at", F.lit(None).cast("timestamp_ntz"))
    wanted = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "new")], "k int, v string")
    once = I.publish(live, wanted, "k", "v", at)
    assert sorted((r["k"], r["v"]) for r in once.filter("superseded_at is null").collect()) == [(1, "x"), (2, "Y"), (4, "new")]
    assert sorted(once.collect()) == sorted(I.publish(once, wanted, "k", "v", at).collect())


def test_timeline_holds_small_drifts_against_the_version(spark):
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join(words[:20]), " ".join(["x0", *words[1:]]), " ".join(["x0", "x1", *words[2:]]), None, "new"]
    rows = [(1, date(2000 + i, 1, 1), t) for i, t in enumerate(texts)]
    got = sorted(I.timeline(spark.createDataFrame(rows, "k int, snapshot date, text string"), "k", 0.06).collect(), key=lambda r: (r["valid_from"], r["kind"]))
    assert [(r["kind"], r["valid_from"].year, r["reason"]) for r in got] == [("version", 2000, "original"), ("gap", 2001, "changed"), ("gap", 2002, "removed"), ("version", 2002, "amended"), ("version", 2004, "added")]


def test_timeline_of_many_keys(spark):
    day = lambda i: date(2000 + i, 1, 1)
    rows = [(None, day(0), "a"), (None, day(1), "b"), (2, day(0), None), (2, day(1), "a"), (2, day(2), "a"), (3, None, "lost"), (3, day(0), "")]
    got = {tuple(r) for r in I.timeline(spark.createDataFrame(rows, "k int, snapshot date, text string"), "k").collect()}
    want = {(None, "version", day(0), day(0), "a", "original"), (None, "gap", day(0), day(1), None, "changed"), (None, "version", day(1), None, "b", "amended")}
    assert got == want | {(2, "version", day(1), None, "a", "added"), (3, "version", day(0), None, "", "original")}


def test_chains(spark):
    v = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, None)], "n int, p int")
    assert sorted(tuple(r) for r in I.chains(v, "n", "p").collect()) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (9, 9, 0)]
    long = [(0, None), *[(i, i - 1) for i in range(1, 300)], (500, 501), (501, 500), (502, 501), (600, 601)]
    got = I.chains(spark.createDataFrame(long, "n int, p int"), "n", "p").collect()
    assert sorted(tuple(r) for r in got) == [(i, 0, i) for i in range(300)]
    assert I.chains(v.limit(0), "n", "p").count() == 0


def test_candidates_hold_all_links(spark):
    df = spark.createDataFrame([(1, "x", "h"), (2, "x", "h"), (3, "y", "h"), (4, None, "g"), (5, "", "g"), (6, "z", None)], "id int, stem string, host string")
    keys = {"stem": F.col("stem"), "host": F.col("host")}
    got = sorted(tuple(r) for r in M.candidates_by(df, "id", keys).collect())
    assert got == [(1, "host", 1, 2), (1, "stem", 1, 1), (2, "host", 1, 2), (2, "stem", 1, 1), (3, "host", 1, 2), (4, "host", 4, 1), (5, "host", 4, 1)]
    pairs = sorted(tuple(r) for r in M.candidates_of(df.filter("id in (2, 5, 6)"), df, "id", keys).collect())
    assert pairs == [(2, 1, "stem"), (2, 3, "host"), (5, 4, "host")]


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (4, "a"), (5, "b")], "id int, text string")
    assert sorted(tuple(r) for r in X.exact_duplicates(df, "id", "text").collect()) == [(1, 1, 2), (2, 2, 2), (3, 2, 2), (4, 1, 2)]


def test_latest_ties_and_islands(spark):
    e = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "a", 2), (1, 2, "b", 3), (1, 3, "a", 4)], "k int, t int, s string, id int")
    assert [r["id"] for r in R.latest_per_key(e.filter("t = 1"), ["k"], [F.desc("t"), F.asc("id")]).collect()] == [1]
    assert sorted((r["run"], r["s"], r["rows"]) for r in R.islands(e, "k", ["t", "id"], "s").collect()) == [(1, "a", 2), (2, "b", 1), (3, "a", 1)]


def test_overlay_and_confidence(spark):
    base, edits = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("9"), F.lit("a"), F.lit(None).cast("string"))
    assert spark.range(1).select(R.overlay(base, edits).alias("m")).first()["m"] == {"a": "1", "b": "9"}
    for reasons, want in ((["duplicate_excerpt", "missing_court"], (15, "low", ["missing_court", "duplicate_excerpt"])), (["date_from_closing:x"], (75, "medium", ["date_from_closing"])), ([], (100, "high", [])), (["body_not_found", "layout_unknown"], (0, "low", ["layout_unknown", "body_not_found"]))):
        score, band, fired = M.confidence(F.array(*map(F.lit, reasons)).cast("array<string>"))
        assert tuple(spark.range(1).select(score, band, fired).first()) == want


def test_chunks():
    text = " ".join(f"w{i}" for i in range(500))
    assert X.chunk_spans(text) == [(None, 0, len(text))]
    assert len(X.chunk_spans(text + " one more")) == 3
    assert X.chunk_spans(" \n") == []
    short = "I. DAVA\n" + "a " * 45 + "\nII. KARAR\n" + "b " * 10 + "\nIII. SON\n" + "c " * 500
    names = [s[0] for s in X.chunk_spans(short)]
    assert names[0] == "I. DAVA" and "II. KARAR" in names
    assert X.Layout("a b. c d. e f.").windows(0, 6, most=4, overlap=2) == [(0, 9), (5, 14)]


def test_rrf_and_recall(spark):
    a, b = (spark.createDataFrame(x, "id int, rank int") for x in ([(1, 1), (2, 2)], [(2, 1)]))
    got = {r["id"]: r["score"] for r in S.rrf([a, b], "id").collect()}
    assert got == {1: 1 / 61, 2: 1 / 62 + 1 / 61}
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("p", 1, 1)], "question string, item int, rank int")
    expected = spark.createDataFrame([("q", 2), ("q", 3)], "question string, item int")
    assert {r["question"]: r["recall"] for r in S.recall_at(ranked, expected, "question", "item", 2).collect()} == {"q": 0.5, "p": 1.0}


def test_duplicate_groups(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "s", long), (2, "s", long), (3, "e", long), (4, "e", " ".join(long.split()[:30])), (5, "d", long), (6, "d", "other words " * 30), (7, "only", long)]
    df = spark.createDataFrame(rows, "id long, key string, text string").withColumn("day", F.lit("2020-01-01").cast("date"))
    got = {r["id"]: (r["kind"], r["duplicate_of"]) for r in X.duplicate_groups(df, "key", "id", "text", "day").collect()}
    assert got == {1: ("same_text", None), 2: ("same_text", 1), 3: ("excerpt", None), 4: ("excerpt", None), 5: ("different_text", None), 6: ("different_text", None)}


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html><body>x</body></html>")
    (tmp_path / "c.txt").write_bytes("çok".encode("windows-1254"))
    found = {r["path"].rsplit("/", 1)[1]: (r["type"], r["odd"]) for r in files.scan(spark, str(tmp_path)).withColumn("type", files.content_type(F.col("content"))).withColumn("odd", files.extension_mismatch(F.col("path"), F.col("type"))).collect()}
    assert found["a.pdf"] == ("pdf", False) and found["b.pdf"] == ("html", True)
    (tmp_path / "cut.txt").write_bytes(b"x" * 1023 + "ğ".encode() + b" more")
    with zipfile.ZipFile(tmp_path / "word.docx", "w") as z:
        z.writestr("word/document.xml", "<x/>")
    with zipfile.ZipFile(tmp_path / "other.zip", "w") as z:
        z.writestr("notes.txt", "word/ content.xml")
    types = {r["path"].rsplit("/", 1)[1]: r["type"] for r in files.scan(spark, str(tmp_path)).withColumn("type", files.content_type(F.col("content"))).collect()}
    assert (types["cut.txt"], types["word.docx"], types["other.zip"]) == ("text", "docx", "unknown")
    texts = files.scan(spark, str(tmp_path)).filter("path like '%c.txt'").select(files.decoded_text(F.col("content")).alias("t"))
    assert texts.first()["t"] == "çok"


def test_strict_json(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "x.jsonl").write_text('{"id": 1, "v": "a"}\n{"id": 2}\nnot json\n')
    rows, rejects = files.read_strict(spark, str(tmp_path / "x.jsonl"), T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())]), ["id", "v"])
    assert [r["id"] for r in rows.collect()] == [1]
    assert rejects.count() == 2


def test_queue_rules(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    jobs = spark.createDataFrame([(1, "running", "2024-01-01 00:00:00", 1), (2, "running", "2024-01-01 00:00:00", 3), (3, "running", "2024-01-01 00:59:00", 1), (4, "done", "2023-01-01 00:00:00", 9)], "id int, status string, s string, attempts int").withColumn("started_at", F.col("s").cast("timestamp"))
    assert {r["id"]: r["next"] for r in E.requeued(jobs, now).collect()} == {1: "queued", 2: "failed", 3: "running", 4: "done"}


def test_links(spark):
    pages = spark.createDataFrame([(1, "http://h/x/", '<a href="y.pdf">a</a><a href="http://o/z">b</a>'), (2, None, None)], "page_id long, url string, html string")
    assert [r["link"] for r in files.page_links(pages).collect()] == ["http://h/x/y.pdf"]


def test_windows_hold_every_word_and_overlap_little():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(f"w{rng.randint(0, 9)}{rng.choice(['', '', '.', ';'])}{rng.choice([' ', ' ', ' ', chr(10), chr(10) * 2])}" for _ in range(rng.randint(1, 120)))
        words, most, overlap = X.Layout(text), rng.randint(3, 20), rng.randint(0, 2)
        spans = words.windows(0, len(words), most, overlap)
        ranges = [(words.word_at(a), words.word_at(b)) for a, b in spans]
        assert ranges[0][0] == 0 and ranges[-1][1] == len(words)
        assert all(0 <= b - c <= overlap and b < d for (_, b), (c, d) in zip(ranges, ranges[1:]))
        assert all(b - a <= most + overlap for a, b in ranges)
        starts = words.cuts(0, len(words), most)
        assert all(a in starts and b in starts for a, b in ranges)


def test_duplicate_groups_of_empty_and_short_texts(spark):
    rows = [(1, "e", ""), (2, "e", ""), (3, "s", "two words"), (4, "s", "two words"), (5, "m", ""), (6, "m", "two words"), (7, "n", None), (8, "n", None), (9, "n", ""), (10, None, ""), (11, None, "")]
    df = spark.createDataFrame(rows, "id long, key string, text string").withColumn("day", F.lit("2020-01-01").cast("date"))
    got = {r["id"]: (r["kind"], r["duplicate_of"]) for r in X.duplicate_groups(df, "key", "id", "text", "day").collect()}
    other = ("different_text", None)
    assert got == {1: ("same_text", None), 2: ("same_text", 1), 3: ("same_text", None), 4: ("same_text", 3), 5: other, 6: other, 7: other, 8: other, 9: other}
