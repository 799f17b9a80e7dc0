"""Inputs that a registered query once left out."""

import random

import duckdb

from plumbline.operators.texts import beside_next
from plumbline.plans.catalogue import ORACLE_SQL, QUERIES


def test_next_document_is_found_however_far(spark, tmp_path):
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(40)]
    ids = [-(1 << 50), -7, 1, 2, 70, 200, 10_000, 1 << 40, (1 << 62) + 5]
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in ids] + [(i, "short") for i in range(71, 150)] + [(None, "no id " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE_SQL["shingle_containment"]).fetchall())
    got = sorted(map(tuple, QUERIES["shingle_containment"](spark, f"file://{tmp_path}").collect()))
    assert got == want and [g[:2] for g in got] == list(zip(ids, ids[1:]))


def test_rows_beside_the_next_equal_plain_order(spark):
    ids = sorted(random.Random(32).sample(range(-(10**12), 10**12), 500))
    df = spark.createDataFrame([(i, f"text {i}") for i in [*ids[::-1], None]], "id long, text string")
    want = [(a, f"text {a}", b, f"text {b}") for a, b in zip(ids, ids[1:])]
    for ranges in (1, 7, 200):
        assert sorted(map(tuple, beside_next(df, "id", "text", df, ranges).collect())) == want
    assert beside_next(df.limit(0), "id", "text", df.limit(0)).count() == 0
