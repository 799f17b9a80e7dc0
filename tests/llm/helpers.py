"""Small tables with the awkward rows every corpus operator must take."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    """A documents table with extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, DOCS)
    for name in ("spans", "bucket", "block", "row", "doc", "label", "key", "spot", "at", "n", "shard", "expected_grade"):
        df = df.withColumn(name, F.lit("extra"))
    return df.withColumn("source", F.lit(None).cast("string"))


def odd_rows():
    base = " ".join(f"word{i % 97}x{i}" for i in range(400))
    return [
        (1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "é ü ß 中文 😀   nbsp"), (8, "a" * 5_000), (9, "ab " * 20_000),
        (None, base), (None, "no id"), (10, base + " tail"), (10, base + " tail"), (11, "\x00 \x1c odd   signs"), (-5, "negative id"), (1 << 60, "far id"),
    ]


def real_documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None}


def new_folder(tmp_path, name="x"):
    return "file://" + os.path.join(str(tmp_path), name)
