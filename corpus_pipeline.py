"""A training-data pipeline over the documents table, a stage at a time.

Each stage reads what the one before kept (written as Parquet) and all but the last return the
columns of the documents table. Decisions are made by the operators of ``plumbline.llm`` and take
effect: rejected rows go, secrets are replaced in the texts.

Rows with a null ``doc_id`` are judged by their texts like others, but stages that drop by id leave
them; rows that share a ``doc_id`` stand or fall together in the stages that drop by id. Null and
empty texts pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import shared_dir, table
from plumbline.llm.op4_quality import fit_on, graded, kept_by
from plumbline.llm.op5_near_duplicates import near_duplicates
from plumbline.llm.op6_byte_bpe import encode_decode
from plumbline.llm.op9_secrets import redacted
from plumbline.llm.op10_decontaminate import contaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is likely enough (op 4)."""
    return kept_by(docs, fit_on(docs, graded(table(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (op 5)."""
    dropped = near_duplicates(docs).filter("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, exact or edited (op 10)."""
    leaked = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by ``<secret>`` (op 9)."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of the bytes decoded from them (op 6)."""
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("secret scan", secrets), ("byte-level BPE", byte_bpe)]

#: No stage but the last filters by anything SQL can express; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = shared_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(f"{path}/{i}")
        docs = spark.read.schema(kept.schema).parquet(f"{path}/{i}")
    return docs
