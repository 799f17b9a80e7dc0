"""Lexical and vector ranking, rank fusion, weights, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions import text as T


def lexical_ranking(index: DataFrame, row: str, terms: list[str], n: int) -> DataFrame:
    """The n rows with most occurrences of the OR-ed terms. ``index``: term, row, tf; the filter on ``term`` reaches it."""
    hits = index.filter(F.col("term").isin(terms)).groupBy(row).agg(F.sum("tf").alias("score"))
    return ranked(hits.orderBy(F.desc("score"), row).limit(n), "score", row)


def bm25_ranking(index: DataFrame, lengths: DataFrame, row: str, terms: list[str], n: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The n best rows by BM25; ``lengths``: row, words."""
    total = lengths.agg(F.count("*").alias("_docs"), F.avg("words").alias("_mean"))
    hits = index.filter(F.col("term").isin(terms))
    df_ = hits.groupBy("term").agg(F.count("*").alias("_df"))
    idf = F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("words") / F.col("_mean")))
    scored = hits.join(F.broadcast(df_), "term").join(lengths, row).crossJoin(F.broadcast(total)).groupBy(row).agg(F.round(F.sum(part), 9).alias("score"))
    return ranked(scored.orderBy(F.desc("score"), row).limit(n), "score", row)


def ranked(df: DataFrame, score: str, row: str) -> DataFrame:
    """``rank`` from 1 by score, ties by row; for frames already cut to a few rows."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), row)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_ranking(df: DataFrame, row: str, vector: str, query: Column, n: int) -> DataFrame:
    """The n rows nearest by cosine: exact, one pass, a bounded heap per task."""
    scored = df.select(row, F.round(cosine(F.col(vector), query), 9).alias("score"))
    return ranked(scored.orderBy(F.desc("score"), row).limit(n), "score", row)


def rrf(rankings: list[DataFrame], row: str, k: int = C.RRF_K) -> DataFrame:
    """row, score: the sum over rankings of 1 / (k + rank)."""
    from functools import reduce

    both = reduce(lambda a, b: a.unionByName(b), [r.select(row, "rank") for r in rankings])
    return both.groupBy(row).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def candidate_budget(limit: int) -> int:
    return min(max(limit * C.CANDIDATES_PER_RESULT, C.LEAST_CANDIDATES), C.MOST_CANDIDATES)


def weighted(df: DataFrame, score: str, weight: Column) -> DataFrame:
    return df.withColumn(score, F.col(score) * F.coalesce(weight, F.lit(1.0)))


def by_record(chunks: DataFrame, record: str, score: str, chunk: str) -> DataFrame:
    """Records by their best chunk's score, each with its chunks in order of score."""
    inner = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(chunk).alias("chunk"))))
    return chunks.groupBy(record).agg(F.max(score).alias("best"), F.transform(inner, lambda x: x["chunk"]).alias("chunks"))


def public_text(hits: DataFrame, internal: Column, text: str, fallback: Column) -> DataFrame:
    """Hits whose text may not be shown get the record's first public text instead."""
    return hits.withColumn(text, F.when(internal, fallback).otherwise(F.col(text)))


def recall_at(ranked_: DataFrame, expected: DataFrame, question: str, item: str, k: int) -> DataFrame:
    """question, recall: the share of its expected items within the first k (1 when none is expected)."""
    found = ranked_.filter(F.col("rank") <= k).select(question, item, F.lit(1).alias("_hit")).distinct()
    per = expected.join(found, [question, item], "left").groupBy(question).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
    return ranked_.select(question).distinct().join(per, question, "left").withColumn("recall", F.coalesce("recall", F.lit(1.0)))


def index_sync(wanted: DataFrame, stored: DataFrame, vectors: DataFrame, key: list[str], digest: str) -> DataFrame:
    """What the chunk index must do: keep, insert, rewrite or delete each chunk, and whether the
    vector of an equal text can be reused.

    wanted, stored: key columns and the text's digest; vectors: digest (of one model).
    """
    w = wanted.select(*key, F.col(digest).alias("_w"))
    s = stored.select(*key, F.col(digest).alias("_s"))
    action = F.when(F.col("_s").isNull(), "insert").when(F.col("_w").isNull(), "delete").when(F.col("_w") == F.col("_s"), "keep").otherwise("rewrite")
    known = vectors.select(F.col(digest).alias("_w"), F.lit(True).alias("_v")).distinct()
    out = w.join(s, key, "full_outer").withColumn("action", action).join(known, "_w", "left")
    return out.withColumn("reuse", F.col("action").isin("insert", "rewrite") & F.coalesce("_v", F.lit(False))).drop("_w", "_s", "_v")


def embedding_batches(df: DataFrame, row: str, tokens: str, most: int = 64, most_tokens: int = 60_000, ids: int = 4_096) -> DataFrame:
    """id, batch, tokens: texts in batches of at most ``most`` texts and ``most_tokens`` tokens, filled in the
    order of their ids within each range of ``ids`` ids, so the same rows always make the same batches.
    A text that alone exceeds the tokens is a batch of its own; null ids are a range; ``row`` is a number.
    """
    import pandas as pd

    def run(parts):
        held, batch, n, size = None, 0, 0, 0
        for pdf in parts:
            out = []
            for own, t in zip(pdf["range"], pdf["t"]):
                own = "-" if pd.isna(own) else str(int(own))
                if own != held:
                    held, batch, n, size = own, 0, 0, 0
                if n and (n == most or size + t > most_tokens):
                    batch, n, size = batch + 1, 0, 0
                n, size = n + 1, size + int(t)
                out.append(f"{own}.{batch}")
            yield pd.DataFrame({"id": pdf["id"], "batch": out, "tokens": pdf["t"]})

    rows = df.select(F.col(row).cast("long").alias("id"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("t"), F.floor(F.col(row) / ids).alias("range"))
    return rows.repartition("range").sortWithinPartitions("range", "id", "t").mapInPandas(run, "id long, batch string, tokens long")


def overlap_ranking(df: DataFrame, row: str, text: str, terms: list[str], covered: Column, bonus: int = 100) -> DataFrame:
    """Rows by shared words, rows whose reference is covered first; ties by row."""
    shared = F.size(F.array_intersect(F.array_distinct(T.letter_tokens(F.col(text))), F.array(*map(F.lit, terms))))
    return df.select(row, (shared + F.when(covered, bonus).otherwise(0)).alias("score")).filter("score > 0")
