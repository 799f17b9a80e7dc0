"""Exact top-k search by inner product, in three phases with one uniform threshold.

The components are split into ``lists`` groups, and a vector's score is the sum of its partial
scores, one in each list. For a block of queries:

1. every task gathers, from each list of its rows, the k best partial scores of each query, and
   completes them. The k-th best complete score gathered anywhere is a cutoff that the k-th best
   score of all rows cannot be below.
2. the cutoffs are broadcast. A score that reaches one has a partial score of at least
   cutoff / lists in some list, so only those entries are collected.
3. their remaining partial scores are resolved exactly, and the k best of each task are merged.

Queries are taken in blocks of at most ``QUERIES``: a block's vectors and cutoffs are what is
broadcast, so the broadcast is bounded. No pair of query and row leaves a task unless it is among
the task's k best.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part,
nor do null ids; vectors of different lengths do not meet; rows that repeat an id are candidates of
their own, but never of a query with that id; a repeated query row counts once; fewer than k
candidates are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table

QUERIES = 16_384
#: Rows that are multiplied with a block of queries at once: bounds a task's memory.
CELLS = 4_000_000
_FOUND = "query int, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component; unusable vectors left out."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T: in floating point where no sum can leave its exact range."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class _Block:
    """Queries of one block, by vector length."""

    def __init__(self, rows: list[tuple[int, list[int]]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(v) for _, v in rows}:
            at = np.array([k for k, (_, v) in enumerate(rows) if len(v) == n])
            self.by_length[n] = at, np.array([rows[k][1] for k in at], np.int64)


def _blocks(batch: pa.RecordBatch, queries: _Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, query numbers, query vectors) of rows and queries of one length."""
    ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
    lengths = np.diff(lists.offsets.to_numpy())
    for n, (numbers, wanted) in queries.by_length.items():
        at = np.flatnonzero(lengths == n)
        if not len(at):
            continue
        rows = lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, n)
        step = max(64, CELLS // len(numbers))
        for low in range(0, len(at), step):
            yield ids[at[low : low + step]], rows[low : low + step], numbers, wanted


def _best(found: list[np.ndarray], k: int) -> np.ndarray:
    """The k best rows (query, -score, vec_id) of each query."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]]) if len(rows) else np.zeros(0, int)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    return rows[place < k]


def _emit(rows: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(rows[:, 0], pa.int32()), pa.array(rows[:, 2], pa.int64()), pa.array(-rows[:, 1], pa.int64())], names=["query", "vec_id", "score"])


def _parts(length: int, lists: int) -> list[slice]:
    edges = [length * j // lists for j in range(lists + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score over ``vectors`` and ``queries`` of (vec_id, v: array<long>)."""
    spark = vectors.sparkSession
    asked = queries.distinct()
    blocks = max(1, math.ceil(asked.count() * 1.2 / QUERIES))
    results = [_top_k_block(vectors, asked.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b), k, lists) for b in range(blocks)]
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _top_k_block(vectors: DataFrame, asked: DataFrame, k: int, lists: int) -> DataFrame:
    spark = vectors.sparkSession
    queries = _Block([(r["vec_id"], r["v"]) for r in asked.orderBy("vec_id", "v").collect()])
    sent = spark.sparkContext.broadcast(queries)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = sent.value, np.zeros((0, 3), np.int64)
        for batch in batches:
            for ids, rows, numbers, wanted in _blocks(batch, block):
                own = ids[:, None] == block.ids[numbers][None, :]
                for part in _parts(rows.shape[1], lists):
                    partial = _product(rows[:, part], wanted[:, part])
                    partial[own] = np.iinfo(np.int64).min // 2
                    top = np.argpartition(-partial, min(k, len(ids)) - 1, axis=0)[:k]
                    q = np.broadcast_to(np.arange(len(numbers)), top.shape)
                    row, q = top.ravel(), q.ravel()
                    row, q = row[~own[row, q]], q[~own[row, q]]
                    score = np.einsum("ij,ij->i", rows[row], wanted[q])
                    found = np.unique(np.stack([numbers[q], -score, ids[row]], axis=1), axis=0)
                    best = np.concatenate([best, found])
                best = _best([np.unique(best, axis=0)], k)
        yield _emit(best)

    gathered = vectors.mapInArrow(gather, _FOUND)
    kth = F.element_at(F.sort_array(F.collect_list("score"), asc=False), k)
    cutoffs = gathered.distinct().groupBy("query").agg(F.when(F.count("*") >= k, kth).alias("cutoff")).collect()
    cutoff = np.full(len(queries.ids), np.iinfo(np.int64).min // 4)  # fewer than k candidates: all are wanted
    for number, value in cutoffs:
        if value is not None:
            cutoff[number] = value
    sent_cutoff = spark.sparkContext.broadcast(cutoff)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = sent.value, sent_cutoff.value
        best = np.zeros((0, 3), np.int64)
        for batch in batches:
            for ids, rows, numbers, wanted in _blocks(batch, block):
                parts = _parts(rows.shape[1], lists)
                needed = -(-least[numbers] // len(parts))  # the uniform threshold, rounded up
                enough = np.zeros((len(ids), len(numbers)), bool)
                for part in parts:
                    enough |= _product(rows[:, part], wanted[:, part]) >= needed
                enough &= ids[:, None] != block.ids[numbers][None, :]
                row, q = np.nonzero(enough)
                for low in range(0, len(row), 1_000_000):
                    r, p = row[low : low + 1_000_000], q[low : low + 1_000_000]
                    score = np.einsum("ij,ij->i", rows[r], wanted[p])
                    good = score >= least[numbers[p]]
                    best = _best([best, np.stack([numbers[p[good]], -score[good], ids[r[good]]], axis=1)], k)
        yield _emit(best)

    names = spark.createDataFrame([(i, int(v)) for i, v in enumerate(queries.ids)], "query int, query_id long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    merged = vectors.mapInArrow(resolve, _FOUND).withColumn("rank", rank).filter(F.col("rank") <= k)
    return merged.join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)
