"""Vector search over inverted lists: rows stored by their nearest centroid, questions probe the nearest lists.

Centroids are fitted on at most ``SAMPLE`` rows, those of the smallest id hashes; every row is indexed.
Questions are taken in blocks of at most ``BLOCK`` and broadcast; a task multiplies the rows of a list with
the questions that probe it and passes on its k best of each. Probing all lists is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import attach, shared_dir

SAMPLE, ROUNDS, BLOCK, CELLS = 20_000, 8, 4_096, 2_000_000
_FOUND = "question long, row long, score double"


def usable(df: DataFrame, row: str, vector: str) -> DataFrame:
    """row (long), v (array<double>) of rows with an id and a finite vector that is not all zeros."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return df.filter(F.col(row).isNotNull() & (F.size(vector) > 0) & fine).select(F.col(row).cast("long").alias("row"), F.col(vector).cast("array<double>").alias("v"))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of unit vectors by their directions; begins with rows spread over the sample."""
    rows = _unit(sample)
    centres = rows[np.linspace(0, len(rows) - 1, min(lists, len(rows))).astype(int)]
    for _ in range(ROUNDS):
        near = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


@dataclass
class Lists:
    """A stored index: its folder and its centroids."""

    spark: SparkSession
    path: str
    centres: np.ndarray

    def read(self) -> DataFrame:
        return self.spark.read.schema("list int, row long, v array<double>").parquet(self.path)


def _matrix(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, their vectors) of the lists of length n."""
    at = np.flatnonzero(np.diff(column.offsets.to_numpy()) == n)
    return at, column.take(pa.array(at)).flatten().to_numpy().reshape(-1, n)


def write_lists(rows: DataFrame, lists: int = 64, path: str | None = None) -> Lists:
    """Index ``rows`` (see ``usable``). Vectors of another length than the first of the sample are in no list.

    Ranges go over list and row, so a list that very many rows are in is cut as well.
    """
    spark, path = attach(rows.sparkSession), path or shared_dir(rows.sparkSession, "lists")
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()]
    n = len(sample[0]) if sample else 0
    centres = fitted(np.array([v for v in sample if len(v) == n], np.float64), lists) if n else np.zeros((0, 0))
    sent = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, own = _matrix(batch.column("v"), sent.value.shape[1])
            near = (_unit(own) @ sent.value.T).argmax(axis=1) if len(at) else np.zeros(0)
            take = pa.array(at)
            yield pa.record_batch([pa.array(near, pa.int32()), batch.column("row").take(take), batch.column("v").take(take)], names=["list", "row", "v"])

    listed = rows.filter(F.size("v") == n).mapInArrow(run, "list int, row long, v array<double>")
    listed.repartitionByRange("list", "row").sortWithinPartitions("list", "row").write.parquet(path)
    return Lists(spark, path, centres)


def _top(rows: np.ndarray, k: int) -> np.ndarray:
    """The k best (question, -score, row) of each question; ties by row."""
    rows = rows[np.lexsort((rows["row"], rows["score"], rows["question"]))]
    starts = np.flatnonzero(np.r_[True, rows["question"][1:] != rows["question"][:-1]]) if len(rows) else np.zeros(0, int)
    return rows[np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)])) < k]


def nearest(index: Lists, questions: DataFrame, k: int = 10, probe: int | None = None, others: bool = False) -> DataFrame:
    """question, row, score (cosine, 9 digits), rank: the k nearest rows in the ``probe`` nearest lists (all: exact).

    ``questions``: see ``usable``, unique. ``others``: rows with the question's own id do not count.
    """
    spark, n = index.spark, index.centres.shape[1]
    path = shared_dir(spark, "nearest")
    spark.createDataFrame([], _FOUND).write.parquet(path)
    asked = questions.filter(F.size("v") == n)
    blocks = -(-asked.count() * 6 // (5 * BLOCK)) if n else 0
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        ids, v = own.column("row").to_numpy(), _unit(own.column("v").combine_chunks().flatten().to_numpy().reshape(-1, n))
        near = np.argsort(-(v @ index.centres.T), axis=1, kind="stable")[:, : probe or len(index.centres)]
        probed = np.zeros((len(ids), len(index.centres)), bool)
        np.put_along_axis(probed, near, True, axis=1)
        sent = spark.sparkContext.broadcast((ids, v, probed))
        lists = [int(x) for x in np.flatnonzero(probed.any(axis=0))]
        rows = index.read().filter(F.col("list").isin(lists)) if len(lists) < len(index.centres) else index.read()
        rows.mapInArrow(lambda batches, sent=sent: _scan(batches, sent.value, k, others), _FOUND).write.mode("append").parquet(path)
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "row"))
    return spark.read.schema(_FOUND).parquet(path).withColumn("rank", rank).filter(F.col("rank") <= k)


def _scan(batches: Iterator[pa.RecordBatch], block: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, others: bool) -> Iterator[pa.RecordBatch]:
    """A task's k best rows of each question of the block."""
    ids, v, probed = block
    kind = np.dtype([("question", np.int64), ("score", np.float64), ("row", np.int64)])
    best = np.zeros(0, kind)
    for batch in batches:
        lists, rows = batch.column("list").to_numpy(), batch.column("row").to_numpy()
        at, own = _matrix(batch.column("v"), v.shape[1])
        own = _unit(own)
        for name in np.unique(lists[at]).tolist():
            use, asks = np.flatnonzero(lists[at] == name), np.flatnonzero(probed[:, name])
            step = max(1, CELLS // max(1, len(asks)))
            for low in range(0, len(use), step):
                some = use[low : low + step]
                score = np.round(v[asks] @ own[some].T, 9)
                if others:
                    score[ids[asks][:, None] == rows[at[some]][None, :]] = -np.inf
                least = -np.partition(-score, min(k, len(some)) - 1, axis=1)[:, min(k, len(some)) - 1]
                q, x = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                new = np.zeros(len(q), kind)
                new["question"], new["score"], new["row"] = ids[asks[q]], -score[q, x], rows[at[some[x]]]
                best = _top(np.concatenate([best, _top(new, k)]), k)
    yield pa.record_batch([pa.array(best["question"]), pa.array(best["row"]), pa.array(-best["score"])], names=["question", "row", "score"])


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """question, recall: the share of the ``wanted`` rows of each question that was ``found``."""
    hits = wanted.select("question", "row").join(found.select("question", "row", F.lit(1.0).alias("_hit")), ["question", "row"], "left")
    return hits.groupBy("question").agg(F.round(F.avg(F.coalesce("_hit", F.lit(0.0))), 9).alias("recall"))
