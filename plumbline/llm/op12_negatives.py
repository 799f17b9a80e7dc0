"""Hard negatives by one-dimensional distance keys.

Scores are inner products. A component is added to each row that brings all rows to the same norm M, so
that the higher score is the smaller distance: d(q, x)^2 = |q|^2 + M^2 - 2 q.x. Each row belongs to its
nearest pivot and its key is (pivot, distance to the pivot); the index is the rows stored in key order.
A row at distance d of a query whose distance to the pivot is p has a key between p - d and p + d, so a
scan of the key intervals [p - r, p + r] of all pivots has met every row at distance r or less.

Queries are taken in blocks of at most ``QUERIES``, of neighbouring pivots, and are broadcast with their
distances. A search is a query with its score window, its label rule and a number k. Its scan expands:
each round multiplies the rows in the parts of the key intervals that radius r adds (row groups that no
query's interval meets are pruned by their statistics) and keeps the k best rows so far. When the k-th
best lies within r nothing unread can come before it; until then r grows to the distance of the k-th best,
or doubles while there are fewer. Searches for scores up to s begin at the distance of s, and leave out keys that only nearer rows have.

Defined results: rows with a null id, label or vector, an empty vector, or null or non-finite components
take no part; vectors of different lengths do not meet; rows that repeat an id are rows of their own, but
never partners of an anchor with that id; a repeated anchor row counts once; all are returned where there
are fewer than asked for; ties go to the smaller id; a row that very many repeat is dealt out by its id;
squared norms of 2^62 or more are refused (scores would not fit); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import shared_dir, stored, table

QUERIES, CELLS = 4_096, 2_000_000
#: Pivots are means of at most ``SAMPLE`` rows, those of the smallest id hashes.
PIVOTS, SAMPLE, ROUNDS = 64, 4_096, 4
_INDEX = "pivot int, key double, vec_id long, label int, v array<long>"
_FOUND = "search int, score long, vec_id long"
_MOST = 1 << 62


def usable(vectors: DataFrame, scale: int, label: Column) -> DataFrame:
    """vec_id, label, v: floor(scale * x) of each component; rows that take no part left out."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), whole.alias("v"))


def _product(a: np.ndarray, b: np.ndarray, square: int) -> np.ndarray:
    """Exact integer a @ b.T of vectors whose squared norms are at most ``square``: sums of products are not more either."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if square < 2**53 else a @ b.T


class Keys:
    """Pivots (augmented vectors) by vector length, and the distances of rows to them."""

    def __init__(self, square: int, sample: list[list[int]]):
        self.square, self.pivots, self.first = square, {}, {}
        for n in sorted({len(v) for v in sample}):
            self.first[n] = sum(map(len, self.pivots.values()))
            self.pivots[n] = self._means(self.augmented(np.array([v for v in sample if len(v) == n], np.int64)))

    @staticmethod
    def _means(rows: np.ndarray) -> np.ndarray:
        centres = np.unique(rows, axis=0)
        centres = centres[np.linspace(0, len(centres) - 1, min(PIVOTS, len(centres))).astype(int)]
        for _ in range(ROUNDS):
            near = _distances(rows, centres).argmin(axis=1)
            centres = np.array([rows[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        return centres

    def augmented(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(np.float64)
        return np.column_stack([rows, np.sqrt(np.maximum(0.0, float(self.square) - (rows * rows).sum(axis=1)))])

    def distances(self, rows: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """(pivot numbers, distances of ``rows`` of one length to those pivots). Queries are not augmented.

        A length that the sample has not met has one pivot of its own, the zero vector.
        """
        n = rows.shape[1]
        own = np.column_stack([rows.astype(np.float64), np.zeros(len(rows))]) if query else self.augmented(rows)
        if n not in self.pivots:
            return np.array([-n]), np.sqrt((own * own).sum(axis=1))[:, None]
        return np.arange(len(self.pivots[n])) + self.first[n], _distances(own, self.pivots[n])


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), len(centres)))
    for c, centre in enumerate(centres):
        out[:, c] = np.sqrt(((rows - centre) ** 2).sum(axis=1))
    return out


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors) of each length in a batch."""
    lists = batch.column("v")
    lengths = np.diff(lists.offsets.to_numpy())
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, n)


def key_index(rows: DataFrame) -> tuple[DataFrame, Keys]:
    """The rows stored in the order of (pivot, distance to it); a key that many share is dealt out by id."""
    norm = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)"))
    square = int(rows.agg(F.max(norm)).first()[0] or 0)
    if square >= _MOST:
        raise ValueError("components are too large: scores would not fit 64 bits")
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    keys = Keys(square, [r["v"] for r in sample])
    sent = rows.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, key = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, own in _by_length(batch):
                numbers, far = sent.value.distances(own, query=False)
                near = far.argmin(axis=1)
                pivot[at], key[at] = numbers[near], far[np.arange(len(at)), near]
            yield pa.record_batch([pa.array(pivot), pa.array(key), *(batch.column(c) for c in ("vec_id", "label", "v"))], names=["pivot", "key", "vec_id", "label", "v"])

    keyed = rows.select("vec_id", "label", "v").mapInArrow(run, _INDEX)
    return stored(keyed.repartitionByRange("pivot", "key", "vec_id").sortWithinPartitions("pivot", "key", "vec_id"), "keys"), keys


class Search(NamedTuple):
    """One search of each query of a block that takes part: the k first rows of scores ``low`` to ``high``."""

    query: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same_label: bool
    k: int


class Block:
    """Queries of one vector length, their distances to the pivots, and what is known of their searches."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, keys: Keys, search: Search):
        self.ids, self.labels, self.v, self.square, self.search = ids, labels, v, keys.square, search
        self.numbers, self.far = keys.distances(v, query=True)
        self.reach = (v.astype(np.float64) ** 2).sum(axis=1) + float(keys.square)  # |q|^2 + M^2
        self.margin = 1e-7 * (1.0 + np.sqrt(self.reach))[search.query]  # above the rounding of keys and distances
        n = len(search.query)
        self.near, self.last = self.distance(search.high), self.distance(search.low)
        self.read, self.radius = np.full(n, -1.0), np.zeros(n)
        self.least = search.low.copy()  # rows of lower scores come after those that are known
        self.open = search.low <= search.high

    def distance(self, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.reach[self.search.query] - 2.0 * score.astype(np.float64)))

    def begin(self) -> None:
        """The first radius: that of the nearest scores of the window, or of the nearest pivot, and an eighth of what is left."""
        first = np.maximum(self.near, np.minimum(self.far.min(axis=1)[self.search.query], self.last))
        self.radius = first + (self.last - first) / 8 + self.margin

    def next(self, number: np.ndarray, count: np.ndarray, worst: np.ndarray) -> None:
        """Takes the k-th best (``worst``) of the searches with ``count`` rows; closes what is certified, widens the rest."""
        self.read = self.radius.copy()
        full = np.zeros(len(self.read), bool)
        full[number[count >= self.search.k]] = True
        self.least[number[count >= self.search.k]] = worst[count >= self.search.k]
        end = np.where(full, self.distance(self.least), self.last) + self.margin
        self.open &= self.read < end
        self.radius = np.where(full, end, np.minimum(end, 2 * self.read))

    def intervals(self) -> dict[int, tuple[float, float]]:
        """By pivot, the keys from the least to the most that an open search has not read yet."""
        at = np.flatnonzero(self.open)
        far, r = self.far[self.search.query[at]], self.radius[at][:, None]
        low, high = far - r, far + r
        low = np.maximum(low, self.near[at][:, None] - far - self.margin[at][:, None])
        wanted = low <= high
        return {int(p): (float(low[wanted[:, c], c].min()), float(high[wanted[:, c], c].max())) for c, p in enumerate(self.numbers) if wanted[:, c].any()}


def _best(rows: np.ndarray, k: int) -> np.ndarray:
    """The k best rows (search, -score, vec_id) of each search."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]]) if len(rows) else np.zeros(0, int)
    return rows[np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)])) < k]


def _scan(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[pa.RecordBatch]:
    """The best rows of a task for the open searches, among keys that the last radius added."""
    search, best = block.search, np.zeros((0, 3), np.int64)
    least, new, held = block.least.copy(), [], 0
    place = {int(p): c for c, p in enumerate(block.numbers)}
    for batch in batches:
        pivots, keys, ids, labels = (batch.column(c).to_numpy() for c in ("pivot", "key", "vec_id", "label"))
        for at, rows in _by_length(batch):
            if rows.shape[1] != block.v.shape[1]:
                continue
            for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(pivots[at])) + 1):
                for low in range(0, len(run), 512):
                    part = run[low : low + 512]
                    own, key = at[part], keys[at[part]]
                    far = block.far[search.query, place[int(pivots[own[0]])]]
                    first, last = key.min(), key.max()
                    gap = np.maximum(np.maximum(first - far, far - last), 0.0)
                    use = np.flatnonzero(block.open & (gap <= block.radius) & (last >= block.near - far - block.margin))
                    step = max(1, CELLS // len(part))
                    for some in np.split(use, range(step, len(use), step)) if len(use) else []:
                        asked, back = np.unique(search.query[some], return_inverse=True)
                        score = _product(block.v[asked], rows[part], block.square)[back]
                        away = np.abs(key[None, :] - far[some][:, None])
                        good = (away <= block.radius[some][:, None]) & (away > block.read[some][:, None])
                        good &= (score >= least[some][:, None]) & (score <= search.high[some][:, None])
                        good &= (labels[own][None, :] == block.labels[search.query[some]][:, None]) == search.same_label
                        good &= ids[own][None, :] != block.ids[search.query[some]][:, None]
                        s, x = np.nonzero(good)
                        new.append(np.stack([some[s], -score[s, x], ids[own[x]]], axis=1))
                        held += len(s)
                        if held > max(20_000, len(best)):
                            best, new, held = _best(np.concatenate([best, *new]), search.k), [], 0
                            full, n = np.unique(best[:, 0], return_counts=True)
                            ends = np.cumsum(n)[n >= search.k] - 1
                            least[full[n >= search.k]] = np.maximum(least[full[n >= search.k]], -best[ends, 1])
    best = _best(np.concatenate([best, *new]), search.k)
    yield pa.record_batch([pa.array(best[:, 0], pa.int32()), pa.array(-best[:, 1]), pa.array(best[:, 2])], names=["search", "score", "vec_id"])


def expanding(index: DataFrame, block: Block) -> DataFrame:
    """search, score, vec_id, rank of the k first rows of each search of a block."""
    sc, k = index.sparkSession.sparkContext, block.search.k
    rank = F.row_number().over(Window.partitionBy("search").orderBy(F.desc("score"), "vec_id"))
    known: DataFrame | None = None
    block.begin()
    while block.open.any():
        wanted = F.lit(False)
        for pivot, (low, high) in block.intervals().items():
            wanted |= (F.col("pivot") == pivot) & F.col("key").between(low, high)
        sent = sc.broadcast(block)
        found = index.filter(wanted).mapInArrow(lambda batches, sent=sent: _scan(batches, sent.value), _FOUND)
        found = found if known is None else found.unionByName(known.drop("rank"))
        known = stored(found.withColumn("rank", rank).filter(F.col("rank") <= k), "found")
        state = known.groupBy("search").agg(F.count("*").alias("n"), F.min("score").alias("worst")).toArrow()
        block.next(*(state.column(c).to_numpy() for c in ("search", "n", "worst")))
    if known is None:
        return index.sparkSession.createDataFrame([], _FOUND + ", rank int")
    return known


def _blocks(anchors: DataFrame) -> Iterator[Column]:
    """Conditions that cut the anchors into blocks of about ``QUERIES``: whole pivots, or parts of one by hash."""
    held: list[tuple[int, int]] = []
    share = F.xxhash64("vec_id", "label", "v")
    for n, pivot, count in sorted((r["n"], r["pivot"], r["count"]) for r in anchors.groupBy(F.size("v").alias("n"), "pivot").count().collect()):
        if held and (held[0][0] != n or sum(c for *_, c in held) + count > QUERIES):
            yield (F.size("v") == held[0][0]) & F.col("pivot").isin([p for _, p, _ in held])
            held = []
        if count > QUERIES:
            parts = math.ceil(count * 1.2 / QUERIES)
            for part in range(parts):
                yield (F.size("v") == n) & (F.col("pivot") == pivot) & (F.pmod(share, F.lit(parts)) == part)
        else:
            held.append((n, pivot, count))
    if held:
        yield (F.size("v") == held[0][0]) & F.col("pivot").isin([p for _, p, _ in held])


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, v (see ``usable``). A positive is one of the first ``positives`` rows of the
    anchor's label; its negatives are the first rows of other labels that score ``least`` to ``most``
    per cent of the positive's score.
    """
    spark = rows.sparkSession
    index, keys = key_index(rows)
    chosen = stored(index.filter(anchors).select("vec_id", "label", "v", "pivot").distinct(), "anchors")
    path, schema = shared_dir(spark, "negatives"), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for condition in _blocks(chosen):
        own = chosen.filter(condition).select("vec_id", "label", "v").toArrow()
        if not own.num_rows:
            continue
        ids, labels = (own.column(c).to_numpy() for c in ("vec_id", "label"))
        v = own.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        every = np.arange(len(ids))
        near = Search(every, np.full(len(ids), -keys.square - 1), np.full(len(ids), keys.square), True, positives)
        first = expanding(index, Block(ids, labels, v, keys, near))
        told = first.select("search", "rank", "score").toArrow()
        number, rank, score = (told.column(c).to_numpy().astype(np.int64) for c in ("search", "rank", "score"))
        order = np.lexsort((rank, number))
        number, rank, score = number[order], rank[order], score[order]
        exact = score.astype(object)  # percentages of large scores need more than 64 bits on the way
        low, high = (x.astype(np.int64) for x in (-((-least * exact) // 100), (most * exact) // 100))
        second = expanding(index, Block(ids, labels, v, keys, Search(number, low, high, False, negatives)))
        facts = spark.createDataFrame(pa.table({"of": pa.array(np.arange(len(number)), pa.int32()), "search": pa.array(number, pa.int32()), "place": pa.array(rank, pa.int32()), "anchor_id": ids[number]}))
        pairs = facts.join(first.select("search", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["search", "place"])
        out = pairs.drop("search", "place").join(second.select(F.col("search").alias("of"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), "of")
        out.select(*(x.split()[0] for x in schema.split(", "))).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(usable(table(spark, sf_dir, "embeddings"), 256, flipped), F.col("vec_id") % 100 == 0)
