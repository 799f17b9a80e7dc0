"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed text.

Grades are ordered, 0 .. K-1. One weight vector over hashed features is shared by all of them and
K-1 ordered thresholds cut its score: P(grade <= j) = sigmoid(threshold_j - score). The expected
grade and the tail probability P(grade >= k) follow. Features are the document's distinct words and
a few measures of its shape (repetition, capitals, symbols, word length) cut into steps.

Fitting uses at most ``FIT_ROWS`` rated documents, those with the smallest hashes of their ids; the
bound is what lets the ratings be broadcast. Their features are stored; tasks count in how many of
them each bucket stands beside each grade (K x 2**BITS sums), and only the buckets that tell grades
apart come to the driver, a few per document. The scores are one map over all texts.

Defined results: null text = empty text (shape features only); documents without a rating are
scored like any other; several ratings of one document count as the lowest; a null rating does not
count; ratings of equal hash are taken in order of ``doc_id``; without any ratings every document has
the top grade and is kept; repeated or null ``doc_id`` rows stay separate (a rated id that repeats
counts once for each of its rows, within ``FIT_ROWS``); an empty table gives no rows; a text of any
length is one row of features, at most 2**BITS of them; other columns pass through ``scored``, whose
scores replace columns of the same names; ``kept_by`` gives back a table's own columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import ids_and_texts, memo, sliced, stored, table, tidied

FIT_ROWS = 20_000
#: A document is kept when the top grade is at least this likely.
KEEP = 0.4
BITS = 18
#: Grades of the ratings table: 0 poor, 1 well written but toxic, 2 good.
GRADES = 3
#: Letters to lower case; ASCII signs and digits to spaces; bytes of other letters stay.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _bucket(name: bytes) -> int:
    return xxhash.xxh3_64_intdigest(name) >> (64 - BITS)


def _word_buckets(words: set[bytes]) -> set[int]:
    known = memo("quality")
    if len(known) > 250_000:
        known.clear()
    for w in words.difference(known):
        known[w] = _bucket(b"w:" + w)
    return set(map(known.__getitem__, words))


def shape(text: str, data: bytes, words: list[bytes]) -> list[bytes]:
    """Names of the steps that the document's measures fall in."""
    raw = data.split()
    n = max(1, len(raw))
    plain = data.translate(None, b" \n\t\r\x0b\x0c")
    letters = sum(map(len, words))
    upper = len(plain) - len(plain.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    measures = {
        b"distinct": len(set(words)) / max(1, len(words)) * (1 + np.log1p(len(words)) / 8),
        b"signs": (len(plain) - letters) / max(1, len(plain)) * 4,
        b"upper": upper / max(1, len(plain)) * 4,
        b"single": sum(1 for w in raw if len(w) == 1) / n * 2,
        b"length": min(letters / max(1, len(words)) / 12, 1),
        b"size": min(np.log1p(len(raw)) / 12, 1),
    }
    return [b"s:%s:%d" % (k, min(int(v * 10), 15)) for k, v in measures.items()]


def features(text: str) -> np.ndarray:
    """Sorted distinct buckets of the whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.translate(_LETTERS).split()
    found = _word_buckets(set(words))
    found.update(_bucket(s) for s in shape(text, data, words))
    return np.array(sorted(found), np.int32)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_most(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= j) for j < K-1, a row per document."""
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))

    def score(self, buckets: list[np.ndarray]) -> np.ndarray:
        return np.array([float(self.weights[b].sum()) for b in buckets])


def telling(counts: np.ndarray, grades: np.ndarray, least: int = 10, evidence: float = 6.0) -> np.ndarray:
    """The buckets that may have a weight, from documents by grade and bucket and documents by grade.

    ``least`` documents have it and their share of some grade lies ``evidence`` standard errors from
    that grade's share in the sample: rare words would only add noise to long documents.
    """
    n, seen = max(1, grades.sum()), counts.sum(axis=0)
    found = np.zeros(counts.shape[1], bool)
    for rate, own in zip(grades / n, counts, strict=True):
        found |= np.abs(own - seen * rate) >= evidence * np.sqrt(np.maximum(seen * rate * (1 - rate), 1e-9))
    return found & (seen >= least)


def fit(buckets: list[np.ndarray], grades: np.ndarray, k: int = GRADES, steps: int = 250, rate: float = 0.1, ridge: float = 1e-4) -> OrdinalModel:
    """Penalised maximum likelihood by Adam; only the buckets that the rows hold can get a weight."""
    size, n = 1 << BITS, len(grades)
    if not n:
        return OrdinalModel(np.zeros(size), np.full(k - 1, -20.0))
    row = np.repeat(np.arange(n), [len(b) for b in buckets])
    names, flat = np.unique(np.concatenate(buckets), return_inverse=True)
    share = np.bincount(grades, minlength=k) / n
    balance = (1 / np.maximum(share, 1e-9) ** 0.5)[grades]
    balance /= balance.mean()
    x = np.zeros(len(names) + k - 1)
    x[len(names)] = -2.0
    mean, var = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        grad = slope_at(x, flat, row, grades, balance, len(names), k, ridge)[1]
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        x -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size)
    weights[names] = x[: len(names)]
    return OrdinalModel(weights, cuts_of(x[len(names) :]))


def cuts_of(raw: np.ndarray) -> np.ndarray:
    """The first threshold, then positive gaps: always ordered."""
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def slope_at(x: np.ndarray, flat: np.ndarray, row: np.ndarray, grades: np.ndarray, balance: np.ndarray, names: int, k: int, ridge: float) -> tuple[float, np.ndarray]:
    """(penalised mean negative log-likelihood, its gradient) at weights and raw thresholds ``x``."""
    n, w, raw = len(grades), x[:names], x[names:]
    score = np.bincount(row, w[flat], n)
    below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(score[:, None] - cuts_of(raw), -40, 40))), np.ones((n, 1))], axis=1)
    slope = below * (1 - below)  # d P(grade <= j) / d threshold_j
    at = np.arange(n)
    p = np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)
    up, low = slope[at, grades + 1] / p * balance / n, slope[at, grades] / p * balance / n
    d_score = up - low  # of the negative log-likelihood
    d_cut = np.array([low[grades == j + 1].sum() - up[grades == j].sum() for j in range(k - 1)])
    tail = np.cumsum(d_cut[::-1])[::-1]
    grad = np.concatenate([np.bincount(flat, d_score[row], names) + ridge * w, [tail[0]], tail[1:] * np.exp(raw[1:])])
    return float(-(np.log(p) * balance).sum() / n + ridge * (w @ w) / 2), grad


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: poor quality 0, toxic 1, else 2; the lowest of a document's ratings."""
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") >= 1, 1).otherwise(2)
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    return known.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit_on(docs: DataFrame, ratings: DataFrame, rows: int = FIT_ROWS, k: int = GRADES) -> OrdinalModel:
    """Fit on at most ``rows`` of ``ratings`` (doc_id, grade)."""
    few = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("grade"), pa.array(found, pa.binary())], names=["grade", "buckets"])

    sample = stored(ids_and_texts(docs).join(F.broadcast(few), "doc_id").mapInArrow(tidied(run), "grade int, buckets binary").limit(rows), "rated")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, (1 << BITS) + 1), np.int32)  # the last place: documents of the grade
        for batch in batches:
            for grade, found in zip(batch.column("grade").to_pylist(), batch.column("buckets").to_pylist(), strict=True):
                sums[grade, np.frombuffer(found, np.int32)] += 1
                sums[grade, -1] += 1
        yield pa.record_batch([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    counts = np.zeros((k, (1 << BITS) + 1), np.int64)
    for row in sample.coalesce(4).mapInArrow(count, "sums binary").toLocalIterator():  # four tables of fixed size
        counts += np.frombuffer(row["sums"], np.int32).reshape(counts.shape)
    use = telling(counts[:, :-1], counts[:, -1])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(b, np.int32) for b in batch.column("buckets").to_pylist()]
            yield pa.record_batch([batch.column("grade"), pa.array([b[use[b]].tobytes() for b in found], pa.binary())], names=["grade", "buckets"])

    # Rows in an order of their own make the fit the same whatever the partitioning.
    got = sample.mapInArrow(keep, "grade int, buckets binary").orderBy("grade", "buckets").toArrow()
    return fit([np.frombuffer(b, np.int32) for b in got["buckets"].to_pylist()], got["grade"].to_numpy().astype(np.int64), k)


def scored(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` and expected_grade, p_top (probability of the top grade), other columns kept.

    The model is a fixed 2**BITS weights, sent to each worker once.
    """
    docs = docs.drop("expected_grade", "p_top")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            below = m.at_most(m.score([features(t) for t in texts]))
            extra = [pa.array((1 - below).sum(axis=1), pa.float64()), pa.array(1 - below[:, -1], pa.float64())]
            yield pa.record_batch(batch.columns + extra, names=batch.schema.names + ["expected_grade", "p_top"])

    schema = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("p_top", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def kept_by(docs: DataFrame, model: OrdinalModel, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` whose top grade is at least ``least`` likely, their own columns only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            below = sent.value.at_most(sent.value.score([features(t or "") for t in batch.column("text").to_pylist()]))
            yield batch.filter(pa.array(1 - below[:, -1] >= least))

    return docs.mapInArrow(tidied(run), docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected grade, tail probability and decision."""
    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs, graded(table(spark, sf_dir, "labels")))
    out = scored(ids_and_texts(docs), model)
    return out.select("doc_id", "expected_grade", "p_top", (F.col("p_top") >= KEEP).alias("kept"))
