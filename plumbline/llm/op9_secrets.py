"""Secrets: pattern-found credentials, and strings that a battery of randomness tests finds random.

A candidate is a run of 16 or more characters of an encoding's alphabet with a letter in it, after
whatever sign ("=" too); "=" belongs to it as padding at its end only. The encoding is inferred (hex, base32, base64) and three tests ask whether its symbols look
uniform and independent: chi-squared against the alphabet, runs about the median, lag-one serial
correlation. A candidate that fails any at ``reject`` is no key. The others must also be shown not
to be ordinary writing: their p-value is the likelihood ratio of the corpus's own character pairs
to uniform symbols, pairs taken as they are or as words in another case and joined by other signs
(capitals, camelCase, snake_case), whichever is likelier. It is a bound that a long string can push further down than a short one, and the
Benjamini-Hochberg step-up over all candidates of the corpus keeps false discoveries below
``fdr``. Its threshold comes from a histogram of log p-values, whose size is fixed.

The scan is one map over the texts. It stores per document its spans and candidates, and per task
a table of character pairs; the text itself is never shuffled.

Defined results: null text = empty text = no spans; repeated or null ``doc_id`` rows stay separate;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ids_and_texts, stored, table, tidied

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"([A-Za-z0-9+/_-]{16,})(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
_NAMES = ("passw", "secret", "token", "apikey", "api_key")

#: The alphabets of the encodings, in the order in which they are tried.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
#: Characters as the model of re-cased writing sees them: lower case, joining signs as spaces.
_FOLDED = np.array([32 if chr(c) in "+/-_" else ord(chr(c).lower()) for c in range(128)])
#: log10 of how likely writing keeps its case between letters, changes it, and takes one joining sign of five.
SAME_CASE, OTHER_CASE, ONE_SIGN = math.log10(0.9), math.log10(0.1), math.log10(0.2)
#: Histogram cells of -log10 p; the last one holds everything beyond.
CELLS, CELL = 4000, 0.05


def credentials(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; offsets in code points, end exclusive."""
    found, lower = [], text.lower()
    if any(n in lower for n in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if max(map(len, text.split()), default=0) >= 24:
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def encoding_of(token: str) -> str | None:
    letters = set(token)
    if not any(c.isalpha() for c in letters):
        return None
    return next((k for k, own in _SETS.items() if letters <= own), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(token: str, encoding: str) -> tuple[float, float, float]:
    """p-values of chi-squared uniformity (upper tail), runs and serial correlation under randomness."""
    alphabet = ALPHABETS[encoding]
    x = np.array([alphabet.index(c) for c in token])
    n, k = len(x), len(alphabet)
    chi = float(np.sum((np.bincount(x, minlength=k) - n / k) ** 2) * k / n)
    # Exact mean and variance of the statistic; its cells are too small for the limit law.
    p_chi = 0.5 * math.erfc((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n) / math.sqrt(2))
    high = x >= k / 2
    runs = 1 + int(np.count_nonzero(high[1:] != high[:-1]))
    p_runs = _two_sided((runs - 1 - (n - 1) / 2) / math.sqrt((n - 1) / 4))
    d = x - x.mean()
    p_serial = _two_sided(float(d[1:] @ d[:-1]) / max(float(d @ d), 1e-9) * math.sqrt(n))
    return p_chi, p_runs, p_serial


def natural_log_odds(token: str, encoding: str, log_pairs: np.ndarray) -> float:
    """log10 of p(token | uniform symbols) / p(token | the corpus's character pairs).

    The pairs are the likelier of two equally likely models: as they are, and re-cased.
    """
    codes = np.frombuffer(token.encode("ascii"), np.uint8)
    folded = _FOLDED[codes]
    upper = np.array([c.isupper() for c in token if c.isalpha()])
    changes, signs = int(np.count_nonzero(upper[1:] != upper[:-1])), int(np.count_nonzero(folded == 32))
    cased = changes * OTHER_CASE + (len(upper) - 1 - changes) * SAME_CASE + signs * ONE_SIGN
    likely = [float(model[32, x[0]] + model[x[:-1], x[1:]].sum()) for model, x in zip(log_pairs, (codes, folded), strict=True)]
    natural = max(likely[0], likely[1] + cased + math.log10(0.5)) + math.log10(0.5)
    return -len(token) * math.log10(len(ALPHABETS[encoding])) - natural


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Runs of an encoding's characters outside the spans that the patterns found."""
    if max(map(len, text.split()), default=0) < 16:
        return []
    runs = [m for m in _RUN.finditer(text) if encoding_of(m[1])]
    return [{"token": m[1], "start": m.start(), "end": m.end()} for m in runs if not any(s <= m.start() and m.end(1) <= e for _, s, e in spans)]


def strength(token: str, log_pairs: np.ndarray, reject: float) -> float:
    """-log10 of the p-value of ordinary writing; 0 for a token that the battery rejects."""
    encoding = encoding_of(token)
    return max(0.0, natural_log_odds(token, encoding, log_pairs)) if min(randomness(token, encoding)) >= reject else 0.0


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_CAND = pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_PAIR = pa.struct([("pair", pa.int32()), ("n", pa.int64())])
_SCAN = pa.schema([("is_doc", pa.bool_()), ("doc_id", pa.int64()), ("spans", pa.list_(_SPAN)), ("candidates", pa.list_(_CAND)), ("pairs", pa.list_(_PAIR))])
SCAN = "is_doc boolean, doc_id long, spans array<struct<kind:string,start:int,end:int>>, candidates array<struct<token:string,start:int,end:int>>, pairs array<struct<pair:int,n:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """A row per document with its spans and candidates; a row per task with its character pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(128 * 128, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans = credentials(text)
                rows.append({"is_doc": True, "doc_id": doc_id, "spans": [{"kind": k, "start": s, "end": e} for k, s, e in spans], "candidates": candidates(text, spans)})
                codes = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
                codes = np.minimum(codes, 127)
                pairs += np.bincount(codes[:-1] << 7 | codes[1:], minlength=128 * 128)
            yield pa.RecordBatch.from_pylist(rows, schema=_SCAN)
        yield pa.RecordBatch.from_pylist([{"is_doc": False, "pairs": [{"pair": int(i), "n": int(pairs[i])} for i in np.flatnonzero(pairs)]}], schema=_SCAN)

    return ids_and_texts(docs).mapInArrow(tidied(run), SCAN)


def character_model(found: DataFrame) -> np.ndarray:
    """log10 p(next character | character), smoothed, as written and folded; at most 128 x 128 counts reach the driver."""
    counts = np.full((2, 128, 128), 0.5)
    summed = found.filter(~F.col("is_doc")).select(F.explode("pairs").alias("x")).groupBy("x.pair").agg(F.sum("x.n").alias("n"))
    for pair, n in summed.collect():
        counts[0, pair >> 7, pair & 127] += n
        counts[1, _FOLDED[pair >> 7], _FOLDED[pair & 127]] += n
    return np.log10(counts / counts.sum(axis=2, keepdims=True))


def judged(found: DataFrame, log_pairs: np.ndarray, reject: float) -> DataFrame:
    """spans, and candidates that pass the battery with ``strength`` = -log10 of their p-value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cands in batch.column("candidates").to_pylist():
                out.append([{"start": c["start"], "end": c["end"], "strength": strength(c["token"], log_pairs, reject)} for c in cands])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("strength", pa.float64())]))
            yield pa.record_batch([batch.column("doc_id"), batch.column("spans"), pa.array(out, kind)], names=["doc_id", "spans", "random"])

    schema = "doc_id long, spans array<struct<kind:string,start:int,end:int>>, random array<struct<start:int,end:int,strength:double>>"
    return found.filter("is_doc").select("doc_id", "spans", "candidates").mapInArrow(run, schema)


def discovery_threshold(scored: DataFrame, fdr: float) -> float:
    """The least -log10 p that the Benjamini-Hochberg step-up accepts (inf: none)."""
    cell = F.least(F.floor(F.col("x.strength") / CELL), F.lit(CELLS)).cast("int")
    cells = dict(scored.select(F.explode("random").alias("x")).groupBy(cell.alias("cell")).count().collect())
    tests, above, threshold = sum(cells.values()), 0, math.inf
    for at in sorted(cells, reverse=True):  # every p-value of a cell counts as the cell's largest
        above += cells[at]
        if 10 ** (-at * CELL) <= fdr * above / tests:
            threshold = at * CELL
    return threshold


class Judge:
    """What the corpus decided, as a function of one text: its spans (kind, start, end) by start."""

    def __init__(self, log_pairs: np.ndarray, threshold: float, reject: float):
        self.log_pairs, self.threshold, self.reject = log_pairs, threshold, reject

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        base = credentials(text)
        found = [("random", c["start"], c["end"]) for c in candidates(text, base) if strength(c["token"], self.log_pairs, self.reject) >= self.threshold]
        return sorted(base + found, key=lambda x: x[1])


def _decided(docs: DataFrame, fdr: float, reject: float) -> tuple[DataFrame, Judge]:
    found = stored(scan(docs), "secrets")
    log_pairs = character_model(found)
    scored = judged(found, log_pairs, reject)
    return scored, Judge(log_pairs, discovery_threshold(scored, fdr), reject)


def find_secrets(docs: DataFrame, fdr: float = 0.001, reject: float = 1e-4) -> DataFrame:
    """doc_id, base (the pattern-found spans), spans (all): struct kind, start, end, by start."""
    scored, judge = _decided(docs, fdr, reject)
    secrets = F.transform(F.filter("random", lambda r: r["strength"] >= F.lit(judge.threshold)), lambda r: F.struct(F.lit("random").alias("kind"), r["start"].alias("start"), r["end"].alias("end")))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, "random")) for x in (k, i)])
    ordered = F.array_sort(F.transform(F.concat("spans", secrets), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return scored.select("doc_id", F.col("spans").alias("base"), F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def redacted(docs: DataFrame, fdr: float = 0.001, reject: float = 1e-4) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``<secret>``: two maps over the texts."""
    judge = docs.sparkSession.sparkContext.broadcast(_decided(docs, fdr, reject)[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t is None else without(t, [(s, e) for _, s, e in judge.value.spans(t)]) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(tidied(run), docs.schema)


def without(text: str, spans: list[tuple[int, int]], put: str = "<secret>") -> str:
    parts, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            parts += [text[at:start], put]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def span_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind, of: F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k, "base") for k in KINDS), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), count("random", "spans"))
