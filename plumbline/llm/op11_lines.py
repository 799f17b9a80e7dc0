"""Line dedup: lines that many documents repeat stay in one of them.

A line's key is the line without white space at its ends, A-Z lower-cased. A key of enough code points
that enough documents hold loses its lines everywhere but in the document with the largest id.

1. a map gives the 64-bit hashes of the long keys, each once for a task, marked where more than one of
   the task's documents holds it. They go to shards by hash, and a shard streams them through two Bloom
   filters: what the first (once seen) already holds is set in the second (twice seen) as well. The second
   ones, folded to what they hold, come back and are broadcast;
2. a second map passes only lines that the twice-seen filter holds: suspected repeats. Their keys, counted
   within a task first, are shuffled as they are and so confirmed exactly: their number of documents and
   the document that keeps them;
3. a third map drops the lines of the confirmed keys, told by 128 bits of their digests.

A Bloom filter never misses what it was given, so no repeat is lost; a line that it holds by chance is
counted exactly and stays. Twice-seen filters of over ``FILTER_BYTES`` together are not broadcast: then
every long line counts as suspected. More than ``CONFIRMED`` confirmed keys are not broadcast either:
they are joined with the lines' digests, and what a document loses is joined with its text. Neither way
changes the result.

Defined results: a null or empty text is one empty line; a document is a row, rows that share a
``doc_id`` are counted one by one, and all of them with the largest id keep their lines; a null id is
smaller than any other; a key that one document holds several times counts once and keeps or loses all
its lines there; very long lines and texts are taken as they are; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, ids_and_texts, joined, sliced, stored, table
from plumbline.llm.words import mixed

FILTER_BYTES, CONFIRMED = 32 << 20, 2 << 20
#: Keys a shard is laid out for, filter bits for each of them, shards of a partition.
SHARD_KEYS, BITS, SHARDS = 1 << 16, 16, 8
_PROBES = 6
#: What a task holds before it sends it on: hashes, bytes of keys.
_HELD, _HELD_BYTES = 1 << 20, 16 << 20
_WHITE = b" \t\n\v\f\r"


def key_of(line: bytes) -> bytes:
    return line.translate(LOWER).strip(_WHITE)


def long_keys(text: bytes, least: int) -> set[bytes]:
    """The distinct keys of a text's lines that have ``least`` code points or more."""
    if len(text) < least:
        return set()
    keys = {k for k in (line.strip(_WHITE) for line in text.translate(LOWER).split(b"\n")) if len(k) >= least}
    return {k for k in keys if k.isascii() or len(k) - sum(map(k.count, _TRAILING)) >= least}


#: Bytes of UTF-8 that begin no code point.
_TRAILING = [bytes([b]) for b in range(0x80, 0xC0)]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _places(hashes: np.ndarray, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """Each hash's bits in a filter of so many (a power of two)."""
    low = mixed(hashes)  # shards are told by the hashes themselves
    step = (low >> np.uint64(32)) | np.uint64(1)
    mask = np.asarray(bits, np.uint64) - np.uint64(1)
    for i in range(_PROBES):
        yield ((low + step * np.uint64(i)) & mask).astype(np.int64)


def folded(held: np.ndarray, entries: int) -> np.ndarray:
    """A filter's bits (bools) cut in halves and laid over each other while there are ``BITS`` for each entry."""
    while len(held) >= 2 * max(64, BITS * entries):
        held = held[: len(held) // 2] | held[len(held) // 2 :]
    return held


class Shard:
    """The two filters of one range of hashes."""

    def __init__(self, bits: int):
        self.once, self.twice, self.entries = np.zeros(bits, bool), np.zeros(bits, bool), 0

    def add(self, hashes: np.ndarray, again: np.ndarray) -> None:
        """``hashes``: distinct; ``again``: those that a task has seen in two documents itself."""
        places = list(_places(hashes, len(self.once)))
        seen = again | np.logical_and.reduce([self.once[at] for at in places])
        self.entries += int((seen & ~np.logical_and.reduce([self.twice[at] for at in places])).sum())
        for at in places:
            self.once[at] = True
        for at in _places(hashes[seen], len(self.twice)):
            self.twice[at] = True


def repeated_filters(docs: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(shard, bits: the twice-seen filter of each shard; number of shards)."""
    spark = docs.sparkSession
    most = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // least  # long lines cannot be more
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // (SHARD_KEYS * SHARDS)))
    shards = parts * SHARDS
    bits = max(64, 1 << (BITS * (most // shards + 1) - 1).bit_length())

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def emit() -> pa.RecordBatch:
            own, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array((own % np.uint64(shards)).astype(np.int64)), pa.array(own.view(np.int64)), pa.array(counts > 1)], names=["shard", "hash", "again"])

        for batch in batches:
            for text in _texts(batch):
                found = [xxhash.xxh3_64_intdigest(k) for k in long_keys(text, least)]
                held.append(np.unique(np.array(found, np.uint64)))
                n += len(found)
                if n >= _HELD:
                    yield emit()
                    held, n = [], 0
        if n:
            yield emit()

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Shard] = {}
        for batch in batches:
            shard, key, again = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "hash", "again"))
            order = np.argsort(shard, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                one, times = np.unique(key[at], return_counts=True)
                twice = np.bitwise_or.reduceat(again[at][np.argsort(key[at], kind="stable")], np.concatenate([[0], np.cumsum(times)[:-1]]))
                own.setdefault(int(shard[at[0]]), Shard(bits)).add(one.view(np.uint64), twice | (times > 1))
        rows = [(s, np.packbits(folded(x.twice, x.entries), bitorder="little").tobytes()) for s, x in own.items() if x.entries]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "bits"])

    dealt = docs.select("text").mapInArrow(hashes, "shard long, hash long, again boolean").repartition(parts, "shard")
    return stored(dealt.mapInArrow(filters, "shard long, bits binary"), "twice"), shards


class TwiceSeen:
    """The filters of all shards in one array; holds whatever hash may have been seen twice."""

    def __init__(self, filters: pa.Table, shards: int):
        bits = filters.column("bits").to_pylist()
        self.sizes, self.starts = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        at = filters.column("shard").to_numpy()
        self.sizes[at] = [len(b) * 8 for b in bits]
        self.starts[at] = np.cumsum([0, *map(len, bits)])[:-1] * 8
        self.bits, self.shards = np.frombuffer(b"".join(bits), np.uint8), shards

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        shard = (hashes % np.uint64(self.shards)).astype(np.int64)
        out = self.sizes[shard] > 0
        left = np.flatnonzero(out)
        start = self.starts[shard[left]]
        for at in _places(hashes[left], self.sizes[shard[left]]):
            at = start + at
            out[left] &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def repeated_keys(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """key (binary), n, last: keys of ``least`` code points or more in ``documents`` rows or more, and the largest id of those."""
    filters, shards = repeated_filters(docs, least)
    size = filters.agg(F.sum(F.length("bits"))).first()[0] or 0
    sent = docs.sparkSession.sparkContext.broadcast(TwiceSeen(filters.toArrow(), shards)) if size <= FILTER_BYTES else None

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int | None]] = {}
        size = 0

        def emit() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.binary()), pa.array([x[0] for x in held.values()], pa.int64()), pa.array([x[1] for x in held.values()], pa.int64())], names=["key", "n", "last"])

        for batch in sliced(batches, 500):
            found = [(doc, key) for doc, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True) for key in long_keys(text, least)]
            use = sent.value.holds(np.array([xxhash.xxh3_64_intdigest(k) for _, k in found], np.uint64)) if sent else np.ones(len(found), bool)
            for doc, key in compress(found, use.tolist()):
                n, last = held.get(key, (0, None))
                size += 0 if n else len(key) + 100
                held[key] = n + 1, doc if last is None else last if doc is None else max(last, doc)
            if size >= _HELD_BYTES:
                yield emit()
                held.clear()
                size = 0
        if held:
            yield emit()

    counted = docs.mapInArrow(suspects, "key binary, n long, last long").groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return stored(counted.filter(F.col("n") >= documents), "repeated")


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _row(doc: int | None, text: bytes) -> bytes:
    """A digest of a row: equal rows lose equal lines."""
    return xxhash.xxh3_128_digest(text, seed=0 if doc is None else (2 * doc + 1) % (1 << 64))


def without(text: bytes, dropped: set[bytes]) -> tuple[bytes, int, int]:
    """(the other lines of ``text``, its lines, lines dropped)."""
    lines = text.split(b"\n")
    if not dropped:
        return text, len(lines), 0
    kept = [line for line in lines if key_of(line) not in dropped]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


_CUT = "doc_id long, n_lines long, n_dropped long, text string"


def _cut(docs: Iterable[tuple[int | None, bytes, set[bytes]]]) -> pa.RecordBatch:
    rows = [(doc, *without(text, dropped)) for doc, text, dropped in docs]
    texts = pa.array([r[1] for r in rows], pa.binary())
    numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 2, 3)]
    return pa.record_batch([*numbers, texts.view(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])


def without_repeated_lines(docs: DataFrame, least: int = 40, documents: int = 5) -> DataFrame:
    """One row per document: doc_id, n_lines (before), n_dropped, text (what is left)."""
    docs = ids_and_texts(docs)
    confirmed = repeated_keys(docs, least, documents)
    if confirmed.count() > CONFIRMED:
        return _joined_cut(docs, confirmed, least)
    own = _digests(confirmed).toArrow()
    halves = np.frombuffer(b"".join(own.column("key").to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
    order, last = np.lexsort((halves[:, 1], halves[:, 0])), own.column("last")
    sent = docs.sparkSession.sparkContext.broadcast((halves[order, 0], halves[order, 1], last.is_valid().to_numpy()[order], last.fill_null(0).to_numpy()[order]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, stays, last = sent.value
        for batch in sliced(batches, 500):
            ids, texts = batch.column("doc_id").to_pylist(), _texts(batch)
            dropped: list[set[bytes]] = [set() for _ in texts]
            found = [(i, k) for i, text in enumerate(texts) for k in long_keys(text, least)]
            digests = np.frombuffer(b"".join(_digest(k) for _, k in found), ">u8").reshape(-1, 2).astype(np.uint64)
            at = np.searchsorted(high, digests[:, 0])
            near = np.flatnonzero(at < len(high))
            for x in near[high[at[near]] == digests[near, 0]].tolist():
                i, key = found[x]
                for j in range(int(at[x]), int(np.searchsorted(high, digests[x, 0], "right"))):
                    if low[j] == digests[x, 1] and stays[j] and ids[i] != last[j]:
                        dropped[i].add(key)
            yield _cut(zip(ids, texts, dropped, strict=True))

    return docs.mapInArrow(cut, _CUT)


def _digests(confirmed: DataFrame) -> DataFrame:
    """key (digest), last, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([_digest(k) for k in batch.column("key").to_pylist()], pa.binary()), batch.column("last"), batch.column("n")], names=["key", "last", "n"])

    return confirmed.mapInArrow(run, "key binary, last long, n long")


def _joined_cut(docs: DataFrame, confirmed: DataFrame, least: int) -> DataFrame:
    """The same by joins: lines with the confirmed keys, texts with what they lose."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            rows = [(_row(doc, text), doc, _digest(k)) for doc, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True) for k in long_keys(text, least)]
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.int64(), pa.binary()))], names=["row", "doc_id", "key"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            ids = batch.column("doc_id")
            yield pa.record_batch([pa.array(list(map(_row, ids.to_pylist(), _texts(batch))), pa.binary()), ids, batch.column("text")], names=["row", "doc_id", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            rows = []
            for doc, text, gone in zip(batch.column("doc_id").to_pylist(), _texts(batch), batch.column("gone").to_pylist(), strict=True):
                gone = set(gone or ())
                rows.append((doc, text, {k for k in long_keys(text, least) if _digest(k) in gone} if gone else set()))
            yield _cut(rows)

    found = joined(docs.mapInArrow(lines, "row binary, doc_id long, key binary"), _digests(confirmed), "key")
    lost = found.filter("last is not null and not (doc_id <=> last)").groupBy("row").agg(F.collect_set("key").alias("gone"), F.count("*").alias("n"))
    texts = docs.mapInArrow(keyed, "row binary, doc_id long, text string")
    return texts.join(lost.select("row", "gone"), "row", "left").select("doc_id", "text", "gone").mapInArrow(cut, _CUT)


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
