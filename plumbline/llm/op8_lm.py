"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

The model interpolates word pairs with single words. Counts of pairs are not kept but quantised on a
log scale, from a count of 1 on, and a pair of level q is put into a Bloom filter q times, as
(pair, 1) .. (pair, q). A level is read by probing until one is missing: never too low, and too high
with the filter's small error rate. With ĉ the count that stands for the level read (at most the
counts of the pair's words), S and N the sum of ĉ and the number of different words after h,

    p(w | h) = (ĉ(h, w) + N(h) p(w)) / (S(h) + N(h)),    p(w) = (c(w) + 1) / (tokens + words + 1)

so the mass that quantising takes or adds is in S, and what the followers of h leave goes to the
single words: over all words and one unknown word p( | h) is 1, but for pairs that were never seen
and that the filter takes for seen. After a word that training has not seen, p(w) alone decides.

Texts are packed once into chunks of words as numbers, and only chunks travel after that. N-grams go
by ranges of a 64-bit hash to shards, so that the filter's size follows the corpus while a shard's
does not; keys that two n-grams share (about n^2 / 2^65 pairs of them among n) count together.

1. a chunk sends each shard the keys of its n-grams with their training counts; a shard sums them,
   builds its part of the filter, and answers each chunk in the order of the keys it sent: counts of
   words, and for each pair whether it is the first chunk that has it.
2. the levels of a chunk's pairs are read from the filter: from all parts, broadcast to the workers,
   where their size is bounded by ``BROADCAST_BYTES``; for a larger corpus each shard probes its own
   part and the levels are in its answer. Both ways read the same bits and give the same scores. Each
   pair's ĉ is added to its first word's sums by the one chunk that has it first.
3. the sums come back to the chunks, which score their texts.

Training documents are those whose crc32(doc_id as text) mod 7 is not 2. Tokens are lower-cased
words and one end mark per document.

Defined results: null text = empty text = its end mark; a null ``doc_id`` counts as the text
"null"; rows that share a ``doc_id`` are separate documents; a very long text is a chunk of its own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ids_and_texts, lower_words, stored, table
from plumbline.llm.shingles import mixed

CHUNK_BYTES = 8 << 20  # text bytes of a chunk
SHARD_BYTES = 6 << 20  # text bytes whose n-grams make a shard
BROADCAST_BYTES = 48 << 20
BITS_PER_ENTRY, PROBES = 12, 6
BASE = 1.5  # ratio of neighbouring count levels
END = b"\n"  # no word holds white space
FIRST = 0x80  # marks, in an answer, the chunk that has a pair first; the other bits are its level


def level(count: np.ndarray) -> np.ndarray:
    """Quantised counts: 0 for none, else 1 + floor(log_BASE(count))."""
    return np.where(count > 0, 1 + np.floor(np.log(np.maximum(count, 1)) / math.log(BASE) + 1e-9), 0).astype(np.int64)


#: Twice the middle of each level's counts: whole numbers, whose sums are exact.
_TWICE = np.array([0, *(math.ceil(BASE ** (q - 1) - 1e-9) + math.ceil(BASE**q - 1e-9) - 1 for q in range(1, 88))], np.int64)


def twice_expected(levels: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Twice the count that a pair's level stands for, at most the counts of its words."""
    return np.minimum(_TWICE[np.minimum(levels, 87)], 2 * np.minimum(context, word))


def _places(grams: np.ndarray, q: int, bits: int) -> Iterator[np.ndarray]:
    a = mixed(grams + np.uint64(q * 0x9E3779B97F4A7C15 % (1 << 64)))
    b = mixed(a) | np.uint64(1)
    for i in range(PROBES):
        yield ((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64)


def build_filter(grams: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """The bits (bytes) of a filter over n-grams with these counts; its size follows the entries."""
    levels = level(counts)
    bits = max(64, -(-int(levels.sum()) * bits_per_entry // 8) * 8)
    table_ = np.zeros(bits // 8, np.uint8)
    for q in range(1, int(levels.max(initial=0)) + 1):
        for at in _places(grams[levels >= q], q, bits):
            np.bitwise_or.at(table_, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return table_


def read_levels(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Levels by repeated probes: those still found at level q are asked for q + 1."""
    levels, left, q = np.zeros(len(grams), np.int64), np.arange(len(grams)), 1
    while len(left):
        found = np.ones(len(left), bool)
        for at in _places(grams[left], q, len(bits) * 8):
            found &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        left = left[found]
        levels[left] = q
        q += 1
    return levels


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, byte planes compressed."""
    most = int(x.max(initial=0))
    width = next(n for n in (1, 2, 4, 8) if most >> (8 * n) == 0)
    planes = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + zstandard.compress(planes, 1)


def _wide(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel().astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    """Ascending keys as steps, lower and upper halves apart."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return len(keys).to_bytes(4, "little") + (steps & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + _small(steps >> np.uint64(32))


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    low = np.frombuffer(data, "<u4", n, 4).astype(np.uint64)
    return np.cumsum(low | _wide(data[4 + 4 * n :]).astype(np.uint64) << np.uint64(32), dtype=np.uint64)


CHUNKS = "chunk long, bytes long, tokens long, ids binary, named binary, held_out binary, lengths binary, words binary, vocabulary binary"


def packed(docs: DataFrame) -> DataFrame:
    """The texts in chunks: each document's words as numbers into the chunk's vocabulary of hashes."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), F.lit(7)) == 2

    def chunk_of(number: int, size: int, rows: list[tuple], seen: dict[bytes, int], words: list[list[int]]) -> pa.RecordBatch:
        ids, held = zip(*rows, strict=True)
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter((w for d in words for w in d), np.int64, int(lengths.sum()))
        vocabulary = np.array([xxhash.xxh3_64_intdigest(w) for w in seen], "<u8")
        row = {
            "chunk": number, "bytes": size, "tokens": len(flat), "ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "named": np.array([i is not None for i in ids]).tobytes(),
            "held_out": np.array(held).tobytes(), "lengths": lengths.astype("<u4").tobytes(), "words": _small(flat), "vocabulary": vocabulary.tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([(k, pa.int64() if i < 3 else pa.binary()) for i, k in enumerate(row)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, rows, seen, words = TaskContext.get().partitionId() << 32, 0, [], {END: 0}, []
        for batch in batches:
            for doc, text, held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held_out")), strict=True):
                rows.append((doc, held))
                words.append([seen.setdefault(w, len(seen)) for w in [*lower_words(text), END]])
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield chunk_of(number, size, rows, seen, words)
                    number, size, rows, seen, words = number + 1, 0, [], {END: 0}, []
        if rows:
            yield chunk_of(number, size, rows, seen, words)

    return ids_and_texts(docs).withColumn("held_out", held_out).mapInArrow(run, CHUNKS)


class Chunk:
    """A chunk's n-grams, as numbers into its distinct words and pairs, and their keys."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.word = _wide(row["words"])
        self.held_out = np.frombuffer(row["held_out"], bool)
        hashes = np.frombuffer(row["vocabulary"], "<u8")
        self.words = len(hashes)
        before = np.r_[0, self.word[:-1]]
        before[np.cumsum(self.lengths) - self.lengths] = 0  # a document begins after an end mark
        pairs, self.pair = np.unique(before * self.words + self.word, return_inverse=True)
        self.first, self.second = pairs // self.words, pairs % self.words
        own = mixed(hashes)
        #: The last bit tells pairs from words.
        self.word_keys = own & ~np.uint64(1)
        self.keys = np.concatenate([self.word_keys, mixed(own[self.first] * np.uint64(3) + hashes[self.second]) | np.uint64(1)])

    def counts(self) -> np.ndarray:
        use = np.repeat(~self.held_out, self.lengths)
        return np.concatenate([np.bincount(self.word[use], minlength=self.words), np.bincount(self.pair[use], minlength=len(self.first))])


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its keys' places in ascending order): shards are ranges of keys."""
    order = np.argsort(keys)
    shard = ((keys[order] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(keys) else np.zeros(0, int)
    for low, high in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(shard[low]), order[low:high]


_SENT = "shard long, chunk long, keys binary, a binary, b binary"
_ANSWER = "what string, shard long, chunk long, a binary, b binary, tokens long, words long"
_ANSWERS = [c.split()[0] for c in _ANSWER.split(", ")]
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _messages(number: int, keys: np.ndarray, shards: int, a: np.ndarray, b: np.ndarray | None = None) -> pa.Table:
    """Two numbers for each key, by shard."""
    rows = [(s, number, _pack(keys[at]), _small(a[at]), _small(b[at]) if b is not None else b"") for s, at in _by_shard(keys, shards)]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "chunk", "keys", "a", "b"])


def _send(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                yield from _messages(chunk.number, chunk.keys, shards, chunk.counts()).to_batches()

    return run


def _gathered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(messages by chunk, edges of each one's keys, distinct keys, each key's number, its first place)."""
    pdf = pdf.sort_values("chunk")
    parts = [_unpack(k) for k in pdf["keys"]]
    grams, first, at = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    return pdf, np.cumsum([0, *map(len, parts)]), grams, at, first


def _sum(column: pd.Series, at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, np.concatenate([_wide(x) for x in column]), n).astype(np.int64)


def _answer(by_broadcast: bool, bits_per_entry: int):
    """A shard: counts of words and places of pairs for each chunk, with levels or beside the filter."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        pdf, edges, grams, at, first = _gathered(pdf)
        total = _sum(pdf["a"], at, len(grams))
        word = grams & np.uint64(1) == 0
        bits = build_filter(grams[~word], total[~word], bits_per_entry)
        rows = [("sums", shard, -1, b"", b"", int(total[word].sum()), int((total[word] > 0).sum()))]
        marks = np.zeros(len(at), np.uint8)
        if by_broadcast:
            rows.append(("filter", shard, -1, bits.tobytes(), b"", 0, 0))
        else:
            levels = np.zeros(len(grams), np.uint8)
            levels[~word] = read_levels(bits, grams[~word])
            marks = levels[at]
        marks[first[~word & (total > 0)]] |= FIRST
        for chunk, low, high in zip(pdf["chunk"], edges, edges[1:], strict=False):
            mine = at[low:high]
            rows.append(("answer", shard, chunk, _small(marks[low:high]), _small(total[mine[word[mine]]]), 0, 0))
        return pd.DataFrame(rows, columns=_ANSWERS)

    return run


def _answer_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard of contexts: what all chunks say of them, to each chunk that asks."""
    shard = int(pdf["shard"].iloc[0])
    pdf, edges, keys, at, _ = _gathered(pdf)
    mass, followers = (_sum(pdf[c], at, len(keys)) for c in ("a", "b"))
    rows = [("context", shard, chunk, _small(mass[at[low:high]]), _small(followers[at[low:high]]), 0, 0) for chunk, low, high in zip(pdf["chunk"], edges, edges[1:], strict=False)]
    return pd.DataFrame(rows, columns=_ANSWERS)


class Answered(Chunk):
    """A chunk with what the shards said: exact counts of words, levels of pairs."""

    def __init__(self, row: dict, answers: pa.Table, shards: int, filters: dict[int, np.ndarray] | None):
        super().__init__(row)
        said = {r["shard"]: r for r in answers.to_pylist() if r["what"] == "answer"}
        self.exact, marks, levels = np.zeros(self.words, np.int64), np.zeros(len(self.keys), np.uint8), np.zeros(len(self.keys), np.int64)
        for s, at in _by_shard(self.keys, shards):
            marks[at] = _wide(said[s]["a"])
            own = at[at < self.words]
            self.exact[own] = _wide(said[s]["b"])
            if filters is not None:
                pairs = at[at >= self.words]
                levels[pairs] = read_levels(filters[s], self.keys[pairs])
        levels = levels if filters is not None else (marks & np.uint8(FIRST - 1)).astype(np.int64)
        self.has_first = (marks[self.words :] & FIRST) != 0
        self.twice = twice_expected(levels[self.words :], self.exact[self.first], self.exact[self.second])


def score(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    chunks = stored(packed(docs), "lm-chunks")
    size, tokens = (x or 0 for x in chunks.agg(F.sum("bytes"), F.sum("tokens")).first())
    shards, contexts = max(1, -(-size // SHARD_BYTES)), max(1, -(-size // (8 * SHARD_BYTES)))
    # A pair of level q occurs at least q times, so there are no more entries than tokens.
    by_broadcast = tokens * bits_per_entry // 8 <= broadcast_bytes
    answers = stored(chunks.mapInArrow(_send(shards), _SENT).groupBy("shard").applyInPandas(_answer(by_broadcast, bits_per_entry), _ANSWER), "lm-shards")
    train_tokens, vocabulary = (int(x or 0) for x in answers.filter("what = 'sums'").agg(F.sum("tokens"), F.sum("words")).first())
    filters = {r["shard"]: np.frombuffer(r["a"], np.uint8) for r in answers.filter("what = 'filter'").select("shard", "a").collect()} if by_broadcast else None
    shared = spark.sparkContext.broadcast(filters)
    replies = answers.filter("what = 'answer'")

    def add(rows: pa.Table, said: pa.Table) -> pa.Table:
        chunk = Answered(rows.to_pylist()[0], said, shards, shared.value)
        mine = chunk.has_first & (chunk.twice > 0)
        mass, followers = np.bincount(chunk.first[mine], chunk.twice[mine], chunk.words).astype(np.int64), np.bincount(chunk.first[mine], minlength=chunk.words)
        return _messages(chunk.number, chunk.word_keys, contexts, mass, followers)

    sums = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(add, _SENT).groupBy("shard").applyInPandas(_answer_sums, _ANSWER)

    def finish(rows: pa.Table, said: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        chunk = Answered(row, said, shards, shared.value)
        mass, followers = np.zeros(chunk.words), np.zeros(chunk.words)
        told = {r["shard"]: r for r in said.to_pylist() if r["what"] == "context"}
        for s, at in _by_shard(chunk.word_keys, contexts):
            mass[at], followers[at] = _wide(told[s]["a"]) / 2, _wide(told[s]["b"])
        p_word = (chunk.exact + 1) / (train_tokens + vocabulary + 1)
        seen = followers[chunk.first]
        whole = mass[chunk.first] + seen
        p = np.where(whole > 0, (chunk.twice / 2 + seen * p_word[chunk.second]) / np.maximum(whole, 1), p_word[chunk.second])
        per_doc = lambda x: np.add.reduceat(x, np.cumsum(chunk.lengths) - chunk.lengths)
        ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=~np.frombuffer(row["named"], bool))
        known = per_doc((chunk.exact > 0).astype(np.int64)[chunk.word])
        base = per_doc(np.log10(p_word)[chunk.word])
        columns = [ids, chunk.held_out, chunk.lengths, known, np.full(len(ids), train_tokens), base, per_doc(np.log10(p)[chunk.pair])]
        return pa.table([pa.array(c) for c in columns], names=[c.split()[0] for c in _OUT.split(", ")])

    return chunks.groupBy("chunk").cogroup(replies.unionByName(sums).groupBy("chunk")).applyInArrow(finish, _OUT)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
