"""Benchmark decontamination: rare n-gram seeds join passages to items, Smith-Waterman decides.

An item's seeds are the rarest of its word pairs and triples, by the number of documents and items
that hold them, weighted by log inverse document frequency. Documents and items meet in an equi-join
on seed hashes. Where a stretch of a document holds enough of an item's seed weight, the item is
aligned with it word by word: +2 for a match, -1 for a mismatch or a gap, as a share of the item's
perfect score. Edited and paraphrased copies lose a little of that score, chance overlaps most of it.

1. a map over the texts counts in how many documents each n-gram of an item stands;
2. the seeds are chosen, and a second map gives the places of seeds in documents;
3. places and seeds are joined, then weighed by document and item; what has enough weight becomes
   stretches, and the texts that have any are read again and aligned.

The maps pass only what the items (1, 2) or the stretches (3) hold, by a broadcast filter of 16 bits a
key where there are at most ``FILTERED`` keys; beyond, everything is joined. Items are never
collected and a document's texts are shuffled only if it has a stretch. A seed that very many
documents hold, or an item that leaked into very many, is joined by broadcast (see ``joined``).

Defined results: null or empty texts match nothing, nor do items without words; an item of one word
is found wherever the word stands; repeated rows of an item are one item with several texts, the best
counts, of ties the earliest place; repeated ``doc_id`` rows give their own rows, a null ``doc_id`` a
null one; a very long text is one row of word hashes; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ids_and_texts, joined, key_filter, memo, passes, sliced, stored, table, tidied
from plumbline.llm.words import bytes_of, hashed_words, mixed

FILTERED = 1 << 25
#: ASCII letters to lower case, digits stay, other ASCII to spaces, bytes of other letters stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def word_hashes(text: str) -> np.ndarray:
    return hashed_words(pa.array([text]), _WORDS)[0]


def grams_of(words: np.ndarray, text: np.ndarray, singles: bool) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, place of its first word) of pairs and triples, and of single words if asked.

    ``text``: the text each word is of; no n-gram crosses texts.
    """
    step = np.uint64(0x9E3779B97F4A7C15)
    twos = mixed(words[:-1] * step + words[1:]) if len(words) > 1 else words[:0]
    threes = mixed(twos[:-1] * step + words[2:]) if len(words) > 2 else words[:0]
    at = [np.flatnonzero(text[n:] == text[:-n]) if len(words) > n else np.zeros(0, np.int64) for n in (1, 2)]
    parts = [twos[at[0]], threes[at[1]], *[mixed(words + np.uint64(1))] * singles]
    return np.concatenate(parts).view(np.int64), np.concatenate([*at, *[np.arange(len(words))] * singles])


def held_grams(texts: pa.Array, few, singles: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, text, place in its text) of the n-grams that pass the filter ``few``, if there is one."""
    words, first = hashed_words(texts, _WORDS)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    found, at = grams_of(words, text, singles)
    if few is not None:
        use = passes(few.value, found)
        found, at = found[use], at[use]
    return found, text[at], at - first[text[at]]


_ITEMS = "item long, item_id long, n_words int, words binary, grams array<long>"


def _items(benchmark: DataFrame) -> DataFrame:
    """One row per item text: a key, its words' hashes, its distinct n-grams (of one word: that word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True):
                words = word_hashes(text)
                if len(words):
                    rows.append({"item": item, "item_id": item_id, "n_words": len(words), "words": words.tobytes(), "grams": np.unique(grams_of(words, np.zeros(len(words)), len(words) == 1)[0]).tolist()})
            schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32()), ("words", pa.binary()), ("grams", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return stored(rows.withColumn("item", F.xxhash64("item_id", "text")).select("item", "item_id", "text").mapInArrow(run, _ITEMS), "items")


def _filter_of(keys: DataFrame, key: str):
    """A broadcast filter over distinct keys; None where there are too many of them."""
    n = keys.count()
    return keys.sparkSession.sparkContext.broadcast(key_filter(keys, key, n)) if n <= FILTERED else None


def document_frequencies(docs: DataFrame, grams: DataFrame, singles: bool) -> DataFrame:
    """gram, n: documents that hold each of ``grams``."""
    few = _filter_of(grams, "gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo("decontamination")  # empties what other operators remember
        for batch in batches:
            held = [np.zeros(0, np.int64)]
            for part in sliced([batch]):
                found, text, _ = held_grams(part.column("text"), few, singles)
                order = np.lexsort((text, found))
                found, text = found[order], text[order]
                once = np.ones(len(found), bool)
                once[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
                held.append(found[once])
            gram, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.record_batch([pa.array(gram), pa.array(n, pa.int64())], names=["gram", "n"])

    return grams.join(docs.mapInArrow(tidied(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "gram", "left").select("gram", F.coalesce("n", F.lit(0)).alias("n"))


def seeds_of(items: DataFrame, frequencies: DataFrame, documents: int, share: float, least: int) -> DataFrame:
    """item, gram, weight: each item's rarest n-grams, weighed by log(documents / frequency)."""
    held = items.select("item", F.explode("grams").alias("gram"))
    shared = held.groupBy("gram").agg(F.count("*").alias("items")).join(frequencies, "gram")
    rank = Window.partitionBy("item").orderBy(F.col("n") + F.col("items"), "gram")  # an item's own n-grams
    ranked = joined(held, shared.select("gram", "items", F.col("n").alias("df")), "gram", "items").withColumnRenamed("df", "n")
    ranked = ranked.withColumn("place", F.row_number().over(rank)).withColumn("own", F.count("*").over(Window.partitionBy("item")))
    weight = F.log((documents + 1) / (F.col("n") + 1)) + 0.1
    return ranked.filter(F.col("place") <= F.greatest(F.lit(least), F.ceil(share * F.col("own")))).select("item", "gram", weight.alias("weight"))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best local score, end of it in the passage) of Smith-Waterman: match 2, mismatch or gap -1."""
    row, at = np.zeros(len(passage) + 1, np.int32), np.arange(len(passage) + 1, dtype=np.int32)
    best, end = 0, 0
    for word in item:
        step = np.maximum(row - 1, 0)
        step[1:] = np.maximum(step[1:], row[:-1] + np.where(passage == word, 2, -1))
        row = np.maximum.accumulate(step + at) - at  # gaps in the item: -1 a word
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def stretches(positions: list[int], weights: list[float], length: int, needed: float) -> Iterator[tuple[int, int]]:
    """(first, last) of maximal runs of windows of ``length`` words with enough seed weight."""
    low, held, run = 0, 0.0, None
    for high, at in enumerate(positions):
        held += weights[high]
        while positions[low] < at - length:
            held -= weights[low]
            low += 1
        if held >= needed - 1e-9:
            if run and positions[low] <= run[1] + length:
                run = (run[0], at)
            else:
                if run:
                    yield run
                run = (positions[low], at)
    if run:
        yield run


def _keys(batch: pa.RecordBatch, rows: np.ndarray) -> list[bytes]:
    """A digest of id and text of some rows."""
    data, at = bytes_of(batch.column("text"))
    ids = batch.column("doc_id").take(pa.array(rows, pa.int64())).to_pylist()
    return [xxhash.xxh3_128_digest(data[at[i] : at[i + 1]], seed=0 if d is None else (2 * d + 1) % (1 << 64)) for i, d in zip(rows.tolist(), ids, strict=True)]


def _half(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _places(docs: DataFrame, seeds: DataFrame, singles: bool) -> DataFrame:
    """doc, gram, at: where (at least) the seeds stand; doc is a digest of id and text."""
    few = _filter_of(seeds.select("gram").distinct(), "gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            gram, text, at = held_grams(batch.column("text"), few, singles)
            rows, text = np.unique(text, return_inverse=True)
            doc = pa.array(_keys(batch, rows), pa.binary()).take(pa.array(text, pa.int64()))
            yield pa.record_batch([doc, pa.array(gram), pa.array(at, pa.int32())], names=["doc", "gram", "at"])

    return docs.mapInArrow(tidied(run), "doc binary, gram long, at int")


def candidates(docs: DataFrame, items: DataFrame, seeds: DataFrame, enough: float, singles: bool) -> DataFrame:
    """doc, items: (item_id, words, stretches) of each item that a document may hold."""
    owners = seeds.groupBy("gram").agg(F.collect_list(F.struct("item", "weight")).alias("owners"))
    places = stored(_places(docs, seeds, singles), "places")
    crowds = places.groupBy("gram").agg(F.count("*").alias("n"))
    hits = joined(places, owners.join(crowds, "gram"), "gram").select("doc", "at", F.explode("owners").alias("x")).select("doc", "at", "x.item", "x.weight")
    hits = hits.groupBy("doc", "item").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("hits"))
    total = seeds.groupBy("item").agg((F.sum("weight") * enough).alias("needed"))
    facts = items.select("item", "item_id", "n_words", "words").join(total, "item").join(hits.groupBy("item").agg(F.count("*").alias("n")), "item")
    strong = joined(hits, facts, "item").filter("weight >= needed - 1e-9")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            column = batch.column("hits")
            at, weight = column.flatten().flatten()
            cuts, found = np.cumsum(np.append(0, pc.list_value_length(column).to_numpy(zero_copy_only=False))).tolist(), []
            for i, (n, needed) in enumerate(zip(batch.column("n_words").to_pylist(), batch.column("needed").to_pylist(), strict=True)):
                own = slice(cuts[i], cuts[i + 1])
                found.append([{"low": a, "high": b} for a, b in stretches(at[own].to_pylist(), weight[own].to_pylist(), 2 * n, needed)])
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.record_batch([batch.column("doc"), batch.column("item_id"), batch.column("words"), pa.array(found, kind)], names=["doc", "item_id", "words", "found"])

    near = strong.select("doc", "item_id", "words", "n_words", "needed", "hits").mapInArrow(run, "doc binary, item_id long, words binary, found array<struct<low:int,high:int>>")
    return near.filter(F.size("found") > 0).groupBy("doc").agg(F.collect_list(F.struct("item_id", "words", "found")).alias("items"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, enough: float = 0.1, share: float = 0.75, least: int = 8) -> DataFrame:
    """doc_id, item_id, score, end_word: documents that hold a copy of an item, edited or not."""
    docs, items = ids_and_texts(docs), _items(benchmark)
    singles = bool(items.filter("n_words = 1").limit(1).count())
    frequencies = stored(document_frequencies(docs, items.select(F.explode("grams").alias("gram")).distinct(), singles), "frequencies")
    seeds = stored(seeds_of(items, frequencies, docs.count(), share, least), "seeds")
    wanted = stored(candidates(docs, items, seeds, enough, singles), "stretches")

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([_half(k) for k in batch.column("doc").to_pylist()], pa.int64())], names=["half"])

    few = _filter_of(wanted.select("doc").mapInArrow(halves, "half long"), "half")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys = _keys(batch, np.arange(batch.num_rows))
            use = passes(few.value, np.array([_half(k) for k in keys], np.int64)) if few is not None else np.ones(len(keys), bool)
            whole = pa.record_batch([pa.array(keys, pa.binary()), batch.column("doc_id"), batch.column("text")], names=["doc", "doc_id", "text"])
            yield whole.filter(pa.array(use))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 100):
            rows = []
            for doc_id, text, held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items")), strict=True):
                words, best = word_hashes(text), {}
                for item in held:
                    own = np.frombuffer(item["words"], np.uint64)
                    n = len(own)
                    for s in item["found"]:
                        low = max(0, s["low"] - n)
                        score, end = align(own, words[low : s["high"] + 3 + n])
                        found = (score / (2 * n), -(low + end))
                        if found[0] >= threshold and found > best.get(item["item_id"], (0.0, 0)):
                            best[item["item_id"]] = found
                rows += [(doc_id, i, score, -end) for i, (score, end) in best.items()]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.record_batch([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["doc_id", "item_id", "score", "end_word"])

    # Stored, so that a task never runs this map and the next one side by side in two Python workers.
    texts = stored(docs.mapInArrow(tidied(again), "doc binary, doc_id long, text string"), "suspects")
    return texts.join(wanted, "doc").select("doc_id", "text", "items").mapInArrow(judge, "doc_id long, item_id long, score double, end_word long")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
