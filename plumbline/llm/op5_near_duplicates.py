"""MinHash near-duplicates: a multi-index Hamming join of signatures, then exact confirmation.

A document's signature holds 96 minima of its shingle hashes, cut to 16 bits, in 24 chunks of four.
Two signatures that differ in at most 47 symbols have, by pigeonhole, a chunk with at most one
differing symbol; so each chunk is indexed four times, each time with one symbol masked, and every
pair under that distance shares a key. Pairs that share a key and differ in at most 47 symbols are
candidates (a pair at similarity 0.75 differs in more with probability 1e-7), and the full shingle
sets decide.

Nothing in the join grows with the number of pairs:

* documents of equal shingle sets form a class, and one of them stands for it;
* a task that holds a key's documents compares their signatures and gives back a spanning forest of
  the candidate pairs, which connects the same documents with fewer links than documents;
* components of the forests are the groups within which links can exist. A group's full sets meet
  in a task, which intersects each document with all others at once and gives back a spanning
  forest of the confirmed links. Every two documents of a group are compared unless they are
  connected already, so no link that matters is left out;
* a key or group of more than ``BLOCK`` (``SETS``) documents, or of more than ``SHINGLES``
  shingles, is cut into blocks, and each pair of blocks is one task's; keys and groups are counted
  with partial sums, never in a window.

Defined results: null, empty or wordless texts have 0 shingles and are linked with nothing; a
repeated ``doc_id`` gives one row (its largest set); rows with a null ``doc_id`` take no part and
come back each with a null component, kept; ties cannot occur, components are named by their smallest
id; a very long text is one set, held alone with those it is compared with; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ids_and_texts, joined, key_filter, memo, passes, sliced, stored, table, tidied
from plumbline.llm.graph import components
from plumbline.llm.shingles import MinHash, mixed, shingle_sets

SYMBOLS, CHUNK, DISTANCE = 96, 4, 47
PERCENT = 75
BLOCK = 10_000  # signatures of a key that one task holds, twice at most
SETS, SHINGLES = 3_000, 4_000_000  # sets of a group, and their shingles, that one task holds, twice at most
PICKED = 1 << 25  # documents up to which a broadcast filter, 16 bits for each, picks the texts to read again

_SIGNED = "doc_id long, n_shingles long, class binary, signature binary"


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (digest of the shingle set), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(SYMBOLS)
        memo("near-duplicates")  # empties what other operators remember
        for batch in sliced(batches):
            n, classes, signatures = [], [], []
            for grams in shingle_sets(batch.column("text")):
                n.append(len(grams))
                classes.append(xxhash.xxh3_128_digest(grams.tobytes()))
                signatures.append(minhash.of(grams).tobytes() if len(grams) else b"")
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "class", "signature"])

    return ids_and_texts(docs).mapInArrow(tidied(run), _SIGNED)


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """A 64-bit key for each chunk and masked symbol: a row per signature."""
    keys = []
    for low in range(0, SYMBOLS, CHUNK):
        for masked in range(CHUNK):
            key = np.full(len(symbols), low * CHUNK + masked, np.uint64)
            for i in range(CHUNK):
                if i != masked:
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + symbols[:, low + i].astype(np.uint64))
            keys.append(key)
    return np.stack(keys, axis=1).astype(np.int64)


def _keyed(classes: DataFrame) -> DataFrame:
    """doc, key: every key of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):  # 96 keys a row
            if batch.num_rows:
                keys = chunk_keys(_symbols(batch.column("signature")))
                yield pa.record_batch([pa.array(np.repeat(batch.column("doc").to_numpy(), keys.shape[1])), pa.array(keys.ravel())], names=["doc", "key"])

    return classes.select("doc", "signature").mapInArrow(tidied(run), "doc long, key long")


def blocked(rows: DataFrame, counts: DataFrame, group: str, row: str, blocks) -> DataFrame:
    """rows with ``spot``, one for each pair of the group's blocks that the row's block is in.

    ``counts``: group, n (rows) and what ``blocks``, a column, needs to tell a group's blocks.
    """
    cut = joined(rows, counts.withColumn("_n", blocks.cast("int")), group).withColumn("_b", F.pmod(F.xxhash64(row), F.col("_n")).cast("int"))
    pair = F.struct(F.least("_b", "_o"), F.greatest("_b", "_o"))
    meets = cut.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return meets.select(row, F.xxhash64(F.col(group), pair).alias("spot"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each spot, from batches sorted by spot."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        spots = batch.column("spot").to_numpy()
        cuts = (np.flatnonzero(spots[1:] != spots[:-1]) + 1).tolist()
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            part = batch.slice(low, high - low)
            if held and held[0]["spot"][0] != part["spot"][0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(found, np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], names=["a", "b"])


def candidate_forest(classes: DataFrame) -> DataFrame:
    """(a, b) of classes (doc, signature): in every key, a spanning forest of the pairs within the signature distance."""

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in _groups(batches):
            docs, symbols = group["doc"].to_numpy(), _symbols(group["signature"].combine_chunks())
            left = np.arange(len(docs))
            while len(left):  # walk each component from its first row, comparing only with rows not reached
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    at = queue.pop()
                    near = (symbols[left] != symbols[at]).sum(axis=1) <= DISTANCE
                    reached, left = left[near], left[~near]
                    queue += reached.tolist()
                    found += [(docs[at], docs[r]) for r in reached]
            if len(found) > 100_000:
                yield _links(found)
                found = []
        yield _links(found)

    keys = _keyed(classes)
    crowds = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "crowds")
    rows = blocked(keys, crowds, "key", "doc", F.ceil(F.col("n") / BLOCK)).join(classes.select("doc", "signature"), "doc")
    return rows.repartition("spot").sortWithinPartitions("spot").mapInArrow(tidied(span), "a long, b long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, grams of (at least) the wanted documents, from their whole texts: picked by a broadcast
    filter of at most 2 * PICKED bytes, or by a semi-join where there are more of them."""
    n, texts = wanted.count(), ids_and_texts(docs).filter("doc_id is not null")
    if n > PICKED:
        texts, few = texts.join(wanted.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi"), None
    else:
        few = docs.sparkSession.sparkContext.broadcast(key_filter(wanted.select(F.xxhash64("doc").alias("at")), "at", n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if few is not None:
                batch = batch.filter(pa.array(passes(few.value, batch.column("at").to_numpy())))
            yield pa.record_batch([batch.column("doc_id"), pa.array([g.tobytes() for g in shingle_sets(batch.column("text"))], pa.binary())], names=["doc", "grams"])

    return texts.withColumn("at", F.xxhash64("doc_id")).mapInArrow(tidied(run), "doc long, grams binary")


def confirmed_forest(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): in every group (doc, label, n_shingles), a spanning forest of the pairs whose full
    shingle sets have 100 * intersection >= PERCENT * union."""
    counts = groups.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / SETS), F.least(F.ceil(F.col("size") / SHINGLES), F.col("n")))
    groups = stored(blocked(groups.select("doc", "label"), counts, "label", "doc", blocks), "groups")
    rows = _sets(docs, groups.select("doc").distinct()).join(groups, "doc").select("spot", "doc", "grams")

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            yield _links(exact_links(group["doc"].to_pylist(), group["grams"].to_pylist()))

    return rows.repartition("spot").sortWithinPartitions("spot").mapInArrow(tidied(span), "a long, b long").distinct()


def exact_links(docs: list[int], data: list[bytes]) -> list[tuple[int, int]]:
    """A spanning forest of the links between some documents' shingle sets."""
    own: dict[int, bytes] = {}
    for doc, grams in zip(docs, data, strict=True):  # of a repeated id the largest set stands
        own[doc] = max(own.get(doc, b""), grams, key=lambda g: (len(g), xxhash.xxh3_128_digest(g)))
    docs = sorted(own, key=lambda d: (len(own[d]), d))
    sizes = np.array([len(own[d]) // 8 for d in docs])
    names, flat = np.unique(np.frombuffer(b"".join([own[d] for d in docs]), np.uint64), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    there, links = np.zeros(len(names), np.int32), []
    # Walk each component from its first set, comparing only with sets not reached, of fitting size.
    left, n_left, flat_left, start_left = np.arange(len(docs)), sizes, flat, starts
    queue: list[int] = []
    while len(left) or queue:
        if not queue:
            queue, gone = [int(left[0])], np.array([0])
        else:
            i = queue.pop()
            low, high = np.searchsorted(n_left, [-(-PERCENT * sizes[i] // 100), 100 * sizes[i] // PERCENT + 1])
            if low >= high:
                continue
            there[flat[starts[i] : starts[i] + sizes[i]]] = 1
            end = start_left[high] if high < len(left) else len(flat_left)
            same = np.add.reduceat(there[flat_left[start_left[low] : end]], start_left[low:high] - start_left[low])
            there[flat[starts[i] : starts[i] + sizes[i]]] = 0
            gone = np.flatnonzero(100 * same >= PERCENT * (sizes[i] + n_left[low:high] - same)) + low
            links += [(docs[i], docs[j]) for j in left[gone].tolist()]
            queue += left[gone].tolist()
        if len(gone):
            stay = np.ones(len(left), bool)
            stay[gone] = False
            flat_left = flat_left[np.repeat(stay, n_left)]
            left, n_left = left[stay], n_left[stay]
            start_left = np.cumsum(n_left) - n_left
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: see the contract in the module's text."""
    found = stored(signed(docs), "signatures")
    documents = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n_shingles", "class")).alias("x")).select("doc_id", "x.*")
    classes = stored(found.filter("doc_id is not null and n_shingles > 0").groupBy("class").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("x")).select("class", F.col("x.doc_id").alias("doc"), "x.n_shingles", "x.signature"), "classes")
    groups = stored(components(candidate_forest(classes)).withColumnRenamed("node", "doc").join(classes.select("doc", "n_shingles"), "doc"), "candidates")
    labels = components(confirmed_forest(docs, groups))
    classed = documents.join(classes.select("class", F.col("doc").alias("first")), "class", "left").join(labels, F.col("first") == F.col("node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "first")).otherwise(F.col("doc_id"))
    out = classed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = found.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
