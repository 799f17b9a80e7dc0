"""A positional inverted index, cover-density ranking over it, and hybrid search below filters.

The index is a stored table of postings (term, row, positions), cut into folders by the columns that
searches filter by and sorted by term within each file, so that a search reads the row groups of its own
terms in the folders that its filters allow. It is written once and read by every search after that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions import text as T
from plumbline.operators import search as S
from plumbline.session import attach, shared_dir


#: Buckets that a term's postings are spread over, so that a term of every row is not one bucket's; buckets of a
#: partition; rows whose words are sorted together.
SPREAD, BUCKETS, TOGETHER = 16, 4, 1_000


def _postings(batch: pa.RecordBatch, kept: list[str]) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """(term, ``kept`` and positions of each word of each row; the word's number and the row's number of each)."""
    lists = batch.column("_tokens")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code, at = coded.indices.to_numpy(), np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    order = np.lexsort((code, at))  # stable: positions stay ascending
    code, at = code[order], at[order]
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])]) if len(order) else np.zeros(0, np.int64)
    terms = coded.dictionary.take(pa.array(code[starts], pa.int32()))
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
    rows = pa.array(at[starts], pa.int64())
    found = pa.record_batch([terms, *(batch.column(c).take(rows) for c in kept), positions], names=["term", *kept, "positions"])
    hashes = np.array([zlib.crc32(t.encode()) for t in coded.dictionary.to_pylist()], np.int64)
    return found, hashes[code[starts]] if len(starts) else starts, at[starts]


def postings(df: DataFrame, row: str, text: str, by: list[str] | None = None) -> DataFrame:
    """term, row, positions (from 1, ascending) and ``by``, each term's dealt to few partitions. A null text has no postings, nor has a null row.

    A row's postings are made where its text is, by sorting the words of a batch. They are shuffled once,
    as compressed columns for each bucket of terms, which is a third of what they take as rows.
    """
    spark = attach(df.sparkSession)
    own = df.filter(F.col(row).isNotNull()).select(row, *(by or []), T.letter_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_tokens"))
    kinds, kept = dict(own.dtypes), [row, *(by or [])]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * BUCKETS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for whole in batches:
            for low in range(0, whole.num_rows, TOGETHER):
                found, term, at = _postings(whole.slice(low, TOGETHER), kept)
                bucket = (term + at % SPREAD) % buckets
                order = np.argsort(bucket, kind="stable")
                names, starts = np.unique(bucket[order], return_index=True)
                blocks = []
                for begin, end in zip(starts, np.append(starts[1:], len(order)), strict=True):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, found.schema, options=options) as out:
                        out.write_batch(found.take(pa.array(order[begin:end])))
                    blocks.append(sink.getvalue().to_pybytes())
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block"):
                yield from pa.ipc.open_stream(block.as_buffer())

    dealt = own.mapInArrow(pack, "bucket long, block binary").repartition(parts, "bucket")
    return dealt.mapInArrow(unpack, "term string, " + "".join(f"`{c}` {kinds[c]}, " for c in kept) + "positions array<int>")


@dataclass
class Index:
    """A stored index; ``by`` are its folders."""

    spark: SparkSession
    path: str
    row: str
    by: list[str]
    schema: str

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def frequencies(self) -> DataFrame:
        """term, row, tf."""
        return self.read().select("term", self.row, F.size("positions").cast("long").alias("tf"))

    def lengths(self) -> DataFrame:
        """row, words of the rows that have any."""
        return self.spark.read.parquet(f"{self.path}-lengths")

    def of(self, terms: list[str]) -> DataFrame:
        """The postings of some terms; the filter reaches the files' statistics."""
        return self.read().filter(F.col("term").isin(terms))


def write_index(df: DataFrame, row: str, text: str, by: list[str] | None = None, path: str | None = None) -> Index:
    """Write the index, each file sorted by term. Postings are shuffled once; a term's are spread over several files."""
    spark, path = df.sparkSession, path or shared_dir(df.sparkSession, "postings")
    found = postings(df, row, text, by)
    ordered = found.sortWithinPartitions(*(by or []), "term", row)
    writer = ordered.write.partitionBy(*by) if by else ordered.write
    writer.parquet(path)
    df.filter(F.col(row).isNotNull()).select(row, F.size(T.letter_tokens(F.col(text))).cast("long").alias("words")).filter("words > 0").groupBy(row).agg(F.sum("words").alias("words")).write.parquet(f"{path}-lengths")
    names = ["term", row, "positions", *(by or [])]
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    return Index(spark, path, row, by or [], ", ".join(f"`{n}` {kinds[n]}" for n in names))


def _covers(events: Column, terms: int, weight: float) -> Column:
    """The cover density of one row's occurrences (pos, no; by position) of ``terms`` different terms.

    A fold: where each term was last seen, its place among the occurrences, and where the last cover
    began. The window from the earliest of the last sights to here is a cover if it begins later than
    the one before; its share shrinks with the positions in it that hold no term.
    """
    none = F.array_repeat(F.lit(-1), terms)
    start = F.struct(none.alias("at"), none.alias("place"), F.lit(-1).alias("begun"), F.lit(0).alias("n"), F.lit(0.0).alias("score"))

    def step(s: Column, e: Column) -> Column:
        put = lambda old, new: F.transform(old, lambda x, i: F.when(i == e["no"], new).otherwise(x))
        at, place = put(s["at"], e["pos"]), put(s["place"], s["n"])
        first, low = F.array_min(place), F.array_min(at)
        new = (first >= 0) & (first > s["begun"])
        strange = (e["pos"] - low) - (s["n"] - first)
        return F.struct(at.alias("at"), place.alias("place"), F.when(new, first).otherwise(s["begun"]).alias("begun"), (s["n"] + 1).alias("n"), (s["score"] + F.when(new, F.lit(weight) / (1 + strange)).otherwise(0.0)).alias("score"))

    return F.aggregate(events, start, step, lambda s: s["score"])


def cover_density(index: Index, terms: list[str], every: bool = False, allowed: DataFrame | None = None, weight: float = 0.1) -> DataFrame:
    """row, score: cover density of the rows that hold any of the terms (or every one of them).

    A cover is a shortest stretch of positions that satisfies the query: each occurrence if any term
    will do; otherwise a stretch with all terms that holds no shorter one. A cover adds ``weight``,
    divided by one more than its positions that are none of the query's. ``allowed``: rows that may
    be found; others are left out before anything is ranked. Repeated terms count once.
    """
    terms = list(dict.fromkeys(terms))
    hits = index.of(terms)
    if allowed is not None:
        hits = hits.join(allowed.select(index.row, *index.by), [index.row, *index.by], "left_semi")
    if not every:
        scored = hits.groupBy(index.row).agg(F.sum(F.size("positions")).alias("_n"))
        return scored.select(index.row, F.round(F.col("_n") * weight, 9).alias("score"))
    number = F.create_map(*[F.lit(x) for pair in zip(terms, range(len(terms)), strict=True) for x in pair])[F.col("term")]
    own = F.transform("positions", lambda p: F.struct(p.alias("pos"), number.alias("no")))
    rows = hits.groupBy(index.row).agg(F.count("*").alias("_terms"), F.flatten(F.collect_list(own)).alias("_events"))
    return rows.filter(F.col("_terms") == len(terms)).select(index.row, F.round(_covers(F.array_sort("_events"), len(terms), weight), 9).alias("score"))


def best(scored: DataFrame, row: str, n: int) -> DataFrame:
    """The n best rows with their rank; ties by row."""
    return S.ranked(scored.orderBy(F.desc("score"), row).limit(n), "score", row)


def allowed_rows(df: DataFrame, categories: list[str] | None = None, court_level: str | None = None, as_of: str | None = None, date_from: str | None = None, date_to: str | None = None, dated: str = "decision") -> DataFrame:
    """Rows of (category, court_level, doc_date, valid_from, valid_to) that a search may find.

    ``as_of``: rows of the category ``dated`` by their own day, all others by their interval [from, to),
    whose end may be open but not its start. The date range binds the category ``dated`` alone; there a
    null day is outside of every range.
    """
    is_dated = F.col("category") == dated
    out = df.filter(F.col("category").isin(categories)) if categories else df
    if court_level:
        out = out.filter(F.col("court_level") == court_level)
    if as_of:
        day = F.lit(as_of).cast("date")
        out = out.filter((is_dated & (F.col("doc_date") <= day)) | (~is_dated & (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day))))
    if date_from:
        out = out.filter(~is_dated | (F.col("doc_date") >= F.lit(date_from).cast("date")))
    if date_to:
        out = out.filter(~is_dated | (F.col("doc_date") <= F.lit(date_to).cast("date")))
    return out


def hybrid(index: Index, vectors: DataFrame | None, vector: str, allowed: DataFrame, terms: list[str], asked: list[float] | None, limit: int = 10) -> DataFrame:
    """row, score, mode: ranks by cover density and by vectors, fused, over allowed rows only.

    Both rankings spend their candidate budget on allowed rows. Without a question vector, or without
    vectors, the words alone decide and the mode is ``fulltext``. No terms and no vector: no rows.
    """
    budget, row = S.candidate_budget(limit), index.row
    lists = [best(cover_density(index, terms, allowed=allowed), row, budget)] if terms else []
    mode = "hybrid" if asked is not None and vectors is not None else "fulltext"
    if mode == "hybrid":
        near = vectors.join(allowed.select(row), row, "left_semi")
        lists.append(S.vector_ranking(near, row, vector, F.array(*[F.lit(float(x)) for x in asked]), budget))
    if not lists:
        return allowed.select(row).limit(0).withColumns({"score": F.lit(0.0), "mode": F.lit(mode)})
    fused = S.rrf(lists, row, C.RRF_K).withColumn("score", F.round("score", 9))
    return fused.orderBy(F.desc("score"), row).limit(limit).withColumn("mode", F.lit(mode))
