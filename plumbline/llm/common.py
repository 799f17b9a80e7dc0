"""Helpers shared by the corpus operators: tables, the shared folder, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import attach

#: A-Z to a-z on bytes; everything else stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path below the cluster's shared folder, ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder (tests); a cluster must have it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost
    executor costs a re-read instead of a re-run."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every text operator reads, a null text as the empty one."""
    attach(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


_PROBES = 6


def key_filter(keys: DataFrame, key: str, n: int) -> np.ndarray:
    """A Bloom filter over ``n`` distinct long keys (hashes), 16 bits for each: 1 in 1,000 others pass."""
    bits = 64 * max(1, n // 4)
    low, high = F.col(key).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(key, 32).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*[(low + high * i) % F.lit(bits) for i in range(_PROBES)]))
    words = keys.select(at.alias("at")).selectExpr("at div 64 AS word", "shiftleft(1L, CAST(at % 64 AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the filter may hold the keys (it always does where it was given them)."""
    keys, left, n = keys.astype(np.uint64), np.arange(len(keys)), np.uint64(len(bits) * 8)
    for i in range(_PROBES):
        own = keys[left]
        at = (((own & np.uint64(0xFFFFFFFF)) + ((own >> np.uint64(32)) | np.uint64(1)) * np.uint64(i)) % n).astype(np.int64)
        left = left[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(keys), bool)
    out[left] = True
    return out


def joined(rows: DataFrame, facts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` inner-joined with ``facts``, which has one row per key and the number ``n`` of its rows.

    Keys with more than 1,000 rows and 1/1000 of all (at most 1,000 keys) are broadcast, so that the
    rows of a hot key stay where they are and meet in no task.
    """
    total, most = facts.agg(F.sum(n), F.max(n)).first()
    least = max(1_000, (total or 0) // 1_000)
    if (most or 0) <= least:
        return rows.join(facts, key)
    hot = F.broadcast(facts.filter(F.col(n) > least))
    cold = rows.join(hot.select(key), key, "left_anti").join(facts.filter(F.col(n) <= least), key)
    return cold.unionByName(rows.join(hot, key))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds fewer texts as objects at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def lower_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def give_back() -> None:
    """Hand this process's freed memory back to the system: workers outlive tasks and stand idle beside later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a task's map over batches, and ``give_back`` when it ends."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


_memos: dict[tuple[str, str], dict] = {}


def memo(owner: str, what: str = "") -> dict:
    """A dict of this Python worker for ``owner``; those of other owners are emptied.

    Workers outlive tasks and stages; what one operator remembers must not stay beside the next.
    """
    for (other, _), held in _memos.items():
        if other != owner:
            held.clear()
    return _memos.setdefault((owner, what), {})
