"""Token-ID output: Arrow files of fixed-size-list batches, written and read as Spark jobs.

A file holds one key range of documents: their ids (each document closed by the end id) run on
through sequences of equal length, stored as a ``fixed_size_list`` column ``ids`` beside ``used``, how many
ids of a sequence are no padding. The record batches are plain buffers, so a memory-mapped reader gets
sequence i without copying. Its mask (1, and 0 on padding; a byte each) is a view of the file's one row
of ones and zeros, a ``fixed_size_list`` of twice the length in a file of its own: a batch holds sequences
of one use only, the padded last sequence is a batch by itself. A second Arrow file beside it lists each document's place.
The manifest (one row per file) is a Parquet table that Spark commits: files of failed or
speculative attempts are never in it.

Defined results: the ids are the library's own with ``add_special_tokens=False``, so a text that holds
an added token's string (``<|endoftext|>``) gets that token's id there; null text = empty text = the
end id alone; a very long text runs on through as many sequences as it needs; a null ``doc_id`` sorts
first; rows
that share a ``doc_id`` are separate documents ordered by text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ids_and_texts, shared_dir, table
from plumbline.llm.tokens import PieceMemo

MANIFEST = "part int, path string, n_docs long, n_tokens long, n_sequences long"
_memos: dict[str, PieceMemo] = {}


def _memo(tokenizer_path: str) -> PieceMemo:
    """One per Python worker and vocabulary; a worker runs many tasks."""
    if tokenizer_path not in _memos:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path)
        vocabulary = tok.get_vocab()
        begins = np.zeros(max(vocabulary.values()) + 1, bool)
        begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # tokens with a leading space

        def one_by_one(pieces: list[str]) -> list[bytes]:
            return [np.asarray(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch_fast(pieces, add_special_tokens=False)]

        def run_on(pieces: list[str]) -> list[bytes]:
            """Pieces of one space, at their start, encoded as one text and cut where it shows."""
            ids = np.asarray(tok.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = (np.flatnonzero(begins[ids]) * 4).tolist()
            if len(starts) != len(pieces):
                return one_by_one(pieces)
            data = ids.tobytes()
            return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]

        def encode(pieces: list[str]) -> list[bytes]:
            plain = [p[:1] == " " and p.count(" ") == 1 and len(p) > 1 and not p[1].isspace() for p in pieces]
            out, rest = list(compress(pieces, plain)), [p for p, simple in zip(pieces, plain, strict=True) if not simple]
            ids = [x for low in range(0, len(out), 5_000) for x in run_on(out[low : low + 5_000])]
            simple, others = iter(ids), iter(one_by_one(rest))
            return [next(simple) if p else next(others) for p in plain]

        _memos[tokenizer_path] = PieceMemo(encode, f"token files {tokenizer_path}", limit=1_700_000, apart=[t.content for t in tok.get_added_tokens_decoder().values()])
    return _memos[tokenizer_path]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _id_type(vocab_size: int) -> tuple[pa.DataType, str]:
    return (pa.uint16(), "<u2") if vocab_size <= 1 << 16 else (pa.uint32(), "<u4")


class _SequenceWriter:
    """Fills fixed-length sequences and writes them in batches; holds one batch at most."""

    def __init__(self, sink, length: int, vocab_size: int, per_batch: int = 256):
        self.kind, self.np_kind = _id_type(vocab_size)
        self.length, self.room, self.pending, self.held = length, length * per_batch, [], 0
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("used", pa.int32())])
        self.out, self.sequences = pa.ipc.new_file(sink, self.schema), 0

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids.astype(self.np_kind))
        self.held += len(ids)
        if self.held >= self.room:
            flat = np.concatenate(self.pending)
            whole = len(flat) // self.room * self.room
            for at in range(0, whole, self.room):
                self._write(flat[at : at + self.room], self.length)
            self.pending, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, used: int) -> None:
        """Whole sequences, of which each has ``used`` ids."""
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length)
        self.out.write_batch(pa.record_batch([ids, pa.array(np.full(len(ids), used, np.int32))], schema=self.schema))
        self.sequences += len(ids)

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.pending)
            whole = len(flat) // self.length * self.length
            if whole:
                self._write(flat[:whole], self.length)
            if whole < len(flat):
                self._write(np.pad(flat[whole:], (0, self.length - len(flat) + whole)), len(flat) - whole)
        self.out.close()


def _write_masks(sink, length: int) -> None:
    """One row of ``length`` ones and as many zeros: the mask of n used ids begins ``length - n`` in."""
    row = pa.FixedSizeListArray.from_arrays(pa.array(np.repeat(np.array([1, 0], np.uint8), length)), 2 * length)
    batch = pa.record_batch([row], names=["mask"])
    with pa.ipc.new_file(sink, batch.schema) as out:
        out.write_batch(batch)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, length: int = 2048, vocab_size: int = 50_257) -> DataFrame:
    """Write ``docs`` below ``path`` in ascending ``doc_id`` order; return the manifest."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part = _memo(tokenizer_path), TaskContext.get().partitionId()
        fs, root = _filesystem(path)
        writer, index, at, name, sink = None, [], 0, "", None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if not texts:
                continue
            if writer is None:
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/{name}.arrow")
                writer = _SequenceWriter(sink, length, vocab_size)
            counts = np.empty(len(texts), dtype="<i8")
            for i, found in enumerate(memo.ids(texts)):
                ids = np.frombuffer(found + end_id.to_bytes(4, "little"), dtype="<u4")
                writer.add(ids)
                counts[i] = len(ids)
            starts = at + np.cumsum(counts) - counts
            index.append(pa.record_batch([batch.column("doc_id"), pa.array(starts), pa.array(counts)], names=["doc_id", "start", "n_tokens"]))
            at += int(counts.sum())
        if writer is not None:
            writer.close()
            sink.close()
            with fs.open_output_stream(f"{root}/{name}.mask.arrow") as side:
                _write_masks(side, length)
            with fs.open_output_stream(f"{root}/{name}.docs.arrow") as side, pa.ipc.new_file(side, index[0].schema) as out:
                for x in index:
                    out.write_batch(x)
            row = [[part], [name], [sum(map(len, index))], [at], [writer.sequences]]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "path", "n_docs", "n_tokens", "n_sequences"])

    ordered = ids_and_texts(docs).repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def open_sequences(path: str, name: str) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """(ids by sequence, mask by sequence, document index) of one file; ids and masks are views of the map."""
    fs, root = _filesystem(path)
    opened = lambda kind: pa.ipc.open_file(pa.memory_map(f"{root}/{name}{kind}") if fs.type_name == "local" else fs.open_input_file(f"{root}/{name}{kind}"))
    reader, ruler = opened(".arrow"), opened(".mask.arrow").get_batch(0).column("mask").flatten().to_numpy(zero_copy_only=True)
    ids, masks = [], []
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        length = batch.schema.field("ids").type.list_size
        ids.append(batch.column("ids").flatten().to_numpy(zero_copy_only=True).reshape(-1, length))
        begin = length - batch.column("used")[0].as_py()
        masks.append(np.broadcast_to(ruler[begin : begin + length], ids[-1].shape))
    with fs.open_input_file(f"{root}/{name}.docs.arrow") as f:
        docs = pa.ipc.open_file(f).read_all()
    return ids, masks, docs


def _document_ids(batches: list[np.ndarray], starts: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """Each document's ids, gathered from the batches it spans."""
    flat = [x.reshape(-1) for x in batches]
    edges = np.cumsum([0, *map(len, flat)])
    for start, n in zip(starts, counts, strict=True):
        first, got = int(np.searchsorted(edges, start, "right")) - 1, []
        at, end = int(start), int(start + n)
        while at < end:
            stop = min(end, int(edges[first + 1]))
            got.append(flat[first][at - edges[first] : stop - edges[first]])
            at, first = stop, first + 1
        yield got[0] if len(got) == 1 else np.concatenate(got)


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document from the written files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all earlier documents, over all files. Only the manifest (a row
    per file) is ordered in one task.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, docs = open_sequences(path, row["path"])
                starts, counts = docs["start"].to_numpy(), docs["n_tokens"].to_numpy()
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in _document_ids(ids, starts, counts)]
                yield pa.record_batch([docs["doc_id"].combine_chunks(), pa.array(starts + row["before"], pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.withColumn("before", before).select("path", "before")
    return files.repartition(max(1, min(manifest.count(), 10_000))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest, path)
