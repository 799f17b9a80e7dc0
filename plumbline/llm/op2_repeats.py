"""Suffix-array removal of repeated byte strings, keeping the first occurrence of each.

A byte goes if some ``length``-byte string that covers it also starts earlier: in a document with
a smaller id, or further left in the same one. That is where the longest previous factor (LPF) of a
position reaches ``length``.

One suffix array over a corpus would be one task, so the work is cut by content. In every window of
``length`` bytes the smallest hash of a 24-byte gram, the leftmost on ties, is its anchor: a
function of the window's bytes alone, so equal windows have equal anchors. Neighbouring windows
share anchors; about every 35th byte begins a new *span*, the windows of one anchor occurrence.

1. spans (anchor hash, span digest, place) are dealt out by anchor. Of equal spans the first stays
   and the others, whose windows all start earlier in the first, are repeats. What is left are
   different spans. Only where several of them share an anchor can further windows be equal: at the
   edges of repeats and around edits.
2. those spans' bytes are cut from the texts, which meet the list of them in groups of ids, and are
   dealt out by anchor. A group of anchors is taken in parts of whole anchors, each of which gets a
   suffix array (about 110 bytes of memory for each byte), by prefix doubling up to ``length`` bytes
   with ties in text order. The previous and the next smaller position of each
   position in suffix order are its two candidates for an earlier match; the longer common prefix
   with either is its LPF, and a window whose LPF reaches ``length`` is a repeat.
3. the repeats meet their documents, in groups of ids, and are cut out.

Equal spans are told by 96 bits of a digest, so that copies of texts are not carried around; so are
the windows of an anchor that holds more than 1/HOT of all spans, or more than HOT_SPANS of them (a
line that every page carries). Such anchors are found in a sample beforehand; at most HOT and one for
each HOT_SPANS spans can exist. Their spans are dealt out by their own digests in step 1 and their
windows by theirs in step 2, so no task gets them all. The sample decides only where rows go, never
the result. Copies inside a task's own texts are settled before the shuffle.

Defined results: null text = empty text = nothing to remove; ``doc_id`` is a key: rows with the same id
and text are one document, rows with the same id and other texts are cut where either repeats; rows
with a null ``doc_id`` have no place in the order: each comes back whole and repeats nothing; a text of
any length is cut a piece of 4 MB at a time; of equal strings the earliest start is kept, so there are
no ties; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import give_back, ids_and_texts, stored, table, tidied
from plumbline.llm.shingles import mixed

LENGTH, GRAM = 100, 24
TEXT_BYTES = 16 << 20  # bytes of text that a task looks at together, and that a group of ids holds
SPANS, CONTEXT_BYTES = 400_000, 4 << 20  # spans, and span bytes, that a group should hold
SUFFIX_BYTES, PARTS = 1 << 20, 256  # span bytes of a suffix array, unless a part has more; parts of a group
HOT, HOT_SPANS, SAMPLE = 5_000, 1_000_000, 64
PIECE = 4 << 20

_ROWS = "what string, bucket long, h binary, s binary, doc binary, start binary, n binary"
_MARKS = "what string, bucket long, h binary, doc binary, start binary, n binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each position."""
    n, words, step = len(data) - GRAM + 1, data.astype(np.uint64), 1
    while step < 8:
        words = words[:-step] | (words[step:] << np.uint64(8 * step))
        step *= 2
    out = mixed(words[:n])
    for at in range(8, GRAM, 8):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[at : at + n])
    return out


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def spans_of(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of each span, left to right."""
    found = []
    for low in range(0, max(0, len(data) - length + 1), PIECE):  # windows of a long text, a piece at a time
        piece = np.frombuffer(data[low : low + PIECE + length - 1], np.uint8)
        h = gram_hashes(piece)
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        anchor = (_window_minima(key, length - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        found.append((h[anchor[first]], first + low, np.diff(np.r_[first, len(anchor)])))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _digests(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    """96 bits of a digest for each slice, end to end."""
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    return b"".join([digest(view[a:b])[:12] for a, b in zip(starts, ends, strict=True)])


class Spans:
    """Columns of spans: anchor hash, digest (two integers), document, first window, windows."""

    def __init__(self, h, s_hi, s_lo, doc, start, n):
        self.columns = [h, s_hi, s_lo, doc, start, n]

    @classmethod
    def of_texts(cls, docs: list[tuple[int, bytes]]) -> Spans:
        parts, digests = [], []
        for doc, data in docs:
            h, start, n = spans_of(data)
            if len(h):
                parts.append((h, np.full(len(h), doc, np.int64), start, n))
                digests.append(_digests(data, start.tolist(), (start + n + LENGTH - 1).tolist()))
        if not parts:
            return cls(*(np.zeros(0, t) for t in ("u8", "u8", "u8", "i8", "i8", "i8")))
        h, doc, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        return cls(h, *_split(b"".join(digests)), doc, start, n)

    def take(self, at: np.ndarray) -> Spans:
        return Spans(*(c[at] for c in self.columns))

    def __len__(self) -> int:
        return len(self.columns[0])

    def firsts(self) -> tuple[Spans, np.ndarray]:
        """(spans in order of anchor, digest and place, which of them are the first of their digest)."""
        h, hi, lo, doc, start, n = self.columns
        out = self.take(np.lexsort((start, doc, lo, hi, h)))
        h, hi, lo, doc, start, n = out.columns
        if not len(h):
            return out, np.zeros(0, bool)
        same = (h[1:] == h[:-1]) & (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
        once = np.r_[True, ~(same & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]))]  # a repeated row is one place
        return out.take(once), np.r_[True, ~same][once]


def _split(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(digests, np.uint8).reshape(-1, 12)
    wide = np.zeros((len(raw), 16), np.uint8)
    wide[:, :8], wide[:, 8:12] = raw[:, :8], raw[:, 8:]
    return wide[:, :8].copy().view("<u8").ravel(), wide[:, 8:].copy().view("<u8").ravel()


def _joined(hi: np.ndarray, lo: np.ndarray) -> bytes:
    return np.concatenate([hi.astype("<u8").view(np.uint8).reshape(-1, 8), lo.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :4]], axis=1).tobytes()


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its rows in their own order)."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    for low, high in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(bucket[order[low]]), order[low:high]


def _id_group(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _rows(what: str, group: np.ndarray, n_type: str = "<i4", **columns: np.ndarray) -> list[dict]:
    """One row for each group, holding its part of the columns in order of place."""
    rows = []
    for g, at in _by_bucket(group):
        at = at[np.lexsort((columns["start"][at], columns["doc"][at]))]
        rows.append({"what": what, "bucket": g, **{k: v[at].astype({"h": "<u8", "n": n_type}.get(k, "<i8")).tobytes() for k, v in columns.items()}})
    return rows


def _mark_rows(doc: np.ndarray, start: np.ndarray, n: np.ndarray, groups: int) -> list[dict]:
    """Repeated windows by group of ids."""
    return _rows("mark", _id_group(doc, groups), doc=doc, start=start, n=n)


def _groups_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            if len(data) >= LENGTH:
                held.append((doc, data))
                size += len(data)
                if size >= TEXT_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


_SCHEMA = pa.schema([("what", pa.string()), ("bucket", pa.int64()), *((c, pa.binary()) for c in ("h", "s", "doc", "start", "n"))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _columns(table_: pa.Table, *names: str) -> list[np.ndarray]:
    """Packed columns of some rows, end to end."""
    kinds = {"h": "<u8", "n": "<i4"}
    return [np.concatenate([np.zeros(0, kinds.get(c, "<i8")), *(np.frombuffer(x, kinds.get(c, "<i8")) for x in table_[c].to_pylist())]) for c in names]


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors with more than 1/HOT, or HOT_SPANS, of all spans, judged by every SAMPLE-th document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _groups_of_texts(batches):
            h, n = np.unique(np.concatenate([spans_of(data)[0] for _, data in texts]), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    counts = stored(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r["h"] for r in counts.filter(F.col("n") > max(100, min(total / HOT, HOT_SPANS / SAMPLE))).select("h").collect()]
    return np.sort(np.array(hot, np.int64).view(np.uint64))


def _is_in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x if len(ordered) else np.zeros(len(x), bool)


def _settle_spans(hot: np.ndarray, groups: int):
    """Step 1 in one group of anchors: repeats of whole spans, and the spans to look into."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in _MARKS.split(", ")]
        passed = pdf[pdf["what"] == "mark"][columns].to_dict("records")
        pdf = pdf[pdf["what"] == "span"]
        if not len(pdf):
            return pd.DataFrame(passed, columns=columns)
        h, doc, start, n = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("h", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("n", "<i4")))
        spans, first = Spans(h, *_split(b"".join(pdf["s"])), doc, start, n).firsts()
        h, _, _, doc, start, n = spans.columns
        rows = _mark_rows(doc[~first], start[~first], n[~first], groups)
        anchor = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
        several = first & ((np.bincount(anchor, first)[anchor] > 1) | _is_in(h, hot))
        doc, start, n, h = doc[several], start[several], n[several], h[several]
        rows += _rows("open", _id_group(doc, groups), doc=doc, start=start, n=n, h=h)
        give_back()
        return pd.DataFrame(passed + rows, columns=columns)

    return run


def _ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(k, the rank of each position's next k bytes) for k = 8, 16, .. and at last ``length``.

    Ranks of twice the bytes come from pairs of ranks; the last step overlaps to exactly ``length``.
    """
    words = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        words = (words[:-step] << np.uint64(8 * step)) | words[step:]
    known = min(8, length)
    rank = np.unique(words[: len(data)] >> np.uint64(8 * (8 - known)), return_inverse=True)[1].astype(np.int64)
    out = [(known, rank.astype(np.int32))]
    while known < length:
        ahead = min(known, length - known)
        then = np.zeros_like(rank)
        then[:-ahead] = rank[ahead:]
        rank, known = np.unique(rank << 32 | then, return_inverse=True)[1].astype(np.int64), known + ahead
        out.append((known, rank.astype(np.int32)))
    return out


def _smaller_before(x: np.ndarray) -> np.ndarray:
    """For each place of ``x`` the nearest one before it with a smaller value, -1 without one.

    Every place starts from its neighbour and jumps to where that one has got to, until it is smaller.
    """
    found = np.arange(-1, len(x) - 1, dtype=np.int32)
    left = np.flatnonzero(found >= 0)
    left = left[x[found[left]] > x[left]]
    while len(left):
        found[left] = found[found[left]]
        left = left[found[left] >= 0]
        left = left[x[found[left]] > x[left]]
    return found


def _common(data: np.ndarray, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """The common prefix of the suffixes at ``a`` and ``b``, up to ``length`` bytes."""
    out = np.where(ranks[-1][1][a] == ranks[-1][1][b], length, 0)
    open_ = np.flatnonzero(out == 0)
    a, b, known = a[open_], b[open_], np.zeros(len(open_), np.int64)
    last = len(data) - 1
    for k, rank in ranks[-2::-1]:
        known += k * (rank[np.minimum(a + known, last)] == rank[np.minimum(b + known, last)])
    more = np.arange(len(open_))
    for _ in range(min(8, length)):
        same = (known[more] < length) & (data[np.minimum(a[more] + known[more], last)] == data[np.minimum(b[more] + known[more], last)])
        more = more[same]
        known[more] += 1
    out[open_] = np.minimum(known, length - 1)
    return out


def previous_factors(texts: bytes, lengths: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The longest previous factor of each window's start in the concatenated texts, up to ``length``
    bytes; 0 where no window of its own text starts."""
    data, out = np.frombuffer(texts, np.uint8), np.zeros(len(texts), np.int64)
    room = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # bytes to the end of the own text
    windows = np.flatnonzero(room >= length)
    if len(windows):
        ranks = _ranks(data, length)
        order = windows[np.argsort(ranks[-1][1][windows], kind="stable")]
        for at in (_smaller_before(order), len(order) - 1 - _smaller_before(order[::-1])[::-1]):
            has = np.flatnonzero((at >= 0) & (at < len(order)))
            out[order[has]] = np.maximum(out[order[has]], _common(data, ranks, order[has], order[at[has]], length))
    return out


def _look_into(groups: int):
    """Step 2 in one group of anchors (or of window digests, for hot anchors)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = ["what", "bucket", "doc", "start", "n"]
        rows = pdf[pdf["what"] == "mark"][columns].to_dict("records")
        contexts = pdf[pdf["what"] == "context"]
        if len(contexts):
            doc, start, n, part = (np.concatenate([np.frombuffer(x, t) for x in contexts[c]]) for c, t in (("doc", "<i8"), ("start", "<i8"), ("n", "<i4"), ("h", "u1")))
            data, sizes = b"".join(contexts["s"]), (n + LENGTH - 1).astype(np.int64)
            begins = np.cumsum(sizes) - sizes
            order = np.lexsort((start, doc, part))
            once = np.r_[True, (np.diff(part[order]) != 0) | (np.diff(doc[order]) != 0) | (np.diff(start[order]) != 0)]
            order, found = order[once], []
            for low, high in _whole_parts(part[order], sizes[order]):
                some = order[low:high]
                text = b"".join([data[begins[i] : begins[i] + sizes[i]] for i in some.tolist()])
                again = np.flatnonzero(previous_factors(text, sizes[some]) >= LENGTH)
                ends = np.cumsum(sizes[some])
                own = np.searchsorted(ends, again, "right")
                found.append((doc[some][own], start[some][own] + again - (ends - sizes[some])[own]))
            rows += _mark_rows(*_runs(*(np.concatenate(x) for x in zip(*found, strict=True))), groups)
        windows = pdf[pdf["what"] == "window"]
        if len(windows):
            doc, start = (np.concatenate([np.frombuffer(x, "<i8") for x in windows[c]]) for c in ("doc", "start"))
            hi, lo = _split(b"".join(windows["s"]))
            found, first = Spans(np.zeros(len(hi), np.uint64), hi, lo, doc, start, np.ones(len(hi), np.int64)).firsts()
            rows += _mark_rows(*_runs(found.columns[3][~first], found.columns[4][~first]), groups)
        give_back()
        return pd.DataFrame(rows, columns=columns)

    return run


def _whole_parts(part: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of stretches of whole parts, at most SUFFIX_BYTES where no part has more; parts stand in order."""
    low = held = 0
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
    for at, size in zip(cuts, np.add.reduceat(sizes, cuts).tolist(), strict=True):
        if held and held + size > SUFFIX_BYTES:
            yield low, at
            low, held = at, 0
        held += size
    yield low, len(part)


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single windows as runs (doc, start, windows)."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
    return doc[cuts], at[cuts], np.diff(np.r_[cuts, len(at)])


def find_repeats(docs: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(rows of repeated windows by group of ids, number of groups) for (doc_id, text)."""
    spark, docs = docs.sparkSession, docs.filter("doc_id is not null")
    groups = max(1, -(-size // TEXT_BYTES))
    buckets, wide = max(1, size // 35 // SPANS), max(1, size // CONTEXT_BYTES // 2)
    hot = hot_anchors(docs)
    sent_hot = spark.sparkContext.broadcast(hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _groups_of_texts(batches):
            spans, first = Spans.of_texts(texts).firsts()
            _, _, _, doc, start, n = spans.take(~first).columns
            rows = _mark_rows(doc, start, n, groups)
            spans = spans.take(first)
            spans = spans.take(np.lexsort((spans.columns[4], spans.columns[3])))  # places in order compress well
            h, hi, lo, doc, start, n = spans.columns
            key = np.where(_is_in(h, sent_hot.value), mixed(h + hi), h)
            for b, at in _by_bucket((mixed(key) % np.uint64(buckets)).astype(np.int64)):
                rows.append({"what": "span", "bucket": b, "h": h[at].astype("<u8").tobytes(), "s": _joined(hi[at], lo[at]), "doc": doc[at].astype("<i8").tobytes(), "start": start[at].astype("<i8").tobytes(), "n": n[at].astype("<i4").tobytes()})
            yield _batch(rows)

    settled = stored(docs.mapInArrow(tidied(deal), _ROWS).groupBy(F.col("bucket"), F.col("what")).applyInPandas(_settle_spans(hot, groups), _MARKS), "repeats")

    def cut_out(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        """The bytes of a group's spans to look into, dealt out by anchor."""
        doc, start, n, h = _columns(wanted, "doc", "start", "n", "h")
        order = np.argsort(doc, kind="stable")
        doc, start, n, h = doc[order], start[order], n[order], h[order]
        at, slices = [], []
        for own, text in zip(texts["doc_id"].to_pylist(), texts["text"], strict=True):
            low, high = np.searchsorted(doc, own), np.searchsorted(doc, own, "right")
            if low < high:
                data = text.as_py().encode("utf-8", "surrogatepass")
                for i, a, m in zip(range(low, high), start[low:high].tolist(), n[low:high].tolist(), strict=True):
                    if a + m + LENGTH - 1 <= len(data):  # else the place is in another text of this id
                        at.append(i)
                        slices.append(data[a : a + m + LENGTH - 1])
        at = np.array(at, np.int64)
        doc, start, n, h = doc[at], start[at], n[at], h[at]
        is_hot, rows = _is_in(h, sent_hot.value), []
        cold, spot = np.flatnonzero(~is_hot), mixed(h)
        part = (spot // np.uint64(wide) % np.uint64(PARTS)).astype(np.uint8)  # an anchor's spans are in one part
        for b, at in _by_bucket((spot[cold] % np.uint64(wide)).astype(np.int64)):
            at = cold[at]
            rows.append({"what": "context", "bucket": b, "h": part[at].tobytes(), "s": b"".join([slices[i] for i in at.tolist()]), "doc": doc[at].astype("<i8").tobytes(), "start": start[at].astype("<i8").tobytes(), "n": n[at].astype("<i4").tobytes()})
        rows += _hot_windows([(doc[i], start[i], slices[i]) for i in np.flatnonzero(is_hot).tolist()], wide, groups)
        del slices, texts
        give_back()
        return pa.Table.from_pylist(rows, schema=_SCHEMA)

    wanted = settled.filter("what = 'open'").groupBy("bucket")
    spans = grouped(docs, groups).groupBy("bucket").cogroup(wanted).applyInArrow(cut_out, _ROWS)
    more = spans.groupBy(F.col("bucket"), F.col("what")).applyInPandas(_look_into(groups), "what string, bucket long, doc binary, start binary, n binary")
    return settled.filter("what = 'mark'").drop("h").unionByName(more), groups


def grouped(docs: DataFrame, groups: int) -> DataFrame:
    """doc_id, text, bucket: the document's group of ids; rows without an id are dealt out by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            spread = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 if i is None else i for i, t in zip(ids, batch.column("text").to_pylist(), strict=True)] if batch.column("doc_id").null_count else ids
            yield pa.record_batch([batch.column("doc_id"), batch.column("text"), pa.array(_id_group(np.array(spread, np.int64), groups))], names=["doc_id", "text", "bucket"])

    return docs.mapInArrow(tidied(run), "doc_id long, text string, bucket long")


def _hot_windows(spans: list[tuple[int, int, bytes]], wide: int, groups: int) -> list[dict]:
    """Windows of hot anchors' spans by digest; repeats among them are settled here."""
    if not spans:
        return []
    counts = np.array([len(s) - LENGTH + 1 for _, _, s in spans])
    digests = b"".join([_digests(s, list(range(c)), list(range(LENGTH, LENGTH + c))) for (_, _, s), c in zip(spans, counts.tolist(), strict=True)])
    doc = np.repeat([d for d, _, _ in spans], counts).astype(np.int64)
    start = np.concatenate([np.arange(a, a + c) for (_, a, _), c in zip(spans, counts.tolist(), strict=True)])
    found, first = Spans(np.zeros(len(doc), np.uint64), *_split(digests), doc, start, np.ones(len(doc), np.int64)).firsts()
    _, hi, lo, doc, start, _ = found.columns
    rows = _mark_rows(*_runs(doc[~first], start[~first]), groups)
    hi, lo, doc, start = hi[first], lo[first], doc[first], start[first]
    for b, at in _by_bucket((mixed(hi) % np.uint64(wide)).astype(np.int64)):
        rows.append({"what": "window", "bucket": b, "s": _joined(hi[at], lo[at]), "doc": doc[at].astype("<i8").tobytes(), "start": start[at].astype("<i8").tobytes(), "n": b""})
    return rows


def merged(start: np.ndarray, n: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Runs of windows as maximal byte runs (start, end)."""
    out: list[tuple[int, int]] = []
    for a, m in sorted(zip(start.tolist(), n.tolist(), strict=True)):
        end = a + m + length - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((a, end))
    return out


def without_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes that stay)."""
    docs = ids_and_texts(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks, groups = find_repeats(docs, size)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * keep_bytes]

    def cut(texts: pa.Table, marks: pa.Table) -> pa.Table:
        ids, starts, ns = _columns(marks, "doc", "start", "n")
        order = np.argsort(ids, kind="stable")
        ids, starts, ns = ids[order], starts[order], ns[order]
        rows, seen = [], set()
        for doc, text in zip(texts["doc_id"].to_pylist(), texts["text"], strict=True):
            text = text.as_py()
            data, runs = text.encode("utf-8", "surrogatepass"), []
            if doc is not None:
                if (doc, text) in seen:
                    continue
                seen.add((doc, text))
                low, high = np.searchsorted(ids, doc), np.searchsorted(ids, doc, "right")
                runs = merged(starts[low:high], ns[low:high])
            parts, at = [], 0
            for a, b in runs:
                parts.append(data[at:a])
                at = b
            kept = b"".join([*parts, data[at:]])
            rows.append((doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), *[kept] * keep_bytes))
        give_back()
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return grouped(docs, groups).groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(cut, schema)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
