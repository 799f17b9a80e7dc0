"""Byte-level BPE by prefix dynamic programming, and decoding.

Row i of a text's prefix table is the last token of the encoding of its first i bytes. Such a token
is unique: of all vocabulary tokens that end at i, exactly one follows the encoding of the bytes
before it without BPE merging across the seam. Whether two tokens may stand side by side depends on
those two alone, so a row needs only earlier rows. Appending bytes adds rows; an edit recomputes
rows from the edit on until the table repeats the old one.

The query splits the text by the tokenizer's pattern first and encodes each match separately.

Defined results: null text = empty text = no ids (sha256 of nothing); rows are independent, so
repeated or null ``doc_id`` stay as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import ids_and_texts, memo, table, tidied
from plumbline.llm.tokens import PieceMemo

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PrefixEncoder:
    """Encodes bytes by ``ranks`` (lower rank merges first)."""

    def __init__(self, ranks: dict[bytes, int], pairs_limit: int = 1_000_000):
        self.ranks, self.token = ranks, {r: t for t, r in ranks.items()}
        self.id_bytes = {t: r.to_bytes(4, "little") for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        #: Tokens that merging their own bytes yields; the others never appear inside a match.
        self.usable = {t for t in ranks if self.merged(t) == [t]}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.limit = pairs_limit

    def merged(self, data: bytes) -> list[bytes]:
        """Plain BPE of a few bytes: merge the lowest-ranked adjacent pair until none is left."""
        parts, rank, none = [data[i : i + 1] for i in range(len(data))], self.ranks.get, 1 << 60
        while len(parts) > 1:
            found = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(found)
            if best == none:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: bytes, right: bytes) -> bool:
        """Whether the encoding of the two tokens' bytes is those two tokens."""
        if len(self.fits) >= self.limit:
            self.fits.clear()
        self.fits[left, right] = ok = self.merged(left + right) == [left, right]
        return ok

    def table(self, data: bytes, rows: list[bytes] | None = None) -> list[bytes]:
        """Rows for every prefix of ``data``, continuing from ``rows`` of a prefix of it."""
        rows = [b""] if rows is None else rows
        usable, fits, longest = self.usable, self.fits, self.longest
        for end in range(len(rows), len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = data[start:end]
                if token in usable:
                    if not start:
                        break
                    ok = fits.get((rows[start], token))
                    if ok is None:
                        ok = self._fits(rows[start], token)
                    if ok:
                        break
            else:
                raise ValueError(f"byte {data[end - 1]} has no token")
            rows.append(token)
        return rows

    def edited(self, rows: list[bytes], data: bytes, start: int, stop: int, new: bytes) -> tuple[list[bytes], int]:
        """The table after data[start:stop] became ``new``, and how many rows were recomputed.

        Once as many rows in a row as the longest token has bytes equal the old table's, each
        later one would too, and they are taken over.
        """
        now, after = data[:start] + new + data[stop:], list(rows[: start + 1])
        shift, same = len(now) - len(data), 0
        for end in range(start + 1, len(now) + 1):
            self.table(now[:end], after)
            old = end - shift
            same = same + 1 if old > stop and old < len(rows) and rows[old] == after[-1] else 0
            if same >= self.longest:
                return after + rows[old + 1 :], end - start
        return after, len(now) - start

    def tokens(self, rows: list[bytes]) -> list[bytes]:
        """The encoding, read backwards from the last row."""
        out, at = [], len(rows) - 1
        while at:
            out.append(rows[at])
            at -= len(rows[at])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pattern match. A match that is itself a token is that token, as in tiktoken."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else [self.ranks[t] for t in self.tokens(self.table(data))]

    def encode_all(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Id bytes of distinct matches. In sorted order a word appends to a prefix that it shares
        with the one before, whose rows it takes over."""
        out, last, rows = {}, b"", [b""]
        for word in sorted(words):
            whole = self.id_bytes.get(word)
            if whole is not None:
                out[word] = whole
                continue
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            del rows[same + 1 :]
            rows, last = self.table(word, rows), word
            out[word] = b"".join([self.id_bytes[t] for t in self.tokens(rows)])
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[tuple[str, str], tuple[PrefixEncoder, PieceMemo]] = {}


def codec(ranks_path: str, pattern: str) -> tuple[PrefixEncoder, PieceMemo]:
    """One per Python worker and vocabulary."""
    if (ranks_path, pattern) not in _codecs:
        encoder = PrefixEncoder(load_ranks(ranks_path))
        # White space is the Unicode property, as in the pattern's own regular expression library.
        matches = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

        owner = f"byte bpe {ranks_path}"
        encoder.fits = memo(owner, "fits")  # emptied with the rest when another operator takes the worker over

        def encode(pieces: list[str]) -> list[bytes]:
            parts = [[m.encode("utf-8", "surrogatepass") for m in matches(piece)] for piece in pieces]
            words = memo(owner, "words")
            new = set().union(*parts).difference(words)
            if len(words) + len(new) > 400_000:
                words.clear()
                new = set().union(*parts)
            words.update(encoder.encode_all(new))
            get = words.__getitem__
            return [b"".join(map(get, x)) for x in parts]

        _codecs[ranks_path, pattern] = encoder, PieceMemo(encode, owner, limit=600_000)
    return _codecs[ranks_path, pattern]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes decoded from them; ``keep_ids`` adds
    the ids (little-endian unsigned 32-bit) as ``ids``. A map over the rows: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, memo = codec(ranks_path, pattern)
        for batch in batches:
            n, ids_sha, text_sha, kept = [], [], [], []
            for ids in memo.ids(batch.column("text").to_pylist()):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.record_batch(columns + [pa.array(kept, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    return ids_and_texts(docs).mapInArrow(tidied(run), OUT + ", ids binary" * keep_ids)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
