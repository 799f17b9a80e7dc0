"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes.

A text, with a space before it, is cut by a byte-level BPE (A) and by a piece model (B). Tokens of A and
B whose byte ranges overlap are joined in a bipartite graph; union-find over its edges gives the
connected components, which are the smallest groups of tokens that cover the same bytes. A component's
members are expanded into links, the pairs of an A and a B token that end at the same byte. Links are
counted by id pair over all documents, and each document is rated by the counts of its links.

1. a map cuts and aligns the texts. No token of either kind holds a space behind another letter, so a
   text falls into pieces before its spaces, each piece is cut and aligned once while a worker
   remembers it, and a text's groups are those of its pieces in a row. A document's distinct pairs and
   their numbers are written to the shared folder;
2. pairs are counted with partial sums before the shuffle;
3. a second map rates the written rows. The counts are broadcast: of two tokens that end together one
   is a suffix of the other, so two vocabularies have a fixed number of pairs (``most_pairs``, counted
   before), whatever the corpus.

Defined results: null and empty texts have no tokens, nor have texts whose tokens do not give the text's
own bytes back (zeros, an empty digest); strings of special tokens are plain text; a very long text is
cut piece by piece, and one without spaces is one piece, aligned in time proportional to its length;
repeated rows and rows that share a ``doc_id`` or have none are documents of their own, and all count;
of pairs with the same count all are best; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ids_and_texts, memo, sliced, stored, table

_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>"
_RATED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_CUT = re.compile(r"(?<=\S)(?= )")
_UNEVEN = re.compile(r"\s ")
#: Pieces that a worker remembers, the letters of the longest of them, and pieces that are aligned together.
PIECES, LETTERS, TOGETHER = 350_000, 64, 5_000


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokens_a, letters = Tokenizer.from_file(a_path), byte_of_letter()
        self.tokens_a.encode_special_tokens = True
        self.pieces_b = b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        vocabulary = self.tokens_a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in range(b.get_piece_size()) for p in [b.id_to_piece(i)]]
        self.space_b = b.piece_to_id("▁")
        #: Lengths of the tokens, whether they begin with a space, and an id's text behind each of the marks of its side.
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b)]
        self.begins = [np.array([x[:1] == b" " for x in side]) for side in (self.bytes_a, self.bytes_b)]
        self.told = [f"{mark}{i}" for marks, side in ((("", ";", ","), self.bytes_a), (("|", ","), self.bytes_b)) for mark in marks for i in range(len(side))]

    def _one_by_one(self, pieces: list[str]) -> list[list[list[int]]]:
        """The ids of each piece, by A and by B; B sets a space before a text, so it gets the rest only."""
        a = [e.ids for e in self.tokens_a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = self.pieces_b.encode([p[1:] for p in pieces], num_threads=1)
        return [a, [[self.space_b] if p == " " else ids for p, ids in zip(pieces, b, strict=True)]]

    def encode(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids of all pieces, numbers of ids of each piece), each by A and by B.

        Pieces of one space, at their start, are encoded as one text and cut where a token begins with one.
        """
        if len(pieces) > 1 and all(p[:1] == " " and p.count(" ") == 1 and len(p) > 1 and not p[1].isspace() for p in pieces):
            whole = "".join(pieces)
            ids = [np.array(x, np.int64) for x in (self.tokens_a.encode_batch_fast([whole], add_special_tokens=False)[0].ids, self.pieces_b.encode(whole[1:], num_threads=1))]
            starts = [np.flatnonzero(begins[x]) for begins, x in zip(self.begins, ids, strict=True)]
            if all(len(x) == len(pieces) for x in starts):
                return ids, [np.diff(x, append=len(i)) for x, i in zip(starts, ids, strict=True)]
        lists = self._one_by_one(pieces)
        return [np.array([i for x in side for i in x], np.int64) for side in lists], [np.array(list(map(len, side)), np.int64) for side in lists]

    def most_pairs(self) -> int:
        """The pairs of an A and a B token of which one is a suffix of the other: no corpus links more."""
        a, b = Counter(self.bytes_a), Counter(self.bytes_b)
        within = lambda one, other, first: sum(n * sum(other[x[i:]] for i in range(first, len(x))) for x, n in one.items())
        return within(a, b, 0) + within(b, a, 1)


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The connected component of each A and each B token in the graph of overlapping tokens, named by its first A token.

    ``ends_*``: where each token ends, ascending; both lists end at the same byte. Between two ends in a row
    lies one token of each side: an edge. Union-find over all edges at once: roots are hooked to the
    smaller root that an edge shows them, paths are halved until they are flat, and so on until no edge
    joins two roots.
    """
    ends = np.union1d(ends_a, ends_b)
    left, right = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends) + len(ends_a)
    parent = np.arange(len(ends_a) + len(ends_b))
    while True:
        one, other = parent[left], parent[right]
        low, high = np.minimum(one, other), np.maximum(one, other)
        apart = low != high
        if not apart.any():
            return parent[: len(ends_a)], parent[len(ends_a) :]
        np.minimum.at(parent, high[apart], low[apart])
        while not np.array_equal(flat := parent[parent], parent):
            parent = flat


#: Of a piece or text: groups as text, numbers of A tokens, B tokens, groups and links, id pairs of the links.
Aligned = tuple[str, int, int, int, int, bytes]


def aligned(pieces: list[str], words: Vocabularies) -> list[Aligned | None]:
    """The alignment of each piece; None where its tokens do not give its bytes back."""
    data = [p.encode("utf-8", "surrogatepass") for p in pieces]
    ids, counts = words.encode(pieces)
    good = np.ones(len(pieces), bool)
    for side, parts in enumerate((words.bytes_a, words.bytes_b)):
        joined = [parts[i] for i in ids[side].tolist()]
        cuts = np.cumsum([0, *counts[side]]).tolist()
        whole = b"".join(joined)
        if whole != b"".join(data) or not np.array_equal(np.diff(np.cumsum([0, *words.sizes[side][ids[side]]])[cuts]), list(map(len, data))):
            good &= [b"".join(joined[low:high]) == d for low, high, d in zip(cuts, cuts[1:], data, strict=False)]
    kept = [x[np.repeat(good, n)] for x, n in zip(ids, counts, strict=True)]
    counts = [n[good] for n in counts]
    ends = [np.cumsum(size[x]) for size, x in zip(words.sizes, kept, strict=True)]
    of_a, of_b = components(*ends)
    piece = [np.repeat(np.arange(len(n)), n) for n in counts]
    # A component's members by end: those of both sides that end together are links.
    _, link_a, link_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
    linked = of_a[link_a] == of_b[link_b]
    link_a, link_b = link_a[linked], link_b[linked]
    pairs = kept[0][link_a] << 32 | kept[1][link_b]
    # Members in the order of their components, A before B, each told behind its mark.
    heads = np.flatnonzero(of_a == np.arange(len(of_a)))
    first_a, first_b = np.zeros(len(of_a), bool), np.r_[True, of_b[1:] != of_b[:-1]][: len(of_b)]
    first_a[heads] = True
    opens = np.r_[True, piece[0][1:] != piece[0][:-1]][: len(of_a)]
    n_a, n_b = map(len, words.sizes)
    mark_a = np.where(opens, 0, np.where(first_a, 1, 2)) * n_a + kept[0]
    mark_b = 3 * n_a + np.where(first_b, 0, 1) * n_b + kept[1]
    order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
    told = list(map(words.told.__getitem__, np.concatenate([mark_a, mark_b])[order].tolist()))
    every = np.arange(len(counts[0]))
    cuts = [np.cumsum([0, *counts[0] + counts[1]]), np.searchsorted(piece[0][link_a], [*every, len(every)])]
    groups = np.bincount(piece[0][heads], minlength=len(every))
    texts, links = cuts[0].tolist(), cuts[1].tolist()
    found = ((f"{''.join(told[texts[i] : texts[i + 1]])}", a, b, g, links[i + 1] - links[i], pairs[links[i] : links[i + 1]].tobytes()) for i, (a, b, g) in enumerate(zip(counts[0].tolist(), counts[1].tolist(), groups.tolist(), strict=True)))
    return [next(found) if ok else None for ok in good.tolist()]


def pieces_of(text: str) -> list[str]:
    """``text``, which begins with a space, cut before each space that follows no white space."""
    if "  " in text or _UNEVEN.search(text):
        return _CUT.split(text)
    return [" " + word for word in text[1:].split(" ")]


class Aligner:
    """Aligns texts piece by piece; remembers at most ``PIECES`` short pieces."""

    def __init__(self, words: Vocabularies, owner: str):
        self.words, self.owner = words, owner

    def _new(self, pieces: list[str]) -> Iterator[tuple[str, Aligned | None]]:
        """Plain pieces together, the others in smaller lots."""
        odd = [p for p in pieces if p.count(" ") != 1 or len(p) < 2 or p[1].isspace()]
        rest = set(odd)
        plain = [p for p in pieces if p not in rest] if odd else pieces
        for lot in (plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)):
            yield from zip(lot, aligned(lot, self.words), strict=True)
        for lot in (odd[i : i + TOGETHER] for i in range(0, len(odd), TOGETHER)):
            yield from zip(lot, aligned(lot, self.words), strict=True)

    def texts(self, texts: list[str]) -> Iterator[Aligned | None]:
        known = memo(self.owner, "pieces")
        cut = [pieces_of(" " + t) if t else [] for t in texts]
        once: dict[str, Aligned | None] = {}
        for piece, found in self._new(list(set().union(*cut).difference(known))):
            (known if len(piece) <= LETTERS else once)[piece] = found
        for text, pieces in zip(texts, cut, strict=True):
            found = [known[p] if p in known else once[p] for p in pieces] if once else [known[p] for p in pieces]
            if not found:
                yield None
            elif None in found:  # judged as a whole: what one piece lacks another may have
                yield aligned([" " + text], self.words)[0]
            else:
                told, n_a, n_b, groups, links, pairs = zip(*found, strict=True)
                yield ";".join(told), sum(n_a), sum(n_b), sum(groups), sum(links), b"".join(pairs)
        if len(known) > PIECES:
            known.clear()


_vocabularies: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One for each Python worker and pair of files."""
    if (a_path, b_path) not in _vocabularies:
        _vocabularies[a_path, b_path] = Vocabularies(a_path, b_path)
    return _vocabularies[a_path, b_path]


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: its counts, the digest of its groups, its distinct id pairs (a, b) and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabularies(a_path, b_path), "alignment")
        for batch in sliced(batches, 200):
            rows, pairs = [], []
            for x in aligner.texts(batch.column("text").to_pylist()):
                told, *counts, codes = x or ("", 0, 0, 0, 0, b"")
                rows.append((*counts, hashlib.sha256(told.encode()).hexdigest() if x else ""))
                pairs.append(np.unique(np.frombuffer(codes, np.int64), return_counts=True))
            cuts = pa.array(np.cumsum([0, *(len(p) for p, _ in pairs)]), pa.int32())
            code, n = (np.concatenate([p[i] for p in pairs] or [np.zeros(0, np.int64)]) for i in (0, 1))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (code >> 32, code & 0xFFFFFFFF, n)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((*[pa.int64()] * 4, pa.string()))]
            yield pa.record_batch([batch.column("doc_id"), *columns, *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n"])

    return ids_and_texts(docs).mapInArrow(run, _ALIGNED)


def pair_counts(aligned_docs: DataFrame) -> DataFrame:
    """a, b, n: how many links of all documents hold the two ids."""
    links = aligned_docs.select(F.explode(F.arrays_zip("a", "b", "n")).alias("x"))
    return links.groupBy("x.a", "x.b").agg(F.sum("x.n").alias("n"))


def rated(aligned_docs: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """Each document's links by the corpus-wide counts of their pairs; ``counts`` has at most ``most`` rows."""
    spark, own = aligned_docs.sparkSession, counts.limit(most + 1).toArrow()
    if own.num_rows > most:
        raise ValueError("more pairs than the vocabularies can have: the counts are of other tokenizers")
    a, b, n = (own.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
    order = np.lexsort((b, a))
    best = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(best, b, n)
    sent = spark.sparkContext.broadcast((a[order] << 32 | b[order], n[order], (n == best[b])[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counted, top = sent.value
        for batch in sliced(batches):
            a, b, own = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b", "n"))
            at = np.searchsorted(codes, a << 32 | b)
            edges = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("a")).to_numpy(zero_copy_only=False))]).astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)])[edges] for x in (own * top[at], own * counted[at])]
            best_of, sum_of = (pa.array(np.diff(x), pa.int64()) for x in sums)
            kept = {c: batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            yield pa.record_batch([*list(kept.values())[:5], best_of, sum_of, kept["groups_sha256"]], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return aligned_docs.mapInArrow(run, _RATED)


def align(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their ratings, counts of id pairs)."""
    own = stored(alignments(docs, a_path, b_path), "alignment")
    counts = stored(pair_counts(own), "pairs")
    return rated(own, counts, vocabularies(a_path, b_path).most_pairs()), counts


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
