"""Operators 11, 12 and 13 against plain versions, on real and odd rows, and by their other ways."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import op11_lines as op11
from plumbline.llm import op12_negatives as op12
from plumbline.llm import op13_align as op13
from plumbline.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import SF, documents, odd_rows, real_documents

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain_lines(rows, least=40, documents=5):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def key(line):
        return line.strip(" \t\n\v\f\r").translate(str.maketrans(upper, lower))

    held = defaultdict(list)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least:
                held[k].append(doc)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in held.items() if len(v) >= documents}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(key(x)) is None or last[key(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got_lines(df):
    out = df.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256) if "text" in df.columns else "kept_sha256")
    return sorted(map(tuple, out.collect()), key=str)


def line_rows():
    rng = random.Random(5)
    long = [f"A line that Stands in many Places, number {i} é" for i in range(30)]
    spaces = [" ", "\t", "", "\r", "  \v", "\f "]
    rows = []
    for d in range(60):
        lines = [rng.choice(spaces) + rng.choice([str.upper, str.lower, str])(rng.choice(long)) + rng.choice(spaces) for _ in range(rng.randrange(9))] + ["short"] * 3
        rng.shuffle(lines)
        rows.append((d, "\n".join(lines)))
    hot = "this very common line stands in a third of all documents"
    rows += [(100 + i, f"{hot}\n{i}\n {hot} ") for i in range(40)]
    rows += [(None, hot)] * 3 + [(None, "only documents without an id hold this line, all five of them")] * 6
    rows += [(200 + i, "x" * 39 + "\n" + "é" * 39 + "\n" + "é" * 40 + "\n" + " " + "y" * 40) for i in range(5)]
    return rows + [(300 + i, "z" * 200_000 + "\nother") for i in range(6)] + [(7, None), (8, ""), (400, hot), (400, hot), (400, hot + "\n")] + odd_rows()


def test_lines_query(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({ORACLE_SQL['op11_lines']})").fetchall(), key=str)
    rows = [(r["doc_id"], r["text"]) for r in real_documents(spark).collect()]
    assert got_lines(QUERIES["op11_lines"](spark, SF)) == want == plain_lines(rows)
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize("way", ["filters", "no filter", "joins"])
def test_lines_odd_rows(spark, monkeypatch, way):
    if way == "no filter":
        monkeypatch.setattr(op11, "FILTER_BYTES", -1)
    if way == "joins":
        monkeypatch.setattr(op11, "CONFIRMED", 0)
    monkeypatch.setattr(op11, "_HELD", 100)
    monkeypatch.setattr(op11, "_HELD_BYTES", 2_000)
    rows = line_rows()
    assert got_lines(op11.without_repeated_lines(documents(spark, rows).repartition(5))) == plain_lines(rows)
    assert op11.without_repeated_lines(documents(spark, [])).count() == 0


def test_lines_filters_hold_repeats_and_little_else():
    rng = np.random.default_rng(2)
    hashes = np.unique(rng.integers(0, 1 << 63, 30_000).astype(np.uint64))
    shard = op11.Shard(1 << 19)
    shard.add(hashes, np.zeros(len(hashes), bool))
    repeated = hashes[::10]
    for _ in range(3):
        shard.add(repeated, np.zeros(len(repeated), bool))
    assert len(repeated) <= shard.entries <= 1.1 * len(repeated)
    bits = op11.folded(shard.twice, shard.entries)
    assert len(bits) < len(shard.twice)
    import pyarrow as pa

    twice = op11.TwiceSeen(pa.table({"shard": [0], "bits": [np.packbits(bits, bitorder="little").tobytes()]}), 1)
    assert twice.holds(repeated).all()
    others = np.setdiff1d(hashes, repeated)
    assert twice.holds(others).mean() < 0.02


def plain_negatives(rows, positives=5, negatives=5):
    out = set()
    for a, label, v in set(rows):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a and len(w) == len(v))
        best = [(i, -s) for s, i, other in scored if other == label][:positives]
        for p, score in best:
            found = [(i, -s) for s, i, other in scored if other != label and 80 * score <= -100 * s <= 100 * score][:negatives]
            out |= {(a, p, k, i, score, s) for k, (i, s) in enumerate(found, 1)}
    return sorted(out)


def got_negatives(df):
    return sorted({tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()})


def test_negatives_query(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({ORACLE_SQL['op12_negatives']})").fetchall()
    got = QUERIES["op12_negatives"](spark, SF)
    assert got_negatives(got) == sorted(want) and got.count() == len(want) > 0


@pytest.mark.parametrize(("queries", "pivots"), [(4_096, 64), (3, 4)])
def test_negatives_ties_clusters_and_odd_rows(spark, monkeypatch, queries, pivots):
    monkeypatch.setattr(op12, "QUERIES", queries)
    monkeypatch.setattr(op12, "PIVOTS", pivots)
    rng = np.random.default_rng(8)
    centres = rng.integers(-40, 41, (6, 5))
    rows = [(i, int(rng.integers(0, 3)), tuple(int(x) for x in centres[i % 6] + rng.integers(-4, 5, 5))) for i in range(900)]
    rows += [(1_000 + i, i % 4, (9, 9, 9, 9, 9)) for i in range(300)]  # one common vector
    rows += [(100, 1, (5, 4, 3, 2, 1)), (100, 1, (1, 2, 3, 4, 5)), (3_000, 2, (1, 2)), (3_001, 2, (2, 1)), (3_002, 1, (2, 2)), (3_100, 0, (0, 0, 0, 0, 0))]
    rows += [(-200, 1, (-9, 3, 3, 3, 9)), (5_000, 7, (8, 8, 8, 8, 8))]
    df = spark.createDataFrame([(*r[:2], list(r[2])) for r in rows], "vec_id long, label int, v array<long>").repartition(4)
    assert got_negatives(op12.hard_negatives(df, F.col("vec_id") % 100 == 0)) == plain_negatives(rows)


def test_negatives_leave_out_rows_and_take_large_numbers(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [2.0, 2.0]), (2, 2, [2.0, 1.9]), (3, None, [9.0, 9.0]), (None, 1, [9.0, 9.0]), (4, 2, None), (5, 2, []), (6, 2, [float("nan"), 1.0]), (7, 2, [None, 1.0]), (8, 2, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("score", F.lit("extra")).withColumn("key", F.lit(None).cast("string"))
    found = op12.usable(df, 256, F.col("label"))
    assert {r["vec_id"] for r in found.collect()} == {0, 1, 2}
    assert got_negatives(op12.hard_negatives(found, F.col("vec_id") == 0)) == [(0, 1, 1, 2, 256 * 256 * 6, 256 * 512 + 512 * 486)]
    assert op12.hard_negatives(found.limit(0), F.lit(True)).count() == 0
    large = [(0, 1, (1 << 30, 7)), (1, 1, (1 << 30, 3)), (2, 2, ((1 << 30) - 1, 5)), (3, 2, (-(1 << 30), 1)), (4, 3, ((1 << 30) - 5, 0))]
    big = spark.createDataFrame([(*r[:2], list(r[2])) for r in large], "vec_id long, label int, v array<long>")
    assert got_negatives(op12.hard_negatives(big, F.col("vec_id") == 0)) == plain_negatives(large)
    with pytest.raises(ValueError, match="too large"):
        op12.hard_negatives(spark.createDataFrame([(0, 1, [1 << 31, 1])], "vec_id long, label int, v array<long>"), F.lit(True))


def plain_alignment(texts):
    """Offsets and common ends over whole texts, without pieces or a graph."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    out, links = [], []
    for text in texts:
        data, a, b = (" " + text).encode() if text else b"", [], []
        if text:
            e = tok.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
            ids = sp.encode(text)
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in ids]
            if b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
                a, b = [], []
        ends = [dict(zip(np.cumsum([len(x) for _, x in side]).tolist(), (i for i, _ in side))) for side in (a, b)]
        common = sorted(ends[0].keys() & ends[1].keys())
        own = [(ends[0][c], ends[1][c]) for c in common]
        members = [[[], []] for _ in common]
        for side in (0, 1):
            for e, i in ends[side].items():
                members[bisect.bisect_left(common, e)][side].append(str(i))
        groups = ["|".join(map(",".join, m)) for m in members]
        links.append(own)
        out.append((len(a), len(b), len(common), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(x for own in links for x in own)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(*o[:4], sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), o[4]) for o, own in zip(out, links)]


_COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query(spark):
    rows = real_documents(spark).collect()
    want = sorted(zip([r["doc_id"] for r in rows], plain_alignment([r["text"] for r in rows])))
    got = QUERIES["op13_align"](spark, SF).collect()
    assert sorted((r["doc_id"], tuple(r[c] for c in _COLUMNS)) for r in got) == want
    assert sum(r["n_groups"] for r in got) > 10_000


def test_alignment_odd_texts(spark):
    rng = random.Random(4)
    letters = ["a", "The", " ", "  ", "\n", "\t", "é", "ﬁ", "　", "中", "😀", " ", "\x1c", " ", "▁", "<s>", "</s>", "<|endoftext|>", "<0x41>", "'s", "12", "́", "​", "\x00", "\r", "x y"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 12))) for _ in range(1_500)]
    texts += [" ", "  ", " a ", "a  ", "word" * 20_000, "ab " * 30_000, "many words here " * 3, "<unk>"]
    rows = [(i, t) for i, t in enumerate(texts)] + odd_rows()
    got = op13.align(documents(spark, rows).repartition(6), A, B)[0].collect()
    want = plain_alignment([t for _, t in rows])
    assert sorted(((r["doc_id"], *(r[c] for c in _COLUMNS)) for r in got), key=str) == sorted(((d, *w) for (d, _), w in zip(rows, want)), key=str)
    assert op13.align(documents(spark, []), A, B)[0].count() == 0


def test_alignment_pieces_are_forgotten_and_pairs_bounded(spark, monkeypatch):
    words = op13.Vocabularies(A, B)
    aligner = op13.Aligner(words, "test alignment")
    monkeypatch.setattr(op13, "PIECES", 3)
    texts = ["some words in a text", "other words in a text", "x" * 300 + " words"]
    assert [x[1:4] for x in aligner.texts(texts)] == [w[:3] for w in plain_alignment(texts)] == [x[1:4] for x in aligner.texts(texts)]
    _, counts = op13.align(real_documents(spark), A, B)
    assert 0 < counts.count() < words.most_pairs() < 2_000_000


def test_components_are_the_smallest_groups():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 30)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randrange(n)), n}) for _ in range(2))
        common = sorted(set(a) & set(b))
        of_a, of_b = (x.tolist() for x in op13.components(np.array(a), np.array(b)))
        groups = [[[side[i] for i, x in enumerate(of) if x == name] for side, of in ((a, of_a), (b, of_b))] for name in sorted(set(of_a))]
        assert set(of_a) == set(of_b) and [(x[-1], y[-1]) for x, y in groups] == [(c, c) for c in common]
        assert of_a == sorted(of_a) and of_b == sorted(of_b)
