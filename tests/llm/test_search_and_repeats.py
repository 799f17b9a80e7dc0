"""Operators 1, 2 and 5 against brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.llm import op1_topk, op2_repeats, op5_near_duplicates
from plumbline.llm.common import key_filter, passes, tidied
from plumbline.llm.graph import components
from plumbline.llm.queries import QUERIES
from plumbline.llm.shingles import shingles
from tests.llm.helpers import SF, documents, odd_rows, real_documents, texts_of


def brute_top(vectors, k=10):
    out = {}
    for q, v in vectors:
        if q % 100 == 0:
            scored = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def got_top(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_topk_query(spark):
    rows = [(r["vec_id"], np.floor(1024 * np.array(r["embedding"], np.float64)).astype(np.int64).tolist()) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got_top(QUERIES["op1_topk"](spark, SF)) == brute_top(rows)


@pytest.mark.parametrize(("k", "lists"), [(1, 1), (3, 2), (10, 4)])
def test_topk_ties_and_odd_vectors(spark, k, lists):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(250)] + [(300 + i, [0.5] * 6) for i in range(20)]
    bad = [(1000, None), (1001, []), (1002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6), (None, [1.0] * 6), (1100, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("extra")).repartition(5)
    whole = [(i, np.floor(1024 * np.array(v)).astype(int).tolist()) for i, v in rows] + [(1100, [1024, 2048])]
    vectors = op1_topk.quantised(df)
    got = got_top(op1_topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k, lists))
    assert got == {q: v for q, v in brute_top(whole, k).items() if v}


def test_topk_large_numbers_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(op1_topk, "QUERIES", 2)
    rows = [(100 * i, [(1 << 30) + i, -(1 << 29) + 7 * i, i]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    assert got_top(op1_topk.top_k(df, df, 3)) == brute_top(rows, 3)


def test_topk_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    vectors = op1_topk.quantised(empty)
    assert op1_topk.top_k(vectors, vectors).count() == 0


def brute_cut(texts):
    """(bytes, removed, runs, digest) by id, by looking up every window."""
    seen, out = set(), {}
    for doc in sorted(texts):
        data = texts[doc].encode("utf-8", "surrogatepass")
        gone = bytearray(len(data))
        for i in range(len(data) - op2_repeats.LENGTH + 1):
            w = data[i : i + op2_repeats.LENGTH]
            if w in seen:
                gone[i : i + op2_repeats.LENGTH] = b"\1" * op2_repeats.LENGTH
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def got_cut(df):
    return {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect() if r["doc_id"] is not None}


def test_repeats_query(spark):
    assert got_cut(QUERIES["op2_repeats"](spark, SF)) == brute_cut(texts_of(real_documents(spark)))


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_odd_rows(spark, monkeypatch, hot):
    """Also with every anchor treated as hot: the other way to the same result."""
    if hot:
        monkeypatch.setattr(op2_repeats, "hot_anchors", lambda docs: np.sort(np.unique(np.concatenate([op2_repeats.spans_of((r["text"] or "").encode())[0] for r in docs.collect()]))))
    monkeypatch.setattr(op2_repeats, "TEXT_BYTES", 3_000)
    df = documents(spark, odd_rows()).repartition(4)
    out = op2_repeats.without_repeats(df)
    assert got_cut(out) == brute_cut(texts_of(df))
    assert out.filter("doc_id is null and n_removed > 0").count() == 0


def naive_factors(texts, length):
    """LPF by comparing every two starts."""
    whole = [(t, i) for t in texts for i in range(len(t))]
    out = []
    for k, (t, i) in enumerate(whole):
        best = 0
        if len(t) - i >= length:
            for u, j in whole[:k]:
                if len(u) - j >= length:
                    n = 0
                    while n < length and t[i + n] == u[j + n]:
                        n += 1
                    best = max(best, n)
        out.append(best)
    return out


@pytest.mark.parametrize("length", [5, 12, 20, 40])
def test_previous_factors_equal_naive(length):
    rng = np.random.default_rng(length)
    texts = [bytes(rng.integers(97, 99, n).tolist()) for n in (90, 120, 7, 80)] + [b"ab" * 40, b"ab" * 30, b"", b"c" * 60]
    got = op2_repeats.previous_factors(b"".join(texts), np.array(list(map(len, texts))), length)
    assert got.tolist() == naive_factors(texts, length)


def test_suffix_arrays_are_made_of_parts_of_whole_anchors(monkeypatch):
    rng, length = np.random.default_rng(5), op2_repeats.LENGTH
    base = bytes(rng.integers(97, 123, 6_000, dtype=np.uint8))
    texts = [base, *[base[:a] + b"#" + base[a:] for a in rng.integers(0, 6_000, 15).tolist()]]
    rows = []
    for doc, data in enumerate(texts):
        h, start, n = op2_repeats.spans_of(data)
        part = (op2_repeats.mixed(h) % np.uint64(256)).astype(np.uint8)
        spans = b"".join(data[a : a + m + length - 1] for a, m in zip(start.tolist(), n.tolist(), strict=True))
        rows.append({"what": "context", "bucket": 0, "h": part.tobytes(), "s": spans, "doc": np.full(len(h), doc).tobytes(), "start": start.tobytes(), "n": n.astype("<i4").tobytes()})
    sizes, plain = [], op2_repeats.previous_factors
    monkeypatch.setattr(op2_repeats, "previous_factors", lambda text, n: sizes.append(len(text)) or plain(text, n))

    def marks(most):
        monkeypatch.setattr(op2_repeats, "SUFFIX_BYTES", most, raising=False)
        sizes.clear()
        out = op2_repeats._look_into(1)(pd.DataFrame(rows))
        return [out[c].tolist() for c in ("doc", "start", "n")], list(sizes)

    whole, parts = marks(1 << 30), marks(50_000)
    assert len(whole[1]) == 1 and len(parts[1]) > 1 and max(parts[1]) <= 50_000
    assert whole[0] == parts[0] and sum(parts[1]) == whole[1][0]


def test_smaller_before_equals_a_stack():
    rng = np.random.default_rng(6)
    for x in (rng.permutation(300), np.arange(50), np.arange(50)[::-1].copy(), np.zeros(0, int)):
        want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(len(x))]
        assert op2_repeats._smaller_before(x).tolist() == want


def test_repeats_far_ids_beside_null_ids(spark):
    """Ids that floating point cannot hold; rows without an id come back whole, each of them."""
    rng = np.random.default_rng(9)
    text = " ".join(f"w{x}" for x in rng.integers(0, 10_000, 80))
    far = (1 << 53) + 1
    df = spark.createDataFrame([(5, text), (far, text), (None, text), (None, text), (None, None)], "doc_id long, text string").repartition(3)
    got = op2_repeats.without_repeats(df).collect()
    n = len(text)
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in got) == [(-1, 0, 0), (-1, n, 0), (-1, n, 0), (5, n, 0), (far, n, n)]


def test_repeats_empty(spark):
    assert op2_repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_components(texts):
    sets = {d: set(shingles(t).tolist()) for d, t in texts.items()}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in ids}


def got_components(df):
    rows = [r for r in df.collect() if r["doc_id"] is not None]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_near_duplicates_query(spark):
    assert got_components(QUERIES["op5_near_duplicates"](spark, SF)) == brute_components(texts_of(real_documents(spark)))


def test_near_duplicates_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    near = []
    for i in range(60):  # edits of different weight: some linked, some only through others, some not at all
        words = list(base)
        for at in rng.integers(0, 120, i % 9):
            words[at] = f"e{i}x{at}"
        near.append((100 + i, " ".join(words)))
    df = documents(spark, odd_rows() + near + [(500, "two words"), (501, "TWO Words")])
    out = op5_near_duplicates.near_duplicates(df)
    assert got_components(out) == brute_components(texts_of(df))
    assert out.filter("doc_id is null").select("kept", "component_id").distinct().collect() == [(True, None)]


@pytest.mark.parametrize("block", [4, 1000])
def test_near_duplicates_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(op5_near_duplicates, "BLOCK", block)
    monkeypatch.setattr(op5_near_duplicates, "SETS", block)
    rows = [(i, " ".join(f"t{j + i // 3}" for j in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_components(op5_near_duplicates.near_duplicates(df)) == brute_components(texts_of(df))


def test_pigeonhole():
    """Signatures of 96 symbols that differ in 47 share a key, wherever the differences lie."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, 96).astype(np.uint16)
        b = a.copy()
        b[rng.choice(96, 47, replace=False)] += 1
        keys = op5_near_duplicates.chunk_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()


def test_maps_give_memory_back_when_they_end_or_are_left(monkeypatch):
    given = []
    monkeypatch.setattr("plumbline.llm.common.give_back", lambda: given.append(1))
    run = tidied(lambda batches: (x + 1 for x in batches))
    assert list(run(iter([1, 2]))) == [2, 3] and len(given) == 1
    left = run(iter([1, 2]))
    assert next(left) == 2
    left.close()
    assert len(given) == 2


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}


def test_key_filter(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(-(1 << 63), 1 << 63, 5_000, dtype=np.int64)
    bits = key_filter(spark.createDataFrame([(int(k),) for k in keys[:2_000]], "k long"), "k", 2_000)
    assert passes(bits, keys[:2_000]).all() and passes(bits, keys[2_000:]).mean() < 0.01
    assert not passes(key_filter(spark.createDataFrame([], "k long"), "k", 0), keys).any() and len(passes(bits, keys[:0])) == 0


def test_components_of_a_hot_star(spark):
    """A centre with most of all links: its links are joined by broadcast."""
    links = spark.createDataFrame([(5, i) for i in range(10, 4_000)] + [(i, i + 1) for i in range(5_000, 5_300)] + [(3_999, 5_000)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {**dict.fromkeys([5, *range(10, 4_000), *range(5_000, 5_301)], 5)}


@pytest.mark.parametrize(("picked", "shingles_"), [(0, 4_000_000), (1 << 25, 300)])
def test_near_duplicates_by_semi_join_and_by_size(spark, monkeypatch, picked, shingles_):
    monkeypatch.setattr(op5_near_duplicates, "PICKED", picked)
    monkeypatch.setattr(op5_near_duplicates, "SHINGLES", shingles_)
    rows = [(i, " ".join(f"t{j + i // 3}" for j in range(60 + 400 * (i == 7)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_components(op5_near_duplicates.near_duplicates(df)) == brute_components(texts_of(df))


def test_near_duplicates_empty(spark):
    assert op5_near_duplicates.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
