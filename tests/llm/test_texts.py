"""Operators 3, 4 and 6 to 10 and the pipeline: round trips, plain versions, held-out accuracy, odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import op3_token_files as op3
from plumbline.llm import op4_quality as op4
from plumbline.llm import op6_byte_bpe as op6
from plumbline.llm import op7_pii as op7
from plumbline.llm import op8_lm as op8
from plumbline.llm import op9_secrets as op9
from plumbline.llm import op10_decontaminate as op10
from plumbline.llm.common import lower_words
from plumbline.llm.queries import QUERIES
from plumbline.llm.shingles import mixed
from tests.llm.helpers import SF, documents, new_folder, odd_rows, real_documents, texts_of

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def token_rows(texts):
    tok = Tokenizer.from_file(JSON)
    out, start = {}, 0
    for doc in sorted(texts):
        ids = np.array([*tok.encode(texts[doc], add_special_tokens=False).ids, 2], "<u4")
        out[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def got_tokens(df):
    return {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()}


def test_token_files_query(spark):
    assert got_tokens(QUERIES["op3_token_files"](spark, SF)) == token_rows(texts_of(real_documents(spark)))


def test_token_files_layout(spark, tmp_path):
    rows = [r for i, r in enumerate(odd_rows()) if r[0] is not None and r[0] != 10]
    df, path = documents(spark, rows), new_folder(tmp_path)
    manifest = op3.write_token_files(df, path, JSON, length=16)
    assert got_tokens(op3.read_token_files(manifest, path)) == token_rows(texts_of(df))
    for r in manifest.collect():
        ids, masks, _ = op3.open_sequences(path, r["path"])
        assert all(x.shape[1] == 16 for x in ids) and sum(int(m.sum()) for m in masks) == r["n_tokens"]
        assert not ids[0].flags.owndata and not masks[0].flags.owndata  # views of the file
        assert masks[0].dtype == np.uint8 and all(m.max() == 1 for m in masks)


def test_token_files_odd_rows(spark, tmp_path):
    path = new_folder(tmp_path)
    out = op3.read_token_files(op3.write_token_files(documents(spark, odd_rows()), path, JSON), path).collect()
    assert len(out) == len(odd_rows()) and sum(r["doc_id"] is None for r in out) == 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    path = new_folder(tmp_path, "y")
    assert op3.read_token_files(op3.write_token_files(empty, path, JSON), path).count() == 0


@pytest.fixture(scope="module")
def bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return op6.codec(RANKS, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_tiktoken(bpe):
    (encoder, memo), ref = bpe
    rng = random.Random(4)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "中", "😀", "'s", "12", "!?", " ", "\x1c", " ", "schaft"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = np.frombuffer(next(memo.ids([text])), "<u4").tolist()
        assert ids == ref.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_prefix_rows_append_and_edit(bpe):
    (encoder, _), _ = bpe
    rng = random.Random(5)
    for _ in range(200):
        data = bytes(rng.choice(b"abcdeth in") for _ in range(rng.randint(0, 200)))
        rows = encoder.table(data[: len(data) // 2])
        assert encoder.table(data, rows) == encoder.table(data)
        start = rng.randint(0, len(data))
        stop = min(len(data), start + rng.randint(0, 4))
        after, cost = encoder.edited(encoder.table(data), data, start, stop, b"xy")
        assert after == encoder.table(data[:start] + b"xy" + data[stop:])
        assert cost <= len(after)


def test_byte_bpe_query_and_odd_rows(spark, bpe):
    _, ref = bpe
    for df, out in ((real_documents(spark), QUERIES["op6_byte_bpe"](spark, SF)), (documents(spark, odd_rows()), op6.encode_decode(documents(spark, odd_rows()), RANKS, P.PATTERN))):
        rows = out.collect()
        texts = texts_of(df)
        assert len(rows) == df.count()
        for r in rows:
            if r["doc_id"] is not None:
                ids = np.array(ref.encode_ordinary(texts[r["doc_id"]]), "<u4")
                assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = op4.graded(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    model = op4.fit_on(docs, labels.filter("doc_id % 4 <> 0"))
    rest = op4.scored(docs.join(labels.filter("doc_id % 4 = 0"), "doc_id"), model).select("grade", "p_top", "expected_grade").toPandas()
    kept = rest["p_top"] >= op4.KEEP
    assert kept[rest["grade"] == 2].mean() > 0.95
    assert kept[rest["grade"] == 0].mean() < 0.1
    assert kept[rest["grade"] == 1].mean() < 0.5
    assert rest.groupby("grade")["expected_grade"].mean().is_monotonic_increasing
    assert np.all(np.diff(model.thresholds) > 0)


def test_quality_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(8)
    n, names, k = 60, 7, 4
    held = [np.flatnonzero(rng.random(names) < 0.4) for _ in range(n)]
    flat, row = np.concatenate(held), np.repeat(np.arange(n), list(map(len, held)))
    grades, balance = rng.integers(0, k, n), rng.random(n) + 0.5
    for _ in range(20):
        x = rng.normal(size=names + k - 1)
        loss, grad = op4.slope_at(x, flat, row, grades, balance, names, k, 0.01)
        cuts, w = op4.cuts_of(x[names:]), x[:names]
        plain = 0.0
        for i in range(n):  # the cumulative-link likelihood, a document at a time
            score = w[held[i]].sum()
            at_most = [0.0, *(1 / (1 + math.exp(score - c)) for c in cuts), 1.0]
            plain -= balance[i] * math.log(at_most[grades[i] + 1] - at_most[grades[i]]) / n
        assert math.isclose(loss, plain + 0.005 * float(w @ w), rel_tol=1e-9)
        for j in range(len(x)):
            step = np.zeros(len(x))
            step[j] = 1e-5
            slope = (op4.slope_at(x + step, flat, row, grades, balance, names, k, 0.01)[0] - op4.slope_at(x - step, flat, row, grades, balance, names, k, 0.01)[0]) / 2e-5
            assert math.isclose(grad[j], slope, rel_tol=1e-4, abs_tol=1e-7)


def test_quality_query_equals_a_plain_version(spark):
    """The query's rows from features, counts, fit and scores on whole lists, without Spark."""
    docs, rated = [(r["doc_id"], r["text"] or "") for r in real_documents(spark).collect()], {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        rated[r["doc_id"]] = min(rated.get(r["doc_id"], 2), 0 if r["quality"] < 1 else 1 if r["toxic"] >= 1 else 2)
    seen = sorted((rated[d], op4.features(t).tobytes()) for d, t in docs if d in rated)
    grades, sets = np.array([g for g, _ in seen]), [np.frombuffer(b, np.int32) for _, b in seen]
    counts = np.zeros((op4.GRADES, 1 << op4.BITS), np.int64)
    for g, b in zip(grades, sets):
        counts[g, b] += 1
    use = op4.telling(counts, np.bincount(grades, minlength=op4.GRADES))
    model = op4.fit([b[use[b]] for b in sets], grades)
    got = {r["doc_id"]: (r["expected_grade"], r["p_top"], r["kept"]) for r in QUERIES["op4_quality"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        below = [1 / (1 + math.exp(model.weights[op4.features(t)].sum() - c)) for c in model.thresholds]
        assert np.allclose(got[d][:2], (sum(1 - b for b in below), 1 - below[-1]), atol=1e-6) and got[d][2] == (got[d][1] >= op4.KEEP)


def test_quality_keeps_own_columns_and_ties(spark):
    rows = [(i, f"{'good fine' if i % 2 else 'bad poor'} text number {i}") for i in range(200)] + [(7, "good fine text number 7")] * 3
    df = documents(spark, rows).withColumn("p_top", F.lit("own"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    model = op4.fit_on(df, op4.graded(labels), k=3)
    kept = op4.kept_by(df, model)
    assert kept.columns == df.columns and {r["p_top"] for r in kept.collect()} == {"own"}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i % 2)
    again = op4.fit_on(df.repartition(7), op4.graded(labels), k=3)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.thresholds, again.thresholds)


def test_quality_odd_rows(spark):
    df = documents(spark, odd_rows())
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted((r["doc_id"], r["grade"]) for r in op4.graded(labels).collect()) == [(1, 0), (6, 1)]
    out = op4.scored(df, op4.fit_on(df, op4.graded(labels)))
    assert out.count() == df.count() and set(df.columns) - {"expected_grade"} <= set(out.columns)
    none = op4.scored(df, op4.fit_on(df, op4.graded(labels.limit(0))))
    assert none.filter("p_top < 0.4").count() == 0
    assert op4.scored(df.limit(0), op4.fit_on(df, op4.graded(labels))).count() == 0


def plain_entities(x):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        t = 0
        for i, c in enumerate(s[::-1]):
            d = int(c) * (1 + i % 2)
            t += d - 9 * (d > 9)
        return t % 10 == 0

    o = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    o += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(y) <= 255 for y in m[0].split("."))]
    o += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return o + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m[0])) <= 15]


def plain_secrets(x):
    o = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x, re.I | re.A) if len(m[2]) >= 6]
    o += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    o += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(o)]


def test_scanners_equal_plain_patterns():
    rng = random.Random(6)
    parts = ["a@b.c", "@", "x.y@z", "@q.r", ".", "1.2.3.4", "256.1.1.1", "007.8.9.1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+4", "-", " ", "\n", "é", "token=", "PassWord: 'abcdef1'", "ſecret=abcdefg", "api_key = x", "AKIA" + "Z9" * 9, "0a" * 13, "feed" * 5, "secret", "=", "9" * 30]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert op7.entities(text) == plain_entities(text)
        assert op9.credentials(text) == plain_secrets(text)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_personal_data_query(spark):
    texts = texts_of(real_documents(spark))
    for r in QUERIES["op7_pii"](spark, SF).collect():
        want = plain_entities(texts[r["doc_id"]])
        assert r["base_sha256"] == digest(want) and [r[f"n_{k}"] for k in op7.KINDS] == [sum(s[0] == k for s in want) for k in op7.KINDS]


def test_disclosing_terms(spark):
    """A word that stands by one address in many contexts discloses it; common words do not."""
    rng = random.Random(7)
    words = [f"common{''.join(rng.choices('abcdefgh', k=2))}" for _ in range(30)]
    rows = [(i, " ".join(rng.choices(words, k=8)) + (" zanzibar ann@x.org " if i % 9 == 0 else " ") + " ".join(rng.choices(words, k=8))) for i in range(400)]
    df = documents(spark, rows)
    found = op7.find_personal_data(df)
    hits = {r["doc_id"]: r["terms"] for r in found.collect() if r["terms"]}
    texts = dict(rows)
    assert set(hits) == {i for i in range(400) if i % 9 == 0}
    assert {texts[d][t["start"] : t["end"]] for d, ts in hits.items() for t in ts} == {"zanzibar"}
    clean = {r["doc_id"]: r["text"] for r in op7.sanitised(df).collect()}
    assert "<email>" in clean[0] and "zanzibar" not in clean[0] and clean[1] == texts[1]


def plain_disclosing(texts, disclosure=0.8, chance=1e-6):
    """(entity, term) names whose PMI and significance suffice, from dictionaries."""
    words, together, around, contexts, spots = Counter(), Counter(), Counter(), {}, {}
    for text in texts:
        words.update(re.findall(r"[^\W\d_]{3,}", text.lower()))
        spans = plain_entities(text)
        for kind, start, end in spans:
            near = [t for t, s, e in op7.nearby_terms(text, start, end) if not any(a < e and s < b for _, a, b in spans)]
            for entity in (kind, f"{kind}:{text[start:end].lower()}"):
                if near:
                    spots.setdefault(entity, set()).add(" ".join(near))
                for t in near:
                    together[entity, t] += 1
                    around[entity] += 1
                    contexts.setdefault((entity, t), set()).add(" ".join(near))
    total, out = sum(words.values()), set()
    for (entity, t), n in together.items():
        k, expected = len(contexts[entity, t]), len(spots[entity]) * min(1.0, 12 * words[t] / total)
        pmi = math.log2(n / around[entity]) - math.log2(words[t] / total)
        if k >= 2 and k > expected and k * math.log(k / expected) - k + expected >= -math.log(chance) and pmi / -math.log2(around[entity] / total) >= disclosure:
            out.add((entity, t))
    return out


def test_disclosing_terms_equal_a_plain_version_wherever_they_stand(spark):
    rng = random.Random(17)
    words = ["".join(rng.choices("abcdefghijkl", k=5)) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for i in range(300):
        who = i % 50
        held = f"name{chr(97 + who % 26)}{chr(97 + who // 26)}x and u{who}@mail.org" if i < 100 else "no address"
        rows.append((i, f"{say(20)} {held} {say(20)}\nfar {say(40)} name{chr(97 + who % 26)}{chr(97 + who // 26)}x, 10.0.{who}.9\n{say(5)}"))
    rows += [(500 + i, rows[0][1]) for i in range(20)]  # copies are one context
    texts = [t for _, t in rows]
    want = plain_disclosing(texts)
    assert len(want) > 30  # names that stand by an address in two contexts only
    found = op7.scan(documents(spark, rows).repartition(5))
    keys = {op7._key(x): x for x in {y for t in texts for k, a, b in plain_entities(t) for y in (k, f"{k}:{t[a:b].lower()}")} | {w for t in texts for w in re.findall(r"[^\W\d_]{3,}", t.lower())}}
    assert {(keys[r["entity"]], keys[r["term"]]) for r in op7.disclosing_terms(found).collect()} == want
    for r in op7.find_personal_data(documents(spark, rows)).collect():
        text = dict(rows)[r["doc_id"]]
        own = {y for k, a, b in plain_entities(text) for y in (k, f"{k}:{text[a:b].lower()}")}
        terms = {t for e, t in want if e in own}
        spans = plain_entities(text)
        places = [m.span() for m in re.finditer(r"[^\W\d_]{3,}", text) if m[0].lower() in terms and not any(a < m.end() and m.start() < b for _, a, b in spans)]
        assert [(t["start"], t["end"]) for t in r["terms"] or ()] == places


@pytest.mark.parametrize("filtered", [0, 1 << 25])
def test_sanitised_rows_keep_their_own_spans(spark, monkeypatch, filtered):
    monkeypatch.setattr(op7, "FILTERED", filtered)
    rows = [(None, "null id a@b.org"), (None, "write to c@d.org or 10.0.0.1"), (7, "same id e@f.org here"), (7, "other text of the id, +1 234 567 890 12"), (7, "same id e@f.org here"), (8, None)]
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in op7.sanitised(documents(spark, rows)).collect())
    assert got == [(0, "null id <email>"), (0, "write to <email> or <ip>"), (7, "other text of the id, <phone>"), (7, "same id <email> here"), (7, "same id <email> here"), (8, "")]


def test_personal_data_in_a_very_long_line(spark):
    text = ("word " * 40 + "x@y.org 1.2.3.4 ") * 4_000
    got = op7.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(got["spans"]) == 8_000


def test_nearby_terms_are_whole_words():
    text = "abcdefgh" * 30 + " left x@y.org right " + "abcdefgh" * 30
    assert [t for t, _, _ in op7.nearby_terms(text, text.index("x@"), text.index("x@") + 7)] == ["left", "right"]


def test_personal_data_and_secrets_odd_rows(spark):
    df = documents(spark, odd_rows())
    assert op7.find_personal_data(df).count() == df.count() == op9.find_secrets(df).count() == op9.redacted(df).count()
    assert op7.find_personal_data(df.limit(0)).count() == op9.find_secrets(df.limit(0)).count() == 0


def test_secrets_query(spark):
    texts = texts_of(real_documents(spark))
    for r in QUERIES["op9_secrets"](spark, SF).collect():
        assert r["base_sha256"] == digest(plain_secrets(texts[r["doc_id"]]))


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(8)
    letters = op9.ALPHABETS["base64"][:62]
    keys = {i: "".join(rng.choices(letters, k=40)) for i in range(0, 300, 10)}
    words = ["the", "house", "of", "parliament", "and", "garden", "water", "under", "light", "paper"]
    rows = [(i, " ".join(rng.choices(words, k=60)) + f" {keys.get(i, 'version_2_of_the_long_identifier')} " + "-".join(rng.choices(words, k=5)) + "-2024") for i in range(300)]
    found = {r["doc_id"]: {rows[r["doc_id"]][1][s["start"] : s["end"]] for s in r["spans"]} for r in op9.find_secrets(documents(spark, rows)).collect()}
    hit = sum(keys[i] in found[i] for i in keys)
    assert hit >= 0.9 * len(keys)
    assert all(not found[i] for i in range(300) if i not in keys)
    red = {r["doc_id"]: r["text"] for r in op9.redacted(documents(spark, rows)).collect()}
    assert all(keys[i] not in red[i] for i in keys if keys[i] in found[i]) and red[1] == rows[1][1]


@pytest.mark.parametrize("cap", [0, op8.BROADCAST_BYTES])
def test_language_model(spark, cap):
    df = real_documents(spark)
    texts = texts_of(df)
    out = {r["doc_id"]: r for r in op8.score(df, broadcast_bytes=cap).collect()}
    tokens = {d: [*lower_words(t), b"\n"] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    total, distinct = sum(c.values()), len(c)
    for d, ws in tokens.items():
        r = out[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(c[w] > 0 for w in ws), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws), rel_tol=1e-9)
    rest = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in rest) > sum(r["base_score"] for r in rest)  # better than single words on held-out text


def test_language_model_ways_agree_and_odd_rows(spark):
    df = documents(spark, odd_rows())
    a, b = (sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in op8.score(df, broadcast_bytes=cap).collect()) for cap in (0, op8.BROADCAST_BYTES))
    assert a == b and len(a) == df.count()
    assert [x[0] for x in a].count(True) == 2 and (False, 1 << 60) in [x[:2] for x in a]
    assert op8.score(df.limit(0)).count() == 0


def test_log_frequency_filter():
    grams = mixed(np.arange(1, 5001, dtype=np.uint64))
    counts = np.random.default_rng(9).zipf(1.5, 5000)
    bits = op8.build_filter(grams, counts)
    assert np.all(op8.read_levels(bits, grams) >= op8.level(counts))
    assert np.mean(op8.read_levels(bits, grams) > op8.level(counts)) < 0.05
    assert np.mean(op8.read_levels(bits, mixed(np.arange(9001, 14001, dtype=np.uint64))) > 0) < 0.05
    for keys in (np.sort(mixed(np.arange(100, dtype=np.uint64))), np.array([3, (1 << 64) - 1], np.uint64), np.zeros(0, np.uint64)):
        assert np.array_equal(op8._unpack(op8._pack(keys)), keys)
    for most in (0, 1, 255, 256, 70_000, 1 << 40):
        assert op8._wide(op8._small(np.array([0, most]))).tolist() == [0, most]
    assert op8.level(np.arange(5)).tolist() == [0, 1, 2, 3, 4]
    assert (op8._TWICE[op8.level(np.arange(1, 5))] / 2).tolist() == [1, 2, 3, 4.5]


def plain_model(train):
    """(p(word | context), words) from exact counts, levels and sums, in plain dicts."""
    words, pairs = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip([b"\n", *ws], ws))
    total, unknown = sum(words.values()), 1 / (sum(words.values()) + len(words) + 1)
    stands = lambda h, w: min(op8._TWICE[op8.level(np.array(pairs[h, w]))] / 2, words[h], words[w])
    mass, followers = Counter(), Counter()
    for h, w in pairs:
        mass[h] += stands(h, w)
        followers[h] += 1

    def p(w, h):
        single = (words[w] + 1) * unknown
        return (stands(h, w) + followers[h] * single) / (mass[h] + followers[h]) if followers[h] else single

    return p, words, total


@pytest.mark.parametrize("cap", [0, 1 << 40])
def test_language_model_scores_equal_a_plain_model(spark, monkeypatch, cap):
    """With a filter that hardly errs, chunks and shards of any size give the plain model's scores."""
    monkeypatch.setattr(op8, "CHUNK_BYTES", 40_000)
    monkeypatch.setattr(op8, "SHARD_BYTES", 30_000)
    df = real_documents(spark).repartition(3)
    tokens = {d: [*lower_words(t), b"\n"] for d, t in texts_of(df).items()}
    p, words, _ = plain_model([ws for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2])
    assert all(math.isclose(sum(p(w, h) for w in [*words, b"\0unknown"]), 1, rel_tol=1e-9) for h in [b"\n", *list(words)[:5]])
    got = {r["doc_id"]: r["score"] for r in op8.score(df, broadcast_bytes=cap, bits_per_entry=400).collect()}
    assert len(got) == len(tokens)
    for d, ws in tokens.items():
        assert math.isclose(got[d], sum(math.log10(p(w, h)) for h, w in zip([b"\n", *ws], ws)), rel_tol=1e-9), d


def test_alignment_equals_plain():
    rng = np.random.default_rng(10)
    for _ in range(200):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 20)
        h = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert op10.align(a, b)[0] == h.max()


def test_decontamination(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(800)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(20)] + [(90, "word"), (91, ""), (None, "x y z"), (92, None)]
    rows, want = [], set()
    for d in range(200):
        text = rng.choices(words, k=150)
        if d % 4 == 0:
            item = d % 20
            copy = items[item][1].split()
            for at in rng.sample(range(30), (d // 4) % 6):  # up to five of thirty words edited
                copy[at] = "edited"
            text[50:50] = copy
            want.add((d, item))
        rows.append((d, " ".join(text).title()))
    bench = spark.createDataFrame(items + items[:1], "item_id long, text string")
    got = op10.contaminated(documents(spark, rows), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def plain_leaks(texts, items):
    """(doc, item) whose whole texts align by 0.4 of the item's perfect score."""
    own = [(i, op10.word_hashes(t)) for i, t in items if i is not None and op10.words_of(t or "")]
    return {(d, i) for d, t in texts for i, w in own if op10.align(w, op10.word_hashes(t or ""))[0] >= 0.4 * 2 * len(w)}


@pytest.mark.parametrize("filtered", [0, 1 << 25])
def test_decontamination_query_equals_whole_alignment(spark, monkeypatch, filtered):
    monkeypatch.setattr(op10, "FILTERED", filtered)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op10_decontaminate"](spark, SF).collect()}
    assert got == plain_leaks(texts_of(real_documents(spark)).items(), bench) != set()


def test_decontamination_short_items_ties_and_odd_rows(spark):
    rows = [*odd_rows(), (70, "here stands Xylophon alone"), (71, "two words here"), (71, "two words here"), (None, "xylophon"), (72, "two other words")]
    items = [(1, "xylophon"), (2, "two words"), (2, "two words"), (3, "one two"), (4, "a b c d e f g h")]
    got = op10.contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["item_id"], r["score"], r["end_word"]) for r in got) == [(0, 1, 1.0, 1), (6, 3, 1.0, 2), (70, 1, 1.0, 3), (71, 2, 1.0, 2), (71, 2, 1.0, 2)]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert op10.contaminated(documents(spark, odd_rows()), bench).count() == 0
    assert op10.contaminated(real_documents(spark).limit(0), bench).count() == op10.contaminated(real_documents(spark), bench.limit(0)).count() == 0


def test_decontamination_of_an_item_that_leaked_everywhere(spark):
    """Its seeds and its copies are hot keys."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2_000)]
    items = [(i, " ".join(rng.choices(words, k=25))) for i in range(3)]
    rows = [(d, " ".join([*rng.choices(words, k=20), items[0 if d % 10 else 1][1] if d % 3 else "", *rng.choices(words, k=20)])) for d in range(3_000)]
    got = op10.contaminated(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(d, 0 if d % 10 else 1) for d in range(3_000) if d % 3}


def test_pipeline(spark):
    """Every stage against the operator's own decisions by plain code."""
    import corpus_pipeline

    docs = real_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        before, out = texts_of(docs), stage(spark, docs, SF).cache()
        after = texts_of(out) if "text" in out.columns else {}
        if name == "quality classifier":
            assert 0.5 * len(before) < len(after) and set(after) <= set(before)
        elif name == "MinHash near-dedup":
            from tests.llm.test_search_and_repeats import brute_components

            assert set(after) == {d for d, (_, c) in brute_components(before).items() if d == c}
        elif name == "benchmark decontamination":
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaked = {d for d, _ in plain_leaks(before.items(), bench)}
            assert set(after) == set(before) - leaked and leaked
        elif name == "secret scan":
            assert set(after) == set(before) and not any(plain_secrets(t) for t in after.values())
            assert all(after[d] == t for d, t in before.items() if not plain_secrets(t))
        else:
            assert {r["doc_id"]: r["decoded_sha256"] for r in out.collect()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in before.items()}
        if "text" in out.columns:
            assert out.columns == docs.columns
        docs = out
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("none", [False, True])
def test_pipeline_odd_rows(spark, none):
    import corpus_pipeline

    docs = spark.createDataFrame([(d, t, None, "src0", None) for d, t in odd_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.limit(0) if none else docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        assert out.count() <= docs.count() and (not none or out.count() == 0)
        assert out.columns == docs.columns or "decoded_sha256" in out.columns
        docs = out
    assert none or docs.filter("doc_id is null").count() > 0
