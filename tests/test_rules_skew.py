"""Rule tables, crowded keys, batches that do not depend on partitioning, recall of the lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import centroids as N
from plumbline.operators import matching as M
from plumbline.operators import rules as R
from plumbline.operators import search as S
from plumbline.operators import skew
from plumbline.operators import texts as X
from plumbline.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.01"


def test_rules(spark):
    table = lambda *rows: spark.createDataFrame(rows, R.RULES)
    rules = R.checked(table(("b", "n > 1", "medium", 2), ("a", "n > 2", "low", 1), ("c", "n IS NULL", "high", 3)))
    df = spark.createDataFrame([(3, ["b:x"]), (2, None), (0, ["odd"]), (None, []), (1, ["a:detail"])], "n int, found array<string>")
    got = [(r["codes"], r["band"]) for r in R.judged(df, rules, "found").collect()]
    assert got == [(["b:x", "a", "b"], "low"), (["b"], "medium"), (["odd"], "high"), (["c"], "high"), (["a:detail"], "low")]
    for bad in ([("a", "n", "worst", 1)], [("a", "n", "low", 1), ("a", "m", "low", 2)], [("a:b", "n", "low", 1)], [("a", None, "low", 1)]):
        with pytest.raises(ValueError):
            R.checked(table(*bad))


def test_crowded_keys_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(skew, "CROWDED", 10)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, "hot line").otherwise(F.concat(F.lit("line "), (F.col("id") % 150).cast("string"))).alias("text"))
        facts = docs.groupBy("text").agg(F.count("*").alias("n"), F.min("id").alias("first"))
        got = skew.joined(docs, facts, ["text"], "n")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.join(facts, "text").select(got.columns).collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
        monkeypatch.setattr(skew, "HOT_BYTES", 10)
        assert "BroadcastHashJoin" not in skew.joined(docs, facts, ["text"], "n", F.length("text"))._jdf.queryExecution().executedPlan().toString()
        first = {r["text"]: r["first"] for r in facts.filter("n > 1").collect()}
        copies = {r["id"]: r["first_id"] for r in X.exact_duplicates(docs, "id", "text").collect()}
        assert copies == {r["id"]: first[r["text"]] for r in docs.collect() if r["text"] in first}
        classes = {r["id"]: r["class_id"] for r in M.candidates_by(docs, "id", {"line": F.col("text")}).collect()}
        assert classes == copies
        dated = docs.withColumn("day", F.lit(None).cast("date"))
        assert X.duplicate_groups(dated, "text", "id", "text", "day").count() == len(copies)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_batches_do_not_depend_on_partitioning(spark):
    rows = [(i, (i * 37) % 5_000) for i in range(3_000)] + [(None, 5), (-7, 70_000)]
    df = spark.createDataFrame(rows, "id long, n long")
    batches = lambda parts: sorted(map(tuple, S.embedding_batches(df.repartition(parts), "id", "n", ids=1_000).collect()), key=str)
    first = batches(3)
    assert first == batches(7) and len(first) == len(rows)
    sums = {}
    for _, batch, tokens in first:
        n, size = sums.get(batch, (0, 0))
        sums[batch] = n + 1, size + tokens
    assert all(n <= 64 and (size <= 60_000 or n == 1) for n, size in sums.values())


def test_lists_recall_and_exact_search(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    vectors = [(i, (centres[i % 30] + rng.normal(size=16) * 0.5).astype(np.float32).tolist()) for i in range(3_000)]
    odd = [(5_000, None), (5_001, []), (5_002, [0.0] * 16), (5_003, [float("nan")] * 16), (None, [1.0] * 16), (5_004, [1.0, 2.0])] + [(6_000 + i, vectors[0][1]) for i in range(15)]
    rows = N.usable(spark.createDataFrame(vectors + odd, "id long, v array<float>"), "id", "v")
    index = N.write_lists(rows, 20)
    assert index.read().count() == 3_015
    asked = rows.filter("row % 50 = 0")
    exact = N.nearest(index, asked, 10, others=True)
    m = np.array([v for _, v in vectors] + [vectors[0][1]] * 15, np.float64)
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    ids = np.array([*range(3_000), *range(6_000, 6_015)])
    want = {}
    for q in [i for i in ids if i % 50 == 0]:
        score = np.round(m[list(ids).index(q)] @ m.T, 9)
        want[int(q)] = [int(i) for _, i in sorted((-s, i) for s, i in zip(score, ids) if i != q)[:10]]
    got = {}
    for r in exact.orderBy("question", "rank").collect():
        got.setdefault(r["question"], []).append(r["row"])
    assert got == want
    found = N.recall(N.nearest(index, asked, 10, probe=5, others=True), exact)
    assert found.agg(F.avg("recall")).first()[0] >= 0.9 and found.count() == len(want)
    empty = N.write_lists(rows.limit(0))
    assert N.nearest(empty, asked, 3).count() == 0 and N.nearest(index, asked.limit(0), 3).count() == 0


def test_recall_of_the_registered_search(spark):
    exact, near = QUERIES["vector_topk"](spark, SF).filter("rank <= 10"), QUERIES["approximate_nearest"](spark, SF)
    found = N.recall(near.withColumnRenamed("doc_id", "row"), exact.withColumnRenamed("doc_id", "row"))
    assert found.agg(F.avg("recall")).first()[0] >= 0.9
