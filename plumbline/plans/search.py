"""Search queries: lexical and vector rankings, fusion, weights, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import query_terms
from plumbline.operators import centroids as N
from plumbline.operators import search as S
from plumbline.plans.postings import index_of
from plumbline.plans.registry import Tables, query

QUESTION = "the thing of and with this"
TERMS = query_terms(QUESTION)
PROBE = 48  # of 64 lists: recall 0.98 on 5,000 vectors without clusters (0.93 with 40, 0.89 with 32)
_LISTS: dict[tuple[str, str], N.Lists] = {}
_LIST = "[" + ", ".join(f"'{x}'" for x in TERMS) + "]"
_LEX = f"""SELECT doc_id, CAST(sum(len(list_filter(regexp_extract_all(lower(translate(text, 'İI', 'iı')), '\\p{{L}}+'), lambda x: list_contains({_LIST}, x)))) AS BIGINT) AS score FROM documents GROUP BY 1"""
_LEXRANK = f"""SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_LEX}) WHERE score > 0 ORDER BY rank LIMIT 50"""
_VECRANK = """SELECT vec_id AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) AS score, row_number() OVER (ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 9) DESC, vec_id) AS rank FROM embeddings ORDER BY rank LIMIT 50"""
_RRF = f"SELECT doc_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT doc_id, rank FROM ({_LEXRANK}) UNION ALL SELECT doc_id, rank FROM ({_VECRANK})) GROUP BY 1"


def _lexical(t: Tables) -> DataFrame:
    return S.lexical_ranking(index_of(t).frequencies(), "doc_id", TERMS, S.candidate_budget(10))


def _vector(t: Tables) -> DataFrame:
    vectors = t.embeddings
    asked = vectors.filter("vec_id = 0").select(F.col("embedding").alias("_q")).limit(1)
    rows = vectors.join(F.broadcast(asked), F.lit(True)).withColumnRenamed("vec_id", "doc_id")  # one row
    return S.vector_ranking(rows, "doc_id", "embedding", F.col("_q"), S.candidate_budget(10))


@query(_LEXRANK)
def lexical_rank(t: Tables) -> DataFrame:
    return _lexical(t).select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


_TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(translate(text, 'İI', 'iı')), '\\p{L}+')) AS term FROM documents"


@query(f"""WITH t AS ({_TOKENS}), l AS (SELECT doc_id, count(*) AS words FROM t GROUP BY 1), n AS (SELECT count(*) AS docs, avg(words) AS mean FROM l), h AS (SELECT term, doc_id, count(*) AS tf FROM t WHERE list_contains({_LIST}, term) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
s AS (SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / mean))), 9) AS score FROM h JOIN f USING (term) JOIN l USING (doc_id), n GROUP BY 1)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY rank LIMIT 50""")
def bm25_rank(t: Tables) -> DataFrame:
    index = index_of(t)
    return S.bm25_ranking(index.frequencies(), index.lengths(), "doc_id", TERMS, 50).select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


_ASKED = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9)"


def lists_of(t: Tables) -> N.Lists:
    """The vectors' index, written by the first query of a session that needs it."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _LISTS:
        _LISTS[key] = N.write_lists(N.usable(t.embeddings, "vec_id", "embedding"))
    return _LISTS[key]


def _questions(t: Tables) -> DataFrame:
    return N.usable(t.embeddings.filter("vec_id % 50 = 0"), "vec_id", "embedding")


@query(f"""SELECT q.vec_id AS question, v.vec_id AS doc_id, {_ASKED} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_ASKED} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 QUALIFY rank <= 50""")
def vector_topk(t: Tables) -> DataFrame:
    """The 50 nearest vectors of every vector whose id is divisible by 50, exactly."""
    near = N.nearest(lists_of(t), _questions(t), 50)
    return near.select("question", F.col("row").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query()
def approximate_nearest(t: Tables) -> DataFrame:
    """The ten nearest vectors in the lists that lie nearest; the tests measure its recall against the exact search."""
    near = N.nearest(lists_of(t), _questions(t), 10, probe=PROBE)
    return near.select("question", F.col("row").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT doc_id, round(score, 9) AS score FROM ({_RRF}) ORDER BY round(score, 9) DESC, doc_id LIMIT 10""")
def hybrid_rrf(t: Tables) -> DataFrame:
    """Lexical and vector candidates fused by reciprocal rank."""
    return S.rrf([_lexical(t), _vector(t)], "doc_id").withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"""SELECT r.doc_id, round(r.score * CASE d.source WHEN 'src0' THEN 1.5 WHEN 'src1' THEN 1.2 WHEN 'src2' THEN 0.8 ELSE 1.0 END, 9) AS score FROM ({_RRF}) r JOIN documents d USING (doc_id)""")
def authority_weighted(t: Tables) -> DataFrame:
    weights = F.create_map(*[F.lit(x) for kv in {"src0": 1.5, "src1": 1.2, "src2": 0.8}.items() for x in kv])
    fused = S.rrf([_lexical(t), _vector(t)], "doc_id").join(t.documents.select("doc_id", "source"), "doc_id")
    return S.weighted(fused, "score", weights[F.col("source")]).select("doc_id", F.round("score", 9).alias("score"))


@query(f"""SELECT d.source, max(l.score) AS best, array_to_string(list_transform(list_sort(list({{'s': -l.score, 'c': l.doc_id}})), lambda x: x.c), ',') AS chunks FROM ({_LEXRANK}) l JOIN documents d USING (doc_id) GROUP BY 1""")
def record_groups(t: Tables) -> DataFrame:
    """Sources by their best document, documents in order of score."""
    return S.by_record(_lexical(t).join(t.documents.select("doc_id", "source"), "doc_id"), "source", "score", "doc_id").withColumn("chunks", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ","))


@query(f"""SELECT l.doc_id, CASE WHEN d.source = 'src0' THEN p.text ELSE d.text END AS shown FROM ({_LEXRANK}) l JOIN documents d USING (doc_id) LEFT JOIN (SELECT lang, arg_min(text, doc_id) AS text FROM documents WHERE source <> 'src0' GROUP BY 1) p ON p.lang = d.lang""")
def redacted_hits(t: Tables) -> DataFrame:
    """Internal hits match but show the first public text of their language instead."""
    first = t.documents.filter("source <> 'src0'").groupBy("lang").agg(F.min("doc_id").alias("doc_id"))
    public = first.join(t.documents.select("doc_id", F.col("text").alias("public")), "doc_id").drop("doc_id")  # texts of a row per language
    hits = _lexical(t).join(t.documents.select("doc_id", "source", "lang", F.col("text").alias("shown")), "doc_id").join(public, "lang", "left")
    return S.public_text(hits, F.col("source") == "src0", "shown", F.col("public")).select("doc_id", "shown")


@query(f"""WITH s AS (SELECT q.vec_id AS q, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_ASKED} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id QUALIFY rank <= 10),
x AS (SELECT q.vec_id AS q, v.vec_id FROM embeddings q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT x.q AS question, round(avg(CASE WHEN s.rank IS NOT NULL THEN 1 ELSE 0 END), 9) AS recall FROM x LEFT JOIN s ON s.q = x.q AND s.vec_id = x.vec_id GROUP BY 1""")
def recall_at_k(t: Tables) -> DataFrame:
    """The share of a vector's label that is within its ten nearest, for every vector whose id is divisible by 50.

    Expected rows are counted by label, not listed: a label of a third of all rows is one sum.
    """
    v = t.embeddings.select("vec_id", "label").filter("label is not null")
    near = N.nearest(lists_of(t), _questions(t), 10, others=True).select("question", F.col("row").alias("vec_id"))
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question"), F.col("label").alias("wanted"))
    expected = asked.join(v.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("expected")), "wanted").filter("expected > 0")
    hits = near.join(v, "vec_id").join(asked, "question").filter("label = wanted").groupBy("question").agg(F.count("*").alias("hits"))
    return expected.join(hits, "question", "left").select("question", F.round(F.coalesce("hits", F.lit(0)) / F.col("expected"), 9).alias("recall"))


@query("""WITH w AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 11 <> 0), v AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0),
j AS (SELECT coalesce(w.doc_id, s.doc_id) AS doc_id, w.h AS wh, s.h AS sh FROM w FULL OUTER JOIN s ON w.doc_id = s.doc_id)
SELECT action, reuse, count(*) AS n FROM (SELECT CASE WHEN sh IS NULL THEN 'insert' WHEN wh IS NULL THEN 'delete' WHEN wh = sh THEN 'keep' ELSE 'rewrite' END AS action, coalesce(v.h IS NOT NULL AND (sh IS NULL OR (wh IS NOT NULL AND wh <> sh)), false) AS reuse FROM j LEFT JOIN v ON v.h = j.wh) GROUP BY 1, 2""")
def index_sync(t: Tables) -> DataFrame:
    """The work that brings a stored index to the wanted chunks, by kind."""
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    stored = docs.filter("doc_id % 11 <> 0").withColumn("h", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("h")))
    out = S.index_sync(docs.filter("doc_id % 7 <> 0"), stored, docs.filter("doc_id % 3 = 0"), ["doc_id"], "h")
    return out.groupBy("action", "reuse").agg(F.count("*").alias("n"))


@query()
def embedding_batches(t: Tables) -> DataFrame:
    from plumbline.functions.text import estimate_tokens

    batches = S.embedding_batches(t.documents.select("doc_id", estimate_tokens(F.col("text")).alias("tokens")), "doc_id", "tokens")
    return batches.groupBy("batch").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"))


@query(f"""SELECT doc_id, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(translate(text, 'İI', 'iı')), '\\p{{L}}+')), {_LIST})) + CASE WHEN source = 'src3' THEN 100 ELSE 0 END AS BIGINT) AS score FROM documents
WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(translate(text, 'İI', 'iı')), '\\p{{L}}+')), {_LIST})) + CASE WHEN source = 'src3' THEN 100 ELSE 0 END > 0""")
def overlap_rank(t: Tables) -> DataFrame:
    ranked = S.overlap_ranking(t.documents, "doc_id", "text", TERMS, F.col("source") == "src3")
    return ranked.select("doc_id", F.col("score").cast("long").alias("score"))
