"""Search over the stored positional index: cover density, filters, fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import postings as P
from plumbline.plans.registry import Tables, query

ANY, EVERY = ["the", "thing", "and", "with", "this"], ["the", "and", "with"]
_INDEXES: dict[tuple[str, str], P.Index] = {}

#: Metadata of a chunk, made from its document: even sources are decisions with a day, the others are valid from a day on.
_META = """SELECT doc_id, text, source, CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN 'decision' ELSE 'statute' END AS category, CASE WHEN lang IN ('en', 'de') THEN 'high' ELSE 'first' END AS court_level,
 DATE '2000-01-01' + CAST((doc_id * 37) % 9000 AS INTEGER) AS doc_date, DATE '2000-01-01' + CAST((doc_id * 53) % 9000 AS INTEGER) AS valid_from, CASE WHEN doc_id % 3 > 0 THEN DATE '2000-01-01' + CAST((doc_id * 53) % 9000 + (doc_id * 13) % 3000 AS INTEGER) END AS valid_to FROM documents"""


def _meta(t: Tables) -> DataFrame:
    day = lambda n: F.date_add(F.lit("2000-01-01").cast("date"), n.cast("int"))
    start = (F.col("doc_id") * 53) % 9000
    return t.documents.select(
        "doc_id", "text", "source", F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, "decision").otherwise("statute").alias("category"), F.when(F.col("lang").isin("en", "de"), "high").otherwise("first").alias("court_level"),
        day((F.col("doc_id") * 37) % 9000).alias("doc_date"), day(start).alias("valid_from"), F.when(F.col("doc_id") % 3 > 0, day(start + (F.col("doc_id") * 13) % 3000)).alias("valid_to"),
    )


def index_of(t: Tables) -> P.Index:
    """The documents' index, written by the first query of a session that needs it."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = P.write_index(_meta(t), "doc_id", "text", ["category"])
    return _INDEXES[key]


_TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(translate(text, 'İI', 'iı')), '\\p{L}+')) AS term, generate_subscripts(regexp_extract_all(lower(translate(text, 'İI', 'iı')), '\\p{L}+'), 1) AS pos FROM documents"
_LAST = ", ".join(f"max(CASE WHEN term = '{x}' THEN pos END) OVER w AS p{i}, max(CASE WHEN term = '{x}' THEN n END) OVER w AS n{i}" for i, x in enumerate(EVERY))
_COVERS = f"""WITH t AS ({_TOKENS}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM t WHERE term IN ({", ".join(f"'{x}'" for x in EVERY)})),
l AS (SELECT doc_id, pos, n, {_LAST} FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), c AS (SELECT doc_id, pos, n, least({", ".join(f"p{i}" for i in range(len(EVERY)))}) AS p, least({", ".join(f"n{i}" for i in range(len(EVERY)))}) AS b FROM l WHERE {" AND ".join(f"p{i} IS NOT NULL" for i in range(len(EVERY)))}),
f AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM c)
SELECT doc_id, round(sum(0.1 / (1 + (pos - p) - (n - b))), 9) AS score FROM f WHERE before IS NULL OR b > before GROUP BY 1"""


@query(_COVERS)
def cover_rank(t: Tables) -> DataFrame:
    """Documents by the density of the shortest stretches that hold all words of a question."""
    return P.cover_density(index_of(t), EVERY, every=True)


def _hybrid_sql(condition: str, asked: int | None, name: str) -> str:
    allowed = f"SELECT doc_id FROM ({_META}) WHERE {condition}"
    lexical = f"SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(count(*) * 0.1, 9) AS score FROM ({_TOKENS}) WHERE term IN ({', '.join(f"'{x}'" for x in ANY)}) AND doc_id IN ({allowed}) GROUP BY 1) ORDER BY rank LIMIT 50"
    near = f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {asked})), 9)"
    vector = f" UNION ALL SELECT doc_id, rank FROM (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {near} DESC, vec_id) AS rank FROM embeddings WHERE vec_id IN ({allowed}) ORDER BY rank LIMIT 50)" if asked is not None else ""
    return f"SELECT * FROM (SELECT '{name}' AS search, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, '{'hybrid' if asked is not None else 'fulltext'}' AS mode FROM (SELECT * FROM ({lexical}){vector}) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10)"


#: Searches: filters as arguments and as SQL, and the row whose vector asks (none: no vector at hand).
_SEARCHES = {
    "decisions of a time": ({"categories": ["decision"], "date_from": "2005-01-01", "date_to": "2012-12-31"}, "category = 'decision' AND doc_date BETWEEN DATE '2005-01-01' AND DATE '2012-12-31'", 3),
    "in force on a day": ({"as_of": "2012-06-01", "court_level": "high"}, "court_level = 'high' AND CASE WHEN category = 'decision' THEN doc_date <= DATE '2012-06-01' ELSE valid_from <= DATE '2012-06-01' AND (valid_to IS NULL OR valid_to > DATE '2012-06-01') END", 7),
    "no vector": ({"categories": ["statute"], "date_from": "2020-01-01"}, "category = 'statute'", None),
}


@query(" UNION ALL ".join(_hybrid_sql(sql, asked, name) for name, (_, sql, asked) in _SEARCHES.items()))
def filtered_hybrid(t: Tables) -> DataFrame:
    """Hybrid searches whose filters hold below both rankings, and one without a vector."""
    index, meta, found = index_of(t), _meta(t), []
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    for name, (filters, _, asked) in _SEARCHES.items():
        vector = vectors.filter(F.col("doc_id") == asked).first() if asked is not None else None
        found.append(P.hybrid(index, vectors, "embedding", P.allowed_rows(meta, **filters), ANY, vector and vector["embedding"]).withColumn("search", F.lit(name)))
    return reduce(DataFrame.unionByName, found)
