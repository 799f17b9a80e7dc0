"""Dependencies, holdings and metrics over the order and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import gates as G
from plumbline.plans.registry import Tables, query

# Customers are facts, their orders holdings (all), order lines points (any of their order and the next one), parts drafts
# (any of their lines), brands answers (all of their parts).
_LAYERS = """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_acctbal IS NULL THEN 0 WHEN c_acctbal < 1000 THEN 1 ELSE 2 END AS v FROM customer),
o AS (SELECT o_orderkey AS k, least(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2 END, coalesce(c.v, 0)) AS v FROM orders LEFT JOIN c ON c.k = o_custkey),
l AS (SELECT l_orderkey, l_linenumber, least(CASE WHEN max(l_quantity) > 48 THEN 0 ELSE 2 END, max(greatest(coalesce(a.v, 0), coalesce(b.v, 0)))) AS v FROM lineitem LEFT JOIN o a ON a.k = l_orderkey LEFT JOIN o b ON b.k = l_orderkey + 1 GROUP BY 1, 2),
u AS (SELECT l_partkey AS k, max(l.v) AS v FROM lineitem JOIN l USING (l_orderkey, l_linenumber) GROUP BY 1),
d AS (SELECT p_partkey AS k, p_brand, least(CASE WHEN p_size = 1 THEN 1 ELSE 2 END, coalesce(u.v, 2)) AS v FROM part LEFT JOIN u ON u.k = p_partkey)"""


@query(f"""{_LAYERS} SELECT 'order' AS kind, v AS verdict, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT 'line', v, count(*) FROM l GROUP BY ALL UNION ALL SELECT 'part', v, count(*) FROM d GROUP BY ALL UNION ALL SELECT 'brand', v, count(*) FROM (SELECT p_brand, min(v) AS v FROM d GROUP BY 1) GROUP BY ALL""")
def dependency_verdicts(t: Tables) -> DataFrame:
    """How many holdings, points, drafts and answers stand once what they need is settled."""
    name = lambda kind, *c: F.concat_ws("/", F.lit(kind), *[x if not isinstance(x, str) else F.col(x).cast("string") for x in c])
    node = lambda n, own, rule: (n.alias("node"), own.alias("own"), F.lit(rule).alias("rule"))
    line = name("line", "l_orderkey", "l_linenumber")
    facts = t.customer.select(*node(name("customer", "c_custkey"), F.when(F.col("c_acctbal").isNull(), G.DROPPED).when(F.col("c_acctbal") < 1000, G.UNKNOWN).otherwise(G.KEPT), "all"))
    orders = t.orders.select(*node(name("order", "o_orderkey"), F.when(F.col("o_orderstatus") == "P", G.DROPPED).otherwise(G.KEPT), "all"))
    lines = t.lineitem.groupBy(line.alias("node")).agg(F.max("l_quantity").alias("q")).select("node", F.when(F.col("q") > 48, G.DROPPED).otherwise(G.KEPT).alias("own"), F.lit("any").alias("rule"))
    parts = t.part.select(*node(name("part", "p_partkey"), F.when(F.col("p_size") == 1, G.UNKNOWN).otherwise(G.KEPT), "any"))
    brands = t.part.select(*node(name("brand", "p_brand"), F.lit(G.KEPT), "all")).distinct()
    nodes = facts.unionByName(orders).unionByName(lines).unionByName(parts).unionByName(brands)
    needs = t.orders.select(name("order", "o_orderkey").alias("node"), name("customer", "o_custkey").alias("on"))
    needs = needs.unionByName(t.lineitem.select(line.alias("node"), F.explode(F.array(name("order", "l_orderkey"), name("order", (F.col("l_orderkey") + 1).cast("string")))).alias("on")))
    needs = needs.unionByName(t.lineitem.select(name("part", "l_partkey").alias("node"), line.alias("on"))).unionByName(t.part.select(name("brand", "p_brand").alias("node"), name("part", "p_partkey").alias("on")))
    out = G.settled(nodes, needs).filter("node not like 'customer/%'")
    return out.groupBy(F.substring_index("node", "/", 1).alias("kind"), "verdict").agg(F.count("*").alias("n"))


_SPACE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_QUOTE = "CASE WHEN doc_id % 13 = 0 THEN 'no such words' WHEN doc_id % 9 = 0 THEN 'two words' ELSE string_split(text, chr(10))[1] END"


@query(f"""WITH d AS (SELECT doc_id, lang, source, n_chars, coalesce(text, '') AS text FROM documents), r AS (SELECT doc_id, lang, source, n_chars, text, {_QUOTE} AS quote FROM d),
s AS (SELECT *, DATE '2010-01-01' + CAST(doc_id % 4000 AS INTEGER) AS vf, CASE WHEN doc_id % 3 = 0 THEN DATE '2010-01-01' + CAST(doc_id % 4000 + 500 AS INTEGER) END AS vt FROM r)
SELECT doc_id, fate, CASE WHEN fate = 'kept' THEN CASE WHEN doc_id % 2 = 0 AND doc_id % 7 = 0 THEN 'unknown' WHEN doc_id % 2 = 0 THEN 'met' ELSE 'info' END END AS outcome FROM (SELECT doc_id, CASE WHEN source = 'src0' THEN 'unread' WHEN NOT (vf <= DATE '2015-01-01' AND (vt IS NULL OR DATE '2015-01-01' < vt)) THEN 'not_in_force'
 WHEN len(regexp_extract_all(trim(quote), '\\S+')) < 3 THEN 'short_quote' WHEN NOT contains({_SPACE.format("text")}, {_SPACE.format("quote")}) THEN 'not_quoted' WHEN doc_id % 17 = 0 THEN 'informal' ELSE 'kept' END AS fate FROM s)""")
def holding_rows(t: Tables) -> DataFrame:
    """Each document's first line as the quote of a row that rests on the document."""
    day = lambda n: F.date_add(F.lit("2010-01-01").cast("date"), n.cast("int"))
    doc, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    quote = F.when(doc % 13 == 0, "no such words").when(doc % 9 == 0, "two words").otherwise(F.split(text, "\n")[0])
    condition = F.when(doc % 17 == 0, "süre geçiyor").otherwise("süre geçmiştir")
    rows = t.documents.select(
        doc.alias("draft"), F.lit(1).alias("row"), doc.alias("source"), quote.alias("quote"), condition.alias("condition"), F.lit(None).cast("string").alias("fact_value"), F.when(doc % 2 == 0, "met").otherwise("info").alias("result"),
        F.when(doc % 7 == 0, F.array(F.lit("day"), F.lit("wage"))).otherwise(F.array(F.lit("day"))).alias("depends"), F.lit("2015-01-01").cast("date").alias("day"),
    )
    reads = t.documents.filter("source <> 'src0'").select(doc.alias("draft"), doc.alias("source"), text.alias("text"), day(doc % 4000).alias("valid_from"), F.when(doc % 3 == 0, day(doc % 4000 + 500)).alias("valid_to"))
    facts = t.documents.select(doc.alias("draft"), F.explode(F.array(F.struct(F.lit("day").alias("key"), F.lit("known").alias("status")), F.struct(F.lit("wage").alias("key"), F.lit("unknown").alias("status")))).alias("x")).select("draft", "x.*")
    return G.holdings(rows, reads, facts).select(F.col("draft").alias("doc_id"), "fate", "outcome")


@query("""WITH a AS (SELECT doc_id, lower(text) AS t, doc_id % 3 = 0 AS none, doc_id % 5 AS f, doc_id % 4 AS g, lang FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, CASE WHEN f = 0 THEN 0.0 ELSE 1.0 END AS schema, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END AS status, (CASE WHEN lang IN ('en', 'de') THEN 1 ELSE 0 END) / 2.0 AS headline, CASE WHEN g = 0 THEN 0.5 WHEN g = 1 THEN 0.0 ELSE 1.0 END AS must_cite, CASE WHEN none THEN 0.0 ELSE 0.5 END AS citation_validity,
 CASE WHEN g = 3 THEN NULL WHEN g = 2 THEN 1.0 ELSE 0.5 END AS must_ask, CASE WHEN f = 4 THEN 0.0 ELSE 1.0 END AS must_not, CASE WHEN f = 3 THEN 0.0 ELSE 1.0 END AS formal_mode, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS disclaimer FROM a)
SELECT *, round((schema + status + headline + must_cite + citation_validity + coalesce(must_ask, 0) + must_not + formal_mode + disclaimer) / CASE WHEN must_ask IS NULL THEN 8 ELSE 9 END, 9) AS total FROM (SELECT doc_id, CAST(schema AS DOUBLE) AS schema, CAST(status AS DOUBLE) AS status, CAST(headline AS DOUBLE) AS headline, CAST(must_cite AS DOUBLE) AS must_cite,
 CAST(citation_validity AS DOUBLE) AS citation_validity, CAST(must_ask AS DOUBLE) AS must_ask, CAST(must_not AS DOUBLE) AS must_not, CAST(formal_mode AS DOUBLE) AS formal_mode, CAST(disclaimer AS DOUBLE) AS disclaimer FROM m)""")
def answer_metrics(t: Tables) -> DataFrame:
    """Nine metrics of an answer made from each document, and their mean."""
    doc = F.col("doc_id")
    f, g, of = doc % 5, doc % 4, lambda *x: F.array(*map(F.lit, x))
    nothing = F.array().cast("array<string>")
    answers = t.documents.filter("text is not null").select(
        doc, (f != 0).alias("valid"), F.when(F.col("lang") == "en", "definite").otherwise("conditional").alias("status"), F.concat(F.lit("Answer in "), F.col("lang")).alias("headline"),
        F.when(f == 3, "Süre geçiyor").when(f == 4, "a Forbidden  word").otherwise("plain").alias("text"), F.when(doc % 2 == 0, "d").otherwise("x").alias("disclaimer"),
        F.when(g == 0, of("4857 m.18/1", "1 m.1")).when(g == 1, of("4857 m.19", "1 m.1")).otherwise(of("4857 m.18", "5510  m.4 f.1")).alias("refs"), F.when(doc % 3 == 0, of("b", "c")).otherwise(of("a", "b")).alias("sources"), of("a").alias("read"),
        F.when(g == 3, F.lit(None)).otherwise(of("wage")).alias("asked"), F.lit("definite").alias("want_status"), F.when(F.col("lang").isin("en", "de"), of("answer", "zz")).otherwise(of("yy", "zz")).alias("want_headline"), of("4857 m.18", "5510 m.4").alias("must_cite"),
        F.when(g == 2, nothing).otherwise(of("wage", "day")).alias("must_ask"), of("forbidden WORD").alias("must_not"),
    )
    return G.answer_metrics(answers, "d").select("doc_id", *G.METRICS, F.round("total", 9).alias("total"))
