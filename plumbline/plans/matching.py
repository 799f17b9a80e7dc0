"""Matching and gating queries: records against jittered copies, candidates, confidence, quotes, files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.functions import text as T
from plumbline.operators import matching as M
from plumbline.operators import verification as V
from plumbline.plans.registry import Tables, query
from plumbline.sources import files

_JITTER = "CAST(ts AS DATE) + CAST(event_id % 6 AS INTEGER)"


@query(f"""WITH o AS (SELECT user_id, event_type, event_id % 50 AS g, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS p, {_JITTER} AS day FROM events WHERE event_id % 3 <> 0),
j AS (SELECT e.event_id, o.day IS NOT NULL AS there, CASE WHEN o.day IS NULL THEN 'absent' WHEN o.day = CAST(e.ts AS DATE) THEN 'match' WHEN abs(o.day - CAST(e.ts AS DATE)) <= 3 THEN 'fuzzy' ELSE 'mismatch' END AS d, e.props AS a, o.p AS b FROM events e LEFT JOIN o ON o.user_id = e.user_id AND o.event_type = e.event_type AND o.g = e.event_id % 50),
c AS (SELECT event_id, count(*) FILTER (WHERE there) AS n, count(*) FILTER (WHERE there AND d = 'match' AND a IS NOT DISTINCT FROM b) AS x, count(*) FILTER (WHERE there AND d <> 'mismatch' AND (a IS NULL OR b IS NULL OR a = b)) AS y FROM j GROUP BY 1)
SELECT CASE WHEN n = 0 THEN 'none' WHEN x = 1 THEN 'exact' WHEN y = 1 THEN 'acceptable' WHEN x > 1 OR y > 1 THEN 'ambiguous' ELSE 'mismatch' END AS verdict, count(*) AS n FROM c GROUP BY 1""")
def fuzzy_match(t: Tables) -> DataFrame:
    """Events against copies whose day is off by up to five and whose payload is sometimes missing."""
    day = F.to_date("ts")
    ours = t.events.select("event_id", "user_id", "event_type", (F.col("event_id") % 50).alias("g"), F.col("props").alias("p"), day.alias("day"))
    official = t.events.filter("event_id % 3 <> 0").select("user_id", "event_type", (F.col("event_id") % 50).alias("g"), F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("p"), F.date_add(day, (F.col("event_id") % 6).cast("int")).alias("day"))
    return M.record_matches(ours, official, "event_id", ["user_id", "event_type", "g"], ["p"], "day").groupBy("verdict").agg(F.count("*").alias("n"))


_NAME = "trim(regexp_replace(translate(lower(translate({}, 'İI', 'iı')), 'çğışöüâîû', 'cgisouaiu'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_PAGES = f"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, {_NAME.format("regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[.][^.]+$', '')")} AS stem,
{_NAME.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages)"""


def _page_keys() -> dict:
    """File stem, title and host of a page, strongest first."""
    return {"stem": T.stem_key(F.regexp_extract("url", "([^/]*)$", 1)), "title": T.name_key(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)), "host": F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)}


@query(f"""{_PAGES}, k AS (SELECT page_id, 'stem' AS reason, stem AS k FROM p UNION ALL SELECT page_id, 'title', title FROM p UNION ALL SELECT page_id, 'host', host FROM p)
SELECT page_id, reason, min(page_id) OVER w AS class_id, count(*) OVER w - 1 AS others FROM k WHERE k <> '' WINDOW w AS (PARTITION BY reason, k) QUALIFY others > 0""")
def candidate_blocking(t: Tables) -> DataFrame:
    """Pages that may be versions of each other, as classes by file stem, title and host."""
    return M.candidates_by(t.pages, "page_id", _page_keys())


@query(f"""{_PAGES} SELECT a.page_id AS subject, b.page_id, CASE WHEN a.stem = b.stem AND a.stem <> '' THEN 'stem' WHEN a.title = b.title AND a.title <> '' THEN 'title' ELSE 'host' END AS reason
FROM p a JOIN p b ON a.page_id <> b.page_id AND ((a.stem = b.stem AND a.stem <> '') OR (a.title = b.title AND a.title <> '') OR (a.host = b.host AND a.host <> '')) WHERE a.page_id % 50 = 0""")
def candidates_of_pages(t: Tables) -> DataFrame:
    """All candidates of every fiftieth page among all pages, with the strongest reason."""
    return M.candidates_of(t.pages.filter("page_id % 50 = 0"), t.pages, "page_id", _page_keys())


@query("""WITH r AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 300 THEN 'text_summary_only' END, CASE WHEN lang = 'es' THEN 'layout_unknown' END, CASE WHEN n_chars % 3 = 0 THEN 'date_from_closing' END, CASE WHEN source = 'src1' THEN 'statute_unmapped:x' END], lambda x: x IS NOT NULL) AS w FROM documents),
f AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('text_summary_only', 'layout_unknown'))) AS low, len(w) AS n FROM r)
SELECT doc_id, CAST(greatest(0, 100 - low * 60 - (n - low) * 25) AS BIGINT) AS score, CASE WHEN low > 0 THEN 'low' WHEN n > 0 THEN 'medium' ELSE 'high' END AS band FROM f""")
def confidence(t: Tables) -> DataFrame:
    flags = F.array(F.when(F.col("n_chars") < 300, "text_summary_only"), F.when(F.col("lang") == "es", "layout_unknown"), F.when(F.col("n_chars") % 3 == 0, "date_from_closing"), F.when(F.col("source") == "src1", "statute_unmapped:x"))
    score, band, _ = M.confidence(F.filter(flags, lambda x: x.isNotNull()))
    return t.documents.select("doc_id", score.cast("long").alias("score"), band.alias("band"))


_SPACE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT doc_id AS point, doc_id + unnest([0, 1]) AS doc_id, string_split(text, chr(10))[-1] AS quote FROM documents),
f AS (SELECT point, p.doc_id, CASE WHEN d.doc_id IS NULL THEN 'unread' WHEN d.lang = 'es' THEN 'not_in_force' WHEN NOT contains({_SPACE.format("d.text")}, {_SPACE.format("p.quote")}) THEN 'not_quoted' ELSE 'kept' END AS fate FROM p LEFT JOIN documents d ON d.doc_id = p.doc_id)
SELECT point, doc_id, fate, max(CASE WHEN fate = 'kept' THEN true ELSE false END) OVER (PARTITION BY point) AS stands FROM f""")
def quote_gate(t: Tables) -> DataFrame:
    """Each document's last line, cited from the document itself and from the next one."""
    quote = F.element_at(F.split("text", "\n"), -1)
    points = t.documents.select(F.col("doc_id").alias("point"), quote.alias("quote"), F.explode(F.array(F.lit(0), F.lit(1))).alias("step")).withColumn("doc_id", F.col("point") + F.col("step"))
    sources = t.documents.select("doc_id", "text", (F.col("lang") != "es").alias("in_force"))
    return M.citation_gate(points, sources, "point", "doc_id", "quote").select("point", "doc_id", "fate", "stands")


@query("""SELECT page_id, CASE WHEN html LIKE '%PDF%' AND starts_with(html, '%PDF') THEN 'pdf' WHEN starts_with(ltrim(lower(html)), '<!doctype html') OR contains(lower(substr(html, 1, 1000)), '<html') THEN 'html' WHEN length(html) > 0 THEN 'text' ELSE 'unknown' END AS found FROM pages""")
def file_sniff(t: Tables) -> DataFrame:
    return t.pages.select("page_id", files.content_type(F.col("html").cast("binary")).alias("found"))


@query("""SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1""")
def host_counts(t: Tables) -> DataFrame:
    return t.pages.groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"))


@query()
def url_links(t: Tables) -> DataFrame:
    return files.page_links(t.pages)


@query("""WITH r AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations)
SELECT conv_id, turn, length(substr(text, 1, CAST(600 - b AS BIGINT))) AS kept FROM r WHERE b < 600""")
def read_budget(t: Tables) -> DataFrame:
    """Passages cut so that a source holds 600 characters."""
    return M.read_up_to(t.conversations, "conv_id", "turn", "text", 600).select("conv_id", "turn", F.length("text").cast("long").alias("kept"))


@query("""SELECT conv_id, count(DISTINCT role) AS roles, string_agg(DISTINCT role, ',' ORDER BY role) AS passages, bool_or(turn >= 5) AS complete FROM conversations GROUP BY 1""")
def merged_reads(t: Tables) -> DataFrame:
    reads = t.conversations.select("conv_id", F.col("role").alias("passage"), (F.col("turn") >= 5).alias("complete"))
    return M.merged_sources(reads, "conv_id").select("conv_id", F.size("passages").cast("long").alias("roles"), F.array_join("passages", ",").alias("passages"), "complete")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'P' THEN 'verified_exact' WHEN o_orderstatus = 'P' THEN 'not_in_source' ELSE 'mismatch' END AS status FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders)""")
def verification_status(t: Tables) -> DataFrame:
    """A verified order keeps its status when a later check does not find it."""
    old = F.when(F.col("o_orderpriority").startswith("1"), "verified_exact").otherwise("unverified")
    new = F.when(F.col("o_orderstatus") == "P", "not_in_source").otherwise("mismatch")
    return t.orders.select("o_orderkey", M.downgraded(old, new).alias("status"))


@query("""SELECT doc_id, CAST(len(list_intersect(m, c)) AS DOUBLE) / len(m) AS score FROM (SELECT doc_id, ['the', 'of', 'and'] AS m, list_distinct(regexp_extract_all(lower(translate(text, 'İI', 'iı')), '\\p{L}+')) AS c FROM documents)""")
def answer_scores(t: Tables) -> DataFrame:
    cited = F.array_distinct(T.letter_tokens(F.col("text")))
    return t.documents.select("doc_id", M.answer_score(cited, F.array(F.lit("the"), F.lit("of"), F.lit("and"))).alias("score"))


@query("""WITH a AS (SELECT conv_id, list(turn) FILTER (WHERE role = 'assistant') AS cited, list(turn) FILTER (WHERE turn <= 4) AS seen, count(*) FILTER (WHERE role = 'assistant' AND turn <= 6) AS stated FROM conversations GROUP BY 1),
b AS (SELECT conv_id, coalesce(cited, []) AS cited, coalesce(seen, []) AS seen, stated FROM a)
SELECT conv_id, concat_ws(',', CASE WHEN len(list_filter(cited, lambda x: NOT list_contains(seen, x))) > 0 THEN 'cites_unread' END, CASE WHEN stated <> len(list_distinct(cited)) THEN 'count_differs' END) AS problems FROM b""")
def answer_integrity(t: Tables) -> DataFrame:
    """Conversations whose assistant turns go beyond the turns read, or are miscounted."""
    said = F.col("role") == "assistant"
    answers = t.conversations.groupBy("conv_id").agg(F.collect_list(F.when(said, F.col("turn"))).alias("cited"), F.collect_list(F.when(F.col("turn") <= 4, F.col("turn"))).alias("seen"), F.count_if(said & (F.col("turn") <= 6)).alias("stated"))
    return M.integrity(answers, "cited", "seen", "stated").select("conv_id", F.array_join("problems", ",").alias("problems"))


@query("""WITH f AS (SELECT CASE WHEN n_chars % 4 = 0 THEN NULL ELSE lang END AS kind, CASE source WHEN 'src0' THEN 'en' WHEN 'src1' THEN 'de' END AS folder, n_chars > 8000 AS r FROM documents), g AS (SELECT kind, coalesce(kind, folder) AS k, r FROM f)
SELECT CASE WHEN r AND k IS NOT NULL THEN 'long' ELSE k END AS kind, CASE WHEN r AND k IS NOT NULL AND k <> 'long' THEN 'retyped' WHEN kind IS NULL AND k IS NOT NULL THEN 'from_folder' WHEN k IS NULL THEN 'unknown' ELSE 'kept' END AS filled, count(*) AS n FROM g GROUP BY 1, 2""")
def type_backfill(t: Tables) -> DataFrame:
    folder = F.create_map(F.lit("src0"), F.lit("en"), F.lit("src1"), F.lit("de"))[F.col("source")]
    docs = t.documents.withColumn("kind", F.when(F.col("n_chars") % 4 != 0, F.col("lang")))
    return M.backfilled(docs, "kind", folder, F.col("n_chars") > 8000, "long").groupBy("kind", "filled").agg(F.count("*").alias("n"))


@query()
def quote_places(t: Tables) -> DataFrame:
    """Where a document's second line stands in it; no place without one."""
    from plumbline.operators.parsing import located

    quote = F.get(F.split("text", "\n"), 1)
    return located(t.documents.withColumn("quote", quote), "text", "quote").select("doc_id", "char_start", "char_end")


# Orders are decisions; the source lacks orders divisible by 7, shows the case of others with zeros and a division, dates of
# every fifth shifted, an unreadable date for every 23rd, another chamber for every 13th, and every 11th twice.
_OURS = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % 20 + 1 AS VARCHAR) || ' HD' AS chamber, o_orderkey % 3 = 0 AS divided FROM orders"


@query(f"""WITH o AS ({_OURS}), s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE day + CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 6 ELSE 0 END AS INTEGER) END AS day, CASE WHEN o_orderkey % 13 = 0 THEN 'HGK' ELSE chamber END AS chamber FROM o WHERE o_orderkey % 7 > 0),
f AS (SELECT o.o_orderkey, CASE WHEN s.chamber = o.chamber THEN 'match' ELSE 'mismatch' END AS chamber, CASE WHEN s.day IS NULL THEN 'mismatch' WHEN s.day = o.day THEN 'match' WHEN abs(s.day - o.day) <= 3 THEN 'fuzzy' ELSE 'mismatch' END AS d, o.o_orderkey % 11 = 0 AS twice, year(o.day) <= 1997 AS old FROM o JOIN s USING (o_orderkey))
SELECT o.o_orderkey, CASE WHEN f.o_orderkey IS NULL THEN 'not_in_source' WHEN f.chamber = 'mismatch' OR d = 'mismatch' OR twice THEN 'mismatch' ELSE 'verified' END AS verdict, f.chamber, d AS decision_date, coalesce(twice AND f.chamber = 'match' AND d <> 'mismatch', false) AS ambiguous FROM o LEFT JOIN f USING (o_orderkey)""")
def official_matches(t: Tables) -> DataFrame:
    """Orders held against an official source, field by field."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    number = F.concat(F.lit("2020/"), key.cast("string"))
    chamber = (F.col("o_custkey") % 20 + 1).cast("string")
    ours = t.orders.select(key, number.alias("esas_no"), number.alias("karar_no"), F.concat(chamber, F.lit(". Hukuk Dairesi")).alias("chamber"), F.lit(None).cast("string").alias("bam_region"), day.alias("decision_date"))
    shifted = F.when(key % 23 > 0, F.date_add(day, F.when(key % 5 == 0, key % 6).otherwise(0).cast("int")))
    shown = F.when(key % 3 == 0, F.concat(F.lit("2020/10-00"), key.cast("string"))).otherwise(number)
    body = F.when(key % 13 == 0, "Hukuk Genel Kurulu").otherwise(F.concat(F.lit("YARGITAY "), chamber, F.lit(". HD")))
    source = t.orders.filter(key % 7 > 0).select(F.explode(F.when(key % 11 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("copy"), key, shown.alias("esas_no"), number.alias("karar_no"), body.alias("chamber"), shifted.alias("decision_date"))
    source = source.withColumn("ref", F.concat_ws("-", F.col("o_orderkey").cast("string"), "copy"))
    return V.field_vectors(ours, source, "o_orderkey").select("o_orderkey", "verdict", "chamber", "decision_date", "ambiguous")


@query(r"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey AS n, l_linenumber % 4 AS f, l_suppkey AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE f WHEN 0 THEN n || '/A' WHEN 1 THEN 'Ek ' || n WHEN 2 THEN 'Geçici ' || n || ' (' || s || ')' ELSE n || '. madde' END AS article, CASE f WHEN 0 THEN n || ' HD' WHEN 1 THEN n || ' D' WHEN 2 THEN 'HGK' ELSE 'kurul ' || n END AS chamber FROM s""")
def canonical_names(t: Tables) -> DataFrame:
    """Spellings of articles and chambers, made from order lines, in their canonical form."""
    n, s, form = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber") % 4
    article = F.when(form == 0, F.concat(n, F.lit("-a"))).when(form == 1, F.concat(F.lit("EK_"), n)).when(form == 2, F.concat(F.lit(" gecici-"), n, F.lit("-"), s)).otherwise(F.concat(n, F.lit(".  madde")))
    chamber = F.when(form == 0, F.concat(F.lit("Yargıtay "), n, F.lit(". Hukuk Dairesi"))).when(form == 1, F.concat(n, F.lit(".D."))).when(form == 2, F.lit("YARGITAY HUKUK GENEL KURULU")).otherwise(F.concat(F.lit("Kurul-"), n))
    return t.lineitem.select("l_orderkey", "l_linenumber", N.article_number(article).alias("article"), N.canonical_chamber(chamber).alias("chamber"))
