"""Text queries: quality, stop words, shingles, duplicates, lines, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions import text as T
from plumbline.operators import texts as X
from plumbline.plans.registry import Tables, query

_TOKENS = "regexp_extract_all(lower(translate(text, 'İI', 'iı')), '\\p{L}+')"
_STOPS = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in C.STOP_WORDS.items()) + " ELSE [] END"
_FOLD = "trim(regexp_replace(translate(lower(translate(text, 'İI', 'iı')), 'çğışöüâîû', 'cgisouaiu'), '[^a-z0-9]+', ' ', 'g'))"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [] END"


@query(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS k, {_STOPS} AS s FROM documents) SELECT doc_id, len(k) AS tokens, CASE WHEN len(k) > 0 THEN round(len(list_filter(k, lambda x: list_contains(s, x))) / len(k), 6) END AS share FROM t""")
def stopword_ratio(t: Tables) -> DataFrame:
    counted = T.bound(T.letter_tokens(F.col("text")), lambda k: F.struct(F.size(k).cast("long").alias("tokens"), F.round(T.stop_share(k, F.col("lang")), 6).alias("share")))
    return t.documents.select("doc_id", counted.alias("x")).select("doc_id", "x.tokens", "x.share")


@query(f"""WITH m AS (SELECT doc_id, len(regexp_replace(text, '\\s', '', 'g')) AS n, len(string_split(text, chr(10))) AS pages, list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS f, {_TOKENS} AS k, {_STOPS} AS s, len(regexp_replace(text, '[^?]', '', 'g')) AS q FROM documents),
v AS (SELECT doc_id, n / pages AS per, len(list_filter(f[1:len(f) - coalesce(list_position(list_reverse(f), true), len(f) + 1)], lambda x: NOT x)) / pages AS inner_empty, len(k) AS tokens, CASE WHEN len(k) > 0 THEN round_even(len(list_filter(k, lambda x: list_contains(s, x))) / len(k), 4) ELSE 0 END AS share FROM m)
SELECT doc_id, CASE WHEN per < 50 THEN 'no_text_layer' WHEN inner_empty >= {C.PARTIAL_SHARE} THEN 'partial_text_layer' WHEN tokens >= 50 AND share < 0.03 THEN 'bad_ocr_layer' END AS reason, tokens FROM v""")
def text_quality(t: Tables) -> DataFrame:
    """Verdicts on texts, a line standing for a page."""
    measured = X.measured(t.documents, "text", F.col("lang"), "\n")
    reason, _ = X.verdict()
    return measured.select("doc_id", reason.alias("reason"), F.col("q.tokens").cast("long").alias("tokens"))


_SETS = f"SELECT {{id}}, {_SHINGLES} AS g FROM (SELECT {{id}}, string_split({_FOLD}, ' ') AS w FROM {{table}})"


@query(f"""WITH a AS (SELECT * FROM ({_SETS.format(id="item_id", table="benchmark")}) WHERE len(g) >= 10), b AS (SELECT * FROM ({_SETS.format(id="doc_id", table="documents")}) WHERE len(g) >= 10),
x AS (SELECT item_id, len(g) AS na, unnest(g) AS h FROM a), y AS (SELECT doc_id, len(g) AS nb, unnest(g) AS h FROM b)
SELECT doc_id, item_id, count(*) AS shared, round(count(*) / least(min(na), min(nb)), 6) AS score FROM x JOIN y USING (h) GROUP BY 1, 2 HAVING count(*) / least(min(na), min(nb)) >= 0.5""")
def benchmark_overlap(t: Tables) -> DataFrame:
    a = t.benchmark.select("item_id", T.shingle_hashes(F.col("text")).alias("shingles"))
    b = t.documents.select("doc_id", T.shingle_hashes(F.col("text")).alias("shingles"))
    return X.containment_pairs(b, a, "doc_id", "item_id", 0.5, 10).select("doc_id", "item_id", "shared", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT * FROM ({_SETS.format(id="doc_id", table="documents")}) WHERE len(g) >= 20), p AS (SELECT doc_id, g, lead(doc_id) OVER (ORDER BY doc_id) AS o FROM s)
SELECT p.doc_id, p.o AS other, round(len(list_intersect(p.g, s.g)) / least(len(p.g), len(s.g)), 6) AS score FROM p JOIN s ON s.doc_id = p.o""")
def shingle_containment(t: Tables) -> DataFrame:
    """Each document against the next one, by the smaller set."""
    held = t.documents.select("doc_id", "text").filter(F.size(T.shingles(F.col("text"))) >= 20)
    pairs = X.beside_next(held, "doc_id", "text", spread=t.documents)
    # A lambda's argument is evaluated once; as plain columns the sets would be built at each mention.
    sets = F.array(F.struct(T.shingles(F.col("text")).alias("g"), T.shingles(F.col("other_text")).alias("h")))
    score = F.transform(sets, lambda s: X.containment(s["g"], s["h"]))[0]
    return pairs.select("doc_id", "other", F.round(score, 6).alias("score"))


@query("""SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY text) QUALIFY copies > 1""")
def exact_dedupe(t: Tables) -> DataFrame:
    return X.exact_duplicates(t.documents, "doc_id", "text")


_LINES = f"""WITH s AS ({_SETS.format(id="doc_id", table="documents")}), d AS (SELECT doc_id, text, md5(split_part(text, chr(10), 1)) AS key, g FROM documents JOIN s USING (doc_id)),
b AS (SELECT key, arg_max(doc_id, (length(text), -doc_id)) AS best FROM d GROUP BY 1 HAVING count(*) > 1),
h AS (SELECT d.key, d.doc_id, best, length(d.text) / length(l.text) AS r, CASE WHEN len(d.g) > 0 THEN len(list_intersect(d.g, l.g)) / len(d.g) WHEN d.text = l.text THEN 1.0 ELSE 0.0 END AS s FROM d JOIN b USING (key) JOIN d l ON l.doc_id = best),
k AS (SELECT *, min(CASE WHEN s >= {C.SAME_TEXT_SHARE} AND r >= {C.SAME_LENGTH_SHARE} THEN 2 WHEN s >= {C.EXCERPT_SHARE} THEN 1 ELSE 0 END) OVER (PARTITION BY key) AS w FROM h)
SELECT key, doc_id, ['different_text', 'excerpt', 'same_text'][w + 1] AS kind, CASE WHEN w = 2 AND doc_id <> best THEN best END AS duplicate_of FROM k"""


@query(_LINES)
def dup_groups(t: Tables) -> DataFrame:
    """Documents that begin with the same line, with their group's verdict."""
    keyed = t.documents.withColumn("key", F.md5(F.substring_index("text", "\n", 1))).withColumn("day", F.lit("2024-01-01").cast("date"))
    return X.duplicate_groups(keyed, "key", "doc_id", "text", "day")


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents) SELECT doc_id, len(l) AS lines, len(list_distinct(l)) AS distinct_lines FROM l""")
def line_repetition(t: Tables) -> DataFrame:
    out = X.repeated_lines(t.documents, "doc_id", "text")
    return out.select("doc_id", F.col("lines").cast("long").alias("lines"), F.col("distinct_lines").cast("long").alias("distinct_lines"))


@query()
def chunks(t: Tables) -> DataFrame:
    """Chunks of all documents; lines are paragraphs here. Each is a slice of its text."""
    return X.chunks(t.documents, "doc_id", "text", by_line=True).select(F.col("id").alias("doc_id"), "ordinal", "char_start", "char_end", F.sha2("text", 256).alias("hash"))


@query()
def chunk_report(t: Tables) -> DataFrame:
    """Chunks, words and estimated tokens by language and source."""
    parts = X.chunks(t.documents, "doc_id", "text", by_line=True).join(t.documents.select(F.col("doc_id").alias("id"), "lang", "source"), "id")
    return parts.groupBy("lang", "source").agg(F.count("*").alias("chunks"), F.sum(T.word_count(F.col("text"))).alias("words"), F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"))


@query(f"""SELECT doc_id, md5({_FOLD}) AS folded, len(regexp_extract_all(text, '\\S+')) AS words, sha256(lang || chr(10) || chr(10) || text) AS hash FROM documents""")
def text_keys(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.md5(T.fold(c)).alias("folded"), T.word_count(c).cast("long").alias("words"), T.content_hash(F.col("lang"), c).alias("hash"))
