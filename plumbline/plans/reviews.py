"""Review screens over events, orders and conversations."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import reviews as R
from plumbline.plans.registry import Tables, query

#: The place of the page that is asked for: midnight of 1998-01-01 in microseconds, before any id.
_MARK = base64.b64encode(b"883612800000000|0").decode()


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE event_id % 100 END AS k, CASE WHEN event_id % 4 = 0 THEN 'x' ELSE event_type END AS name FROM events""")
def typed_edits(t: Tables) -> DataFrame:
    """Edits laid over events where they have the field's type."""
    key = F.col("event_id")
    edits = F.when(key % 4 == 0, '{"k": "7", "name": "x"}').when(key % 4 == 1, "no json").when(key % 4 == 2, '{"k": null, "name": 5}').otherwise(F.col("props"))
    return t.events.select(key, R.typed_overlay(key % 100, edits, "k", "number").alias("k"), R.typed_overlay(F.col("event_type"), edits, "name", "string").alias("name"))


@query("""WITH p AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' ORDER BY n LIMIT 51)
SELECT o_orderkey, CASE WHEN (SELECT count(*) FROM p) > 50 THEN (SELECT to_base64(encode(epoch_us(o_orderdate) || '|' || o_orderkey)) FROM p WHERE n = 50) END AS next FROM p WHERE n <= 50""")
def cursor_page(t: Tables) -> DataFrame:
    """Fifty orders, newest first, after an opaque mark, with the mark of the next page."""
    return R.page_after(t.orders, "o_orderdate", "o_orderkey", _MARK, 50).select("o_orderkey", "next")


@query("""WITH f AS (SELECT DISTINCT user_id, event_type AS topic, 'k' || (event_id % 6) AS key FROM events WHERE value < 5), p AS (SELECT DISTINCT event_type AS topic, 'k' || (event_id % 6) AS key, CAST(event_id % 6 AS INTEGER) AS place FROM events),
b AS (SELECT topic, key, list_sort(list(DISTINCT ref)) AS refs FROM (SELECT topic, key, 'r' || unnest([place, place + 1]) AS ref FROM p) WHERE ref IN (SELECT 'r' || r_regionkey FROM region WHERE r_regionkey < 4) GROUP BY 1, 2)
SELECT user_id || '/' || f.topic AS "case", CAST(row_number() OVER (PARTITION BY user_id, f.topic ORDER BY place) AS INTEGER) AS number, f.key, array_to_string(coalesce(refs, []), ',') AS refs FROM f JOIN p ON p.topic = f.topic AND p.key = f.key LEFT JOIN b ON b.topic = f.topic AND b.key = f.key WHERE place <> 2""")
def clarifications(t: Tables) -> DataFrame:
    """Questions for what is unknown of each user and kind of event."""
    key = F.concat(F.lit("k"), (F.col("event_id") % 6).cast("string"))
    facts = t.events.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("case"), F.col("event_type").alias("topic"), key.alias("key"), F.when(F.col("value") < 5, "unknown").otherwise("known").alias("status"))
    template = t.events.select(F.col("event_type").alias("topic"), key.alias("key"), (F.col("event_id") % 6).cast("int").alias("place")).distinct().withColumns({"critical": F.col("place") != 2, "text": F.concat(F.lit("What is "), F.col("key"), F.lit("?"))})
    bases = template.select("topic", "key", F.explode(F.array("place", F.col("place") + 1)).alias("n")).select("topic", "key", F.concat(F.lit("r"), F.col("n").cast("string")).alias("ref"))
    sources = t.region.filter("r_regionkey < 4").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("ref"), F.col("r_name").alias("source"))
    return R.open_questions(facts, template, bases, sources).select("case", "number", "key", F.array_join("refs", ",").alias("refs"))


@query("""WITH a AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS assistants, max(turn) AS last FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1)
SELECT conv_id, concat_ws(',', CASE WHEN conv_id % 7 = 0 THEN 'repeated_fact_key' END, CASE WHEN users <> users + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END THEN 'count_differs' END, CASE WHEN 3 > turns THEN 'short_count_exceeds_points' END, CASE WHEN conv_id % 2 = 1 AND conv_id % 3 = 0 THEN 'conditional_without_missing_info' END, CASE WHEN conv_id % 2 = 0 AND conv_id % 3 > 0 THEN 'definite_with_missing_info' END,
 CASE WHEN conv_id % 2 = 0 AND conv_id % 11 = 0 THEN 'definite_on_unknown_fact' END, CASE WHEN conv_id % 2 = 0 AND conv_id % 13 = 0 THEN 'definite_with_unknown_row' END, CASE WHEN conv_id % 4 = 0 THEN 'cites_unread' END, CASE WHEN conv_id % 9 = 0 THEN 'law_text_without_day' END) AS problems FROM a""")
def answer_consistency(t: Tables) -> DataFrame:
    """Conversations as answers, with every rule that they break."""
    key, asked = F.col("conv_id"), t.conversations.filter("role in ('user', 'assistant')")
    turns = asked.groupBy("conv_id").agg(F.count("*").alias("points"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    read = F.transform("x", lambda r: r["turn"].cast("string"))
    of = lambda role: F.size(F.filter("x", lambda r: r["role"] == role))
    answers = turns.select(
        key, F.when(key % 2 == 0, "definite").otherwise("conditional").alias("status"), F.when(key % 4 == 0, F.concat(read, F.array(F.lit("other")))).otherwise(read).alias("cited"), read.alias("read"), F.transform("x", lambda r: r["role"]).alias("read_kinds"),
        F.map_from_arrays(F.array(F.lit("user"), F.lit("assistant")), F.array(of("user") + F.when(key % 5 == 0, 1).otherwise(0), of("assistant"))).alias("stated"), F.when(key % 7 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("fact_keys"),
        F.when(key % 11 == 0, F.array(F.lit("a"))).alias("unknown_facts"), F.when(key % 3 > 0, 1).alias("missing_info"), "points", F.lit(3).alias("short_points"), F.when(key % 13 == 0, 1).otherwise(0).alias("unknown_rows"), F.lit("2026-10-03").cast("date").alias("law_day"),
        F.when(key % 9 == 0, "the law").otherwise("03.10.2026 tarihinde yürürlükte olan metin").alias("law_text"),
    )
    return R.consistent(answers).select("conv_id", F.array_join("problems", ",").alias("problems"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 50 AS issue, CASE WHEN o_custkey % 50 % 2 = 0 THEN 1995 + o_custkey % 7 END AS printed, year(o_orderdate) AS y FROM orders), m AS (SELECT issue, CAST(floor(median(y)) AS INTEGER) AS med FROM r GROUP BY 1)
SELECT o_orderkey, CAST(coalesce(printed, med) AS INTEGER) AS reference, abs(y - coalesce(printed, med)) > 3 AS outside FROM r JOIN m USING (issue)""")
def issue_outliers(t: Tables) -> DataFrame:
    """Orders dated far from the year printed in their issue, or else from its median."""
    issue = F.col("o_custkey") % 50
    rows = t.orders.select("o_orderkey", issue.alias("issue"), F.when(issue % 2 == 0, 1995 + F.col("o_custkey") % 7).cast("int").alias("printed"), F.to_date("o_orderdate").alias("day"))
    return R.outside_issue(rows, "issue", "printed", "day").select("o_orderkey", "reference", "outside")


@query(r"""SELECT l_orderkey, l_linenumber, l_partkey || ' m.' || l_suppkey AS ref, CASE WHEN l_linenumber % 2 = 0 THEN 'metin metin(' || ((l_suppkey + 1000) * 10) || ').' ELSE 'metin' || ((l_suppkey + 1000) * 10) || ' metin.' END AS text FROM lineitem""")
def compared_forms(t: Tables) -> DataFrame:
    """References and wordings, made from order lines, as they are compared: without dates, courts and known markers."""
    n, s = F.col("l_partkey").cast("string"), F.col("l_suppkey")
    ref = F.concat(F.lit(" Yargıtay "), n, F.lit("  M."), s.cast("string"), F.lit(" 03.10.2026, "))
    other = ((s + 1000) * 10).cast("string")
    glued = F.concat(F.lit("metin"), other, F.lit(" metin."), s.cast("string"))
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("metin metin("), other, F.lit("). ("), s.cast("string"), F.lit(")"))).otherwise(glued)
    return t.lineitem.select("l_orderkey", "l_linenumber", T.canonical_ref(ref).alias("ref"), F.trim(T.without_markers(text, F.array(s.cast("int")))).alias("text"))
