"""Facts and what was in force on their day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import dimensions as D
from plumbline.plans.registry import Tables, query

_EVENTS = "SELECT event_id, user_id, CAST(ts AS DATE) - INTERVAL 9000 DAY + INTERVAL (CAST(event_id * 7 % 2300 AS INTEGER)) DAY AS day FROM events"


@query(f"""WITH e AS ({_EVENTS}), d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS since, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2)
SELECT event_id, o_orderkey FROM e ASOF LEFT JOIN d ON d.o_custkey = e.user_id AND d.since <= e.day""")
def order_in_force(t: Tables) -> DataFrame:
    """Each event with the newest order that its user had by then."""
    day = F.date_add(F.date_sub(F.to_date("ts"), 9000), (F.col("event_id") * 7 % 2300).cast("int"))
    facts = t.events.select("event_id", F.col("user_id").alias("o_custkey"), day.alias("day"))
    dims = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("since"), "o_orderkey")
    return D.in_force(facts, dims, "o_custkey", "day", "since", "o_orderkey").select("event_id", "o_orderkey")


# Order lines print a part's number or a label made from supplier and flag; labels of suppliers divisible by 5 mean one
# thing, the others what the supplier's part of that time was.
@query("""WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_partkey END AS number, l_suppkey AS s, CASE WHEN l_linenumber <> 2 THEN CAST(l_shipdate AS DATE) END AS day FROM lineitem),
d AS (SELECT l_suppkey AS s, CAST(l_shipdate AS DATE) AS since, max(l_partkey) AS statute FROM lineitem WHERE l_linenumber = 4 AND l_suppkey % 5 > 0 GROUP BY 1, 2 UNION ALL SELECT s_suppkey, DATE '0001-01-01', -1 FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 3 = 0)
SELECT l_orderkey, l_linenumber, coalesce(number, CASE WHEN f.s % 5 = 0 THEN f.s * 1000 ELSE statute END) AS statute, number IS NULL AND f.s % 5 > 0 AND statute IS NOT NULL AS inferred FROM f ASOF LEFT JOIN d ON d.s = f.s AND d.since <= f.day""")
def dated_statutes(t: Tables) -> DataFrame:
    """Numbers of abbreviations whose meaning changed over time."""
    spelled = F.concat(F.lit("S."), F.col("l_suppkey").cast("string"), F.when(F.col("l_returnflag") == "A", " - k").otherwise(" K."))
    facts = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.col("l_partkey")).alias("number"), spelled.alias("label"), F.when(F.col("l_linenumber") != 2, F.to_date("l_shipdate")).alias("day"))
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"), F.lit("k"))
    static = t.supplier.filter("s_suppkey % 5 = 0").select(name("s_suppkey").alias("label"), (F.col("s_suppkey") * 1000).alias("statute"))
    dated = t.lineitem.filter("l_linenumber = 4 and l_suppkey % 5 > 0").select(name("l_suppkey").alias("label"), F.to_date("l_shipdate").alias("since"), F.col("l_partkey").alias("statute"))
    always = t.supplier.filter("s_suppkey % 5 > 0 and s_suppkey % 3 = 0").select(name("s_suppkey").alias("label"), F.lit(None).cast("date").alias("since"), F.lit(-1).cast("long").alias("statute"))
    return D.resolved(facts, "number", "label", "day", static, dated.unionByName(always), "statute").select("l_orderkey", "l_linenumber", "statute", "inferred")
