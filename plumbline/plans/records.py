"""Record-rule queries: job states, usage, totals, ratios, date filters, sessions, merged orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import records as R
from plumbline.plans.registry import Tables, query


@query("""SELECT l_orderkey, count(*) AS files, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 40) AS running, count(*) FILTER (WHERE l_returnflag = 'R') AS failed,
CASE WHEN bool_or(l_returnflag = 'N' AND l_quantity > 40) THEN 'running' WHEN bool_or(l_returnflag = 'R') THEN 'failed' ELSE 'completed' END AS status FROM lineitem GROUP BY 1""")
def job_states(t: Tables) -> DataFrame:
    """Orders as jobs of their lines: returned lines failed, large new ones still run."""
    state = F.when(F.col("l_returnflag") == "R", "failed").when((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 40), "running").otherwise("completed")
    return R.job_states(t.lineitem.select("l_orderkey", state.alias("status")), "l_orderkey", "status", ["running", "failed"])


@query("""SELECT user_id, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS tokens, round(sum(value) FILTER (WHERE event_type = 'purchase'), 2) AS cost FROM events GROUP BY 1""")
def usage_sums(t: Tables) -> DataFrame:
    """Tokens and known costs by user; only purchases have a cost."""
    calls = t.events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("cost"))
    return R.usage(calls, ["user_id"], ["tokens"], "cost").withColumn("cost", F.round("cost", 2))


@query("""SELECT o_orderkey, CAST(sum(1) OVER w AS BIGINT) AS total_orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS total_cents FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def running_totals(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", F.lit(1).alias("orders"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return R.running_totals(rows, "o_custkey", ["o_orderdate", "o_orderkey"], ["orders", "cents"]).select("o_orderkey", "total_orders", "total_cents")


@query("""SELECT c_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS parsed, count(*) FILTER (WHERE o_orderstatus <> 'F') AS unparsed,
CASE WHEN count(o_orderkey) = 0 THEN 1.0 ELSE round_even(count(*) FILTER (WHERE o_orderstatus = 'F') / count(o_orderkey), 4) END AS ratio FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def parsed_ratio(t: Tables) -> DataFrame:
    """Share of finished orders by customer, 1.0 without orders."""
    notes = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return R.parsed_ratio(t.customer, notes, "c_custkey", F.col("o_orderstatus") == "F")


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus = 'F' AS decision, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS doc_date, CAST(o_orderdate AS DATE) AS a, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS b FROM orders)
SELECT o_orderkey, decision FROM s WHERE CASE WHEN decision THEN doc_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-01' ELSE a <= DATE '1998-06-01' AND coalesce(b > DATE '1998-06-01', true) END""")
def dated_rows(t: Tables) -> DataFrame:
    """Finished orders as decisions (some without a date), others as texts in force until the next order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.to_date("o_orderdate")
    rows = t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("decision"), F.when(F.col("o_orderkey") % 7 != 0, day).alias("doc_date"), day.alias("valid_from"), F.to_date(F.lead("o_orderdate").over(w)).alias("valid_to"))
    return R.dated(rows, F.col("decision"), F.lit("1998-06-01").cast("date"), F.lit("1996-01-01").cast("date")).select("o_orderkey", "decision")


@query("""SELECT event_id FROM events JOIN customer ON c_custkey = user_id WHERE event_type <> 'error' AND ts + to_hours(CAST(event_id % 1000 AS INTEGER)) > TIMESTAMP '2024-01-20' AND c_acctbal > 0""")
def live_sessions(t: Tables) -> DataFrame:
    """Events as sessions of some hours, revoked by errors, of customers in credit."""
    hours = F.make_dt_interval(hours=(F.col("event_id") % 1000).cast("int"))
    sessions = t.events.select("event_id", "user_id", (F.col("ts") + hours).alias("expires_at"), F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"))
    users = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("is_active"))
    return R.live_sessions(sessions, users, "user_id", F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


@query("""WITH l AS (SELECT o_custkey, year(o_orderdate) AS newest, min(o_orderkey) AS position FROM orders GROUP BY 1, 2) SELECT o_custkey, newest, position FROM l QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY newest DESC) = 1""")
def merged_order(t: Tables) -> DataFrame:
    """Customers by their first order of the newest year that they bought in."""
    lists = t.orders.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("newest")).agg(F.min("o_orderkey").alias("position"))
    return R.merged_order(lists, "o_custkey", "newest", "position")


@query("""SELECT l_suppkey AS suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000""")
def union_distinct(t: Tables) -> DataFrame:
    """Suppliers of returned large lines and those in credit, once each."""
    returned = t.lineitem.filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_suppkey").alias("suppkey"))
    return returned.union(t.supplier.filter("s_acctbal > 5000").select("s_suppkey")).distinct()
