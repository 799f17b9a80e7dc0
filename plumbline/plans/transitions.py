"""Transitions between snapshots over orders and events: the range join, boundaries, first versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import transitions as X
from plumbline.plans.registry import Tables, query

# Customers are the texts, their orders the snapshots (d_old: the order before), customers of two nations in five guess
# the day. Events 25 years back are notes; their law is the event's value, its act known for most laws.
_SPANS = """SELECT o_orderkey, o_custkey, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d_old, CAST(o_orderdate AS DATE) AS d_new, o_orderkey % 5 < 2 AS inferred FROM orders"""
_EVENTS = "SELECT user_id AS o_custkey, CAST(ts AS DATE) - INTERVAL 9000 DAY + INTERVAL (CAST(event_id * 7 % 2300 AS INTEGER)) DAY AS day, CAST(event_id % 40 AS VARCHAR) AS law, event_type = 'view' AS foot FROM events"
_ACTS = "SELECT law, day, CASE WHEN CAST(law AS INTEGER) % 13 > 0 THEN day + INTERVAL (CAST(law AS INTEGER) * 4) DAY END AS effective FROM (SELECT DISTINCT law, day FROM n WHERE CAST(law AS INTEGER) % 11 > 0)"
_EXCEPTIONS = "SELECT DISTINCT law, day, o_custkey, CASE WHEN o_custkey % 17 > 0 THEN day + INTERVAL (CAST(o_custkey % 30 AS INTEGER)) DAY END AS effective, o_custkey % 2 = 0 AS partial FROM n WHERE (CAST(law AS INTEGER) + o_custkey) % 6 = 0"


def _tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    day = F.to_date("o_orderdate")
    before = F.lag(day).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    spans = t.orders.select("o_orderkey", "o_custkey", before.alias("d_old"), day.alias("d_new"), (F.col("o_orderkey") % 5 < 2).alias("inferred")).filter("d_old < d_new")
    notes = t.events.select(F.col("user_id").alias("o_custkey"), F.date_add(F.date_sub(F.to_date("ts"), 9000), (F.col("event_id") * 7 % 2300).cast("int")).alias("day"), (F.col("event_id") % 40).cast("string").alias("law"), (F.col("event_type") == "view").alias("foot"), "event_id")
    law = F.col("law").cast("int")
    acts = notes.select("law", "day").distinct().filter(law % 11 > 0).withColumn("effective", F.when(law % 13 > 0, F.date_add("day", law * 4)))
    shift = F.when(F.col("o_custkey") % 17 > 0, F.date_add("day", (F.col("o_custkey") % 30).cast("int")))
    exceptions = notes.filter((law + F.col("o_custkey")) % 6 == 0).select("law", "day", "o_custkey", shift.alias("effective"), (F.col("o_custkey") % 2 == 0).alias("partial")).distinct()
    return spans, notes, acts, exceptions


@query(f"""WITH s AS (SELECT * FROM ({_SPANS}) WHERE d_old < d_new), n AS ({_EVENTS}), a AS ({_ACTS}), e AS ({_EXCEPTIONS}),
p AS (SELECT s.o_orderkey, s.o_custkey, s.d_old, s.d_new, s.inferred, n.day, n.law, min(n.foot) AS foot FROM s JOIN n ON n.o_custkey = s.o_custkey AND n.day > s.d_old AND n.day <= s.d_new GROUP BY ALL),
x AS (SELECT p.*, a.law IS NOT NULL AND NOT coalesce(e.law IS NOT NULL AND e.effective IS NULL, false) AND coalesce(CASE WHEN NOT e.partial THEN e.effective END, a.effective) IS NOT NULL AS known, CASE WHEN e.partial THEN 'partial' WHEN e.law IS NOT NULL THEN 'exception' ELSE 'act' END AS basis,
 coalesce(CASE WHEN NOT e.partial THEN e.effective END, a.effective) AS base, CASE WHEN e.partial THEN e.effective END AS part FROM p LEFT JOIN a ON a.law = p.law AND a.day = p.day LEFT JOIN e ON e.law = p.law AND e.day = p.day AND e.o_custkey = p.o_custkey),
d AS (SELECT o_orderkey, d FROM (SELECT o_orderkey, foot, d_old, unnest([base, part]) AS d FROM x WHERE known) WHERE d IS NOT NULL AND (NOT foot OR d > d_old)), m AS (SELECT o_orderkey, min(d) AS lo, max(d) AS hi FROM d GROUP BY 1),
f AS (SELECT o_orderkey, count(*) FILTER (WHERE NOT foot) AS notes, count(*) FILTER (WHERE NOT foot AND NOT known) AS unk, count(*) FILTER (WHERE foot AND NOT known) AS funk, count(*) FILTER (WHERE foot AND known AND greatest(base, part) > d_old) AS wider,
 count(*) FILTER (WHERE NOT foot AND known AND basis <> 'act') AS own, count(*) FILTER (WHERE NOT foot AND known AND basis = 'partial') AS parts FROM x GROUP BY 1),
j AS (SELECT s.*, coalesce(notes, 0) AS notes, lo, hi, own, parts, wider, CASE WHEN coalesce(notes, 0) = 0 THEN '{X.UNEXPLAINED}' WHEN unk > 0 THEN '{X.UNKNOWN}' WHEN funk > 0 THEN '{X.MANY}' WHEN lo <= d_old OR (hi > d_new AND NOT inferred) THEN '{X.OUTSIDE}' END AS why FROM s LEFT JOIN f USING (o_orderkey) LEFT JOIN m USING (o_orderkey)),
k AS (SELECT *, CASE WHEN why IS NULL AND lo < hi THEN CASE WHEN notes > 1 OR wider > 0 THEN '{X.MANY}' WHEN parts > 0 THEN '{X.PARTIAL}' ELSE '{X.SPLIT}' END END AS split, CAST(CASE WHEN why IS NULL THEN lo ELSE d_old + 1 END AS DATE) AS old_to, CAST(CASE WHEN why IS NULL THEN hi ELSE d_new END AS DATE) AS new_from FROM j)
SELECT o_orderkey, notes, CAST(old_to AS VARCHAR) AS old_to, CAST(new_from AS VARCHAR) AS new_from, CASE WHEN old_to < new_from THEN coalesce(why, split) END AS gap_reason, CASE WHEN why IS NOT NULL THEN 'fallback' WHEN own > 0 THEN 'exception' ELSE 'act' END AS basis,
 concat_ws(',', why, CASE WHEN why IS NULL AND own > 0 THEN '{X.EXCEPTION}' END, split) AS warnings FROM k""")
def explained_transitions(t: Tables) -> DataFrame:
    """Each span between two snapshots with its boundary days, gap, basis and warnings."""
    spans, notes, acts, exceptions = _tables(t)
    out = X.explained(spans, notes, acts, exceptions, "o_custkey", ["o_orderkey", "o_custkey"])
    return out.select("o_orderkey", "notes", F.col("old_to").cast("string").alias("old_to"), F.col("new_from").cast("string").alias("new_from"), "gap_reason", "basis", "warnings")


@query(f"""WITH s AS (SELECT * FROM ({_SPANS}) WHERE d_old < d_new), n AS ({_EVENTS}) SELECT s.o_orderkey, count(*) AS notes FROM s JOIN n ON n.o_custkey = s.o_custkey AND n.day > s.d_old AND n.day <= s.d_new GROUP BY 1""")
def notes_in_ranges(t: Tables) -> DataFrame:
    """How many notes lie in each span: the range join alone."""
    spans, notes, _, _ = _tables(t)
    return X.notes_in_spans(spans, notes, "o_custkey", "d_old", "d_new", "day").groupBy("o_orderkey").agg(F.count("*").alias("notes"))


def first_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Each customer's first order and the notes of that time."""
    _, notes, acts, exceptions = _tables(t)
    first = t.orders.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("snapshot"))
    firsts = first.select("o_custkey", "snapshot", (F.col("o_custkey") % 4 == 0).alias("added"), (F.col("o_custkey") % 9 == 0).alias("repealed"), (F.col("o_custkey") % 40).cast("string").alias("law"), F.when(F.col("o_custkey") % 3 > 0, F.date_sub("snapshot", 900)).alias("law_day"))
    acts = acts.unionByName(firsts.filter("law_day is not null and o_custkey % 5 > 0").select("law", F.col("law_day").alias("day"), F.date_add("law_day", 30).alias("effective"))).groupBy("law", "day").agg(F.min("effective").alias("effective"))
    n = notes.filter((F.col("event_id") % 50 == 0) & (F.col("o_custkey") % 8 != 3)).select("o_custkey", F.date_sub("day", 700).alias("day"), "law", F.when(F.col("event_id") % 100 == 0, "ek").otherwise("değişik").alias("kind"), F.when(F.col("event_id") % 350 == 0, "fıkra").alias("scope"), F.when(F.col("event_id") % 200 == 0, 0).otherwise(9).alias("place"))
    shifted = n.filter(F.col("law").cast("int") % 11 > 0).select("law", "day").distinct().withColumn("effective", F.when(F.col("law").cast("int") % 13 > 0, F.date_add("day", F.col("law").cast("int") * 4)))
    return firsts, n, acts.unionByName(shifted).groupBy("law", "day").agg(F.min("effective").alias("effective")), exceptions.withColumn("day", F.date_sub("day", 700))


@query()
def first_snapshot_versions(t: Tables) -> DataFrame:
    """The version of each customer's first snapshot, and the gap before it; compared with a plain version in the tests."""
    out = X.first_versions(*first_inputs(t), "o_custkey")
    return out.select("o_custkey", "notes", F.col("valid_from").cast("string").alias("valid_from"), "change_kind", "basis", F.col("gap_from").cast("string").alias("gap_from"), "gap_reason", "warnings")
