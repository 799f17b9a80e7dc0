"""Point-in-time queries: intervals from orders, snapshots from two dates, version chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import intervals as I
from plumbline.operators import links as L
from plumbline.plans.registry import Tables, query
from plumbline.session import shared_dir
from plumbline.streaming import events as S

#: Customers' orders as versions: each lasts until the next; orders of status P have no known text (a gap), F is repealed.
_SPANS = """SELECT o_custkey, CAST(o_orderdate AS DATE) AS valid_from, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to, o_orderkey, o_orderstatus FROM orders"""


def _spans(t: Tables) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    w = F.lead("day").over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey"))
    return orders.withColumn("valid_from", F.col("day")).withColumn("valid_to", w).filter("valid_to is null or valid_from < valid_to")


@query(f"""WITH s AS (SELECT * FROM ({_SPANS}) WHERE valid_to IS NULL OR valid_from < valid_to), q AS (SELECT c_custkey AS k, DATE '1998-06-01' AS day FROM customer),
h AS (SELECT k, arg_min(o_orderkey, valid_from) AS o, arg_min(o_orderstatus, valid_from) AS st FROM q JOIN s ON s.o_custkey = q.k AND s.o_orderstatus <> 'P' AND valid_from <= day AND (valid_to IS NULL OR day < valid_to) GROUP BY 1),
g AS (SELECT DISTINCT k FROM q JOIN s ON s.o_custkey = q.k AND s.o_orderstatus = 'P' AND valid_from <= day AND (valid_to IS NULL OR day < valid_to)),
a AS (SELECT DISTINCT o_custkey AS k FROM s)
SELECT q.k AS o_custkey, h.o AS o_orderkey, CASE WHEN h.st = 'F' THEN 'not_in_force' WHEN h.k IS NOT NULL THEN 'found' WHEN g.k IS NOT NULL THEN 'gap' WHEN a.k IS NOT NULL THEN 'not_in_force' ELSE 'unknown' END AS status
FROM q LEFT JOIN h USING (k) LEFT JOIN g USING (k) LEFT JOIN a USING (k)""")
def as_of_status(t: Tables) -> DataFrame:
    spans = _spans(t)
    versions = spans.filter("o_orderstatus <> 'P'").select("o_custkey", "valid_from", "valid_to", (F.col("o_orderstatus") == "F").alias("repealed"), "o_orderkey")
    gaps = spans.filter("o_orderstatus = 'P'").select("o_custkey", F.col("valid_from").alias("gap_from"), F.col("valid_to").alias("gap_to"))
    asked = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.lit("1998-06-01").cast("date").alias("day"))
    return I.as_of(asked, versions, gaps, "o_custkey", "day").select("o_custkey", F.col("version.o_orderkey").alias("o_orderkey"), "status")


@query("""WITH p AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 60 AS b FROM orders), n AS (SELECT *, lead(a) OVER (PARTITION BY o_custkey ORDER BY a, b, o_orderkey) AS next_from FROM p)
SELECT o_custkey, count(*) AS overlaps FROM n WHERE next_from < b GROUP BY 1""")
def interval_overlap(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    periods = t.orders.select("o_custkey", day.alias("valid_from"), F.date_add(day, 60).alias("valid_to"))
    return I.overlapping_neighbours(periods, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("overlaps"))


_SNAPSHOT = "SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderdate < DATE '{}' GROUP BY 1"


def _snapshot(t: Tables, day: str) -> DataFrame:
    return t.orders.filter(F.col("o_orderdate") < F.lit(day).cast("timestamp_ntz")).groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("v"))


@query(f"""WITH a AS ({_SNAPSHOT.format("1997-01-01")}), b AS (SELECT * FROM ({_SNAPSHOT.format("2000-01-01")}) WHERE o_custkey % 10 <> 0)
SELECT CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'changed' END AS kind, count(*) AS n FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey GROUP BY 1""")
def snapshot_diff(t: Tables) -> DataFrame:
    new = _snapshot(t, "2000-01-01").filter("o_custkey % 10 <> 0")
    return I.snapshot_diff(_snapshot(t, "1997-01-01"), new, "o_custkey", "v").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH a AS ({_SNAPSHOT.format("1997-01-01")}), b AS ({_SNAPSHOT.format("2000-01-01")}), j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.v AS ov, b.v AS nv, a.o_custkey IS NOT NULL AS o, b.o_custkey IS NOT NULL AS n FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey)
SELECT o_custkey, ov AS v, TIMESTAMP '1997-01-01' AS recorded_at, CASE WHEN n AND ov = nv THEN NULL ELSE TIMESTAMP '2000-01-01' END AS superseded_at FROM j WHERE o
UNION ALL SELECT o_custkey, nv, TIMESTAMP '2000-01-01', NULL FROM j WHERE n AND NOT (o AND ov = nv)""")
def scd2_publish(t: Tables) -> DataFrame:
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    live = _snapshot(t, "1997-01-01").withColumn("recorded_at", stamp("1997-01-01")).withColumn("superseded_at", F.lit(None).cast("timestamp_ntz"))
    return I.publish(live, _snapshot(t, "2000-01-01"), "o_custkey", "v", stamp("2000-01-01"))


@query("""WITH y AS (SELECT o_custkey, CAST(date_trunc('year', o_orderdate) AS DATE) AS snapshot, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS text FROM orders GROUP BY 1, 2),
l AS (SELECT *, lag(text) OVER w AS before, lag(snapshot) OVER w AS last FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY snapshot)), s AS (SELECT * FROM l WHERE before IS NULL OR before <> text)
SELECT o_custkey, 'version' AS kind, CAST(snapshot AS VARCHAR) AS valid_from, CAST(lead(last) OVER (PARTITION BY o_custkey ORDER BY snapshot) AS VARCHAR) AS valid_to, text, CASE WHEN before IS NULL THEN 'original' ELSE 'amended' END AS reason FROM s
UNION ALL SELECT o_custkey, 'gap', CAST(last AS VARCHAR), CAST(snapshot AS VARCHAR), NULL, 'changed' FROM s WHERE before IS NOT NULL""")
def timeline_build(t: Tables) -> DataFrame:
    """Versions and gaps of each customer's priority over yearly snapshots."""
    years = t.orders.groupBy("o_custkey", F.trunc("o_orderdate", "year").alias("snapshot")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("text"))
    day = lambda c: F.col(c).cast("string").alias(c)
    return I.timeline(years, "o_custkey").select("o_custkey", "kind", day("valid_from"), day("valid_to"), "text", "reason")


@query("""SELECT l.l_orderkey, l.l_linenumber, coalesce(e.d, a.d) AS effective, CASE WHEN e.d IS NOT NULL THEN 'exception' WHEN a.d IS NOT NULL THEN 'act' ELSE 'unknown' END AS basis FROM lineitem l
LEFT JOIN (SELECT p_partkey, p_size AS d FROM part WHERE p_size > 5) a ON a.p_partkey = l.l_partkey LEFT JOIN (SELECT l_partkey AS p, l_suppkey AS s, max(l_linenumber) AS d FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2) e ON e.p = l.l_partkey AND e.s = l.l_suppkey""")
def exception_override(t: Tables) -> DataFrame:
    items = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("act"), F.col("l_suppkey").alias("part"))
    acts = t.part.filter("p_size > 5").select(F.col("p_partkey").alias("act"), F.col("p_size").alias("effective"))
    exceptions = t.lineitem.filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("act"), F.col("l_suppkey").alias("part")).agg(F.max("l_linenumber").alias("effective"))
    return I.exception_dates(items, acts, exceptions, "act", "part").select("l_orderkey", "l_linenumber", "effective", "basis")


@query("""SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part n WHERE n.p_partkey - 10 = p.p_partkey AND n.p_partkey // 100 = p.p_partkey // 100)""")
def newest_version(t: Tables) -> DataFrame:
    """Parts that no part ten keys further on (within a block of 100) supersedes."""
    previous = t.part.select((F.col("p_partkey") - 10).alias("p_partkey"), F.floor(F.col("p_partkey") / 100).alias("b")).filter("floor(p_partkey / 100) = b and p_partkey >= 0").select("p_partkey")
    return t.part.join(previous, "p_partkey", "left_anti").select("p_partkey")


@query("""WITH RECURSIVE v AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 100 >= 10 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey - 10) THEN p_partkey - 10 END AS p FROM part p),
w AS (SELECT n, n AS root, 0 AS depth FROM v WHERE p IS NULL UNION ALL SELECT v.n, w.root, w.depth + 1 FROM v JOIN w ON v.p = w.n) SELECT n AS p_partkey, root, depth FROM w""")
def version_chain(t: Tables) -> DataFrame:
    keys = t.part.select("p_partkey", F.when(F.col("p_partkey") % 100 >= 10, F.col("p_partkey") - 10).alias("previous"))
    there = t.part.select(F.col("p_partkey").alias("previous"), F.lit(True).alias("there"))
    versions = keys.join(there, "previous", "left").select("p_partkey", F.when(F.col("there"), F.col("previous")).alias("previous"))
    return I.chains(versions, "p_partkey", "previous")


_NOTES = """WITH s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d_old FROM orders)
SELECT o_custkey, count(*) AS notes FROM s JOIN (SELECT user_id, CAST(ts AS DATE) AS day FROM events) e ON e.user_id = s.o_custkey AND CAST(day - INTERVAL 25 YEAR AS DATE) > d_old AND CAST(day - INTERVAL 25 YEAR AS DATE) <= d GROUP BY 1"""


@query(_NOTES)
def notes_between(t: Tables) -> DataFrame:
    """Notes that fall after the previous snapshot and up to the next: key equality and a range."""
    day = F.to_date("o_orderdate")
    spans = t.orders.select("o_custkey", day.alias("d"), F.lag(day).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("d_old"))
    notes = t.events.select(F.col("user_id").alias("o_custkey"), F.add_months(F.to_date("ts"), -300).alias("day"))
    return spans.join(notes, "o_custkey").filter("day > d_old and day <= d").groupBy("o_custkey").agg(F.count("*").alias("notes"))


def _streamed(t: Tables, shape) -> DataFrame:
    """Run a streaming query over the events file to its end, into the shared folder."""
    spark, root = t.spark, shared_dir(t.spark, "stream")
    path = f"{t.sf_dir}/events.parquet" if _is_folder(t) else f"{t.sf_dir}/events*.parquet"
    stream = S.event_stream(spark, path, t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need it
    return S.run_once(shape(stream), f"{root}/out", f"{root}/state")


def _is_folder(t: Tables) -> bool:
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/events.parquet")
    return path.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedup(t: Tables) -> DataFrame:
    """Events once each by id, as a stream over the table twice, counted."""
    twice = lambda s: S.deduplicated(s.unionByName(s), ["event_id"], "ts", "365 days").select("event_id", "event_type")
    return _streamed(t, twice).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def stream_window(t: Tables) -> DataFrame:
    """Daily counts of the windows that the watermark has closed."""
    counts = _streamed(t, lambda s: S.windowed_counts(s, "ts", ["event_type"], "1 day", late="1 hour"))
    return counts.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS a, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
SELECT o_custkey, CAST(sum(b - a) AS BIGINT) AS gap_days, count(*) FILTER (WHERE a IS NULL) AS open_gaps FROM s WHERE o_orderstatus = 'P' AND (b IS NULL OR a < b) GROUP BY 1""")
def gap_days(t: Tables) -> DataFrame:
    """Days without a known text per customer."""
    gaps = _spans(t).filter("o_orderstatus = 'P'").select("o_custkey", F.col("valid_from").alias("gap_from"), F.col("valid_to").alias("gap_to"))
    return I.days_of_gaps(gaps, ["o_custkey"])


@query("""WITH s AS (SELECT o_custkey, o_orderstatus = 'P' AS gap, CAST(o_orderdate AS DATE) AS a, lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY a, gap) AS place FROM s WHERE b IS NULL OR a < b)
SELECT place, count(*) FILTER (WHERE gap) AS gaps, count(*) FILTER (WHERE NOT gap) AS versions FROM p GROUP BY 1""")
def interleaved_timeline(t: Tables) -> DataFrame:
    spans = _spans(t)
    rows = I.interleaved(spans.filter("o_orderstatus <> 'P'"), spans.filter("o_orderstatus = 'P'"), "o_custkey")
    counts = rows.groupBy("place").agg(F.count_if(F.col("kind") == "gap").alias("gaps"), F.count_if(F.col("kind") == "version").alias("versions"))
    return counts.select(F.col("place").cast("long").alias("place"), "gaps", "versions")


@query()
def linked_versions(t: Tables) -> DataFrame:
    """Parts that propose a predecessor within their block of 100, with the links that would branch or close refused;
    compared with links made one by one in the tests."""
    key = F.col("p_partkey")
    block = F.floor(key / 100)
    proposed = F.when(key % 9 > 0, block * 100 + F.when(block % 2 == 0, key * 7 + 3).otherwise(key * key + 3 * key + 7) % 100)
    return L.linked_chains(t.part.select("p_partkey", proposed.alias("previous")), "p_partkey", "previous")
