"""Relational queries: latest rows, counts, joins, windows, paging, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.dates import year_band
from plumbline.operators import relational as R
from plumbline.plans.registry import Tables, query


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) n FROM events) WHERE n = 1""")
def latest_per_key(t: Tables) -> DataFrame:
    return R.latest_per_key(t.events, ["user_id"], [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) n FROM events WHERE event_type = 'purchase')
SELECT c.c_custkey, c.c_mktsegment, CAST(coalesce(e.value, c.c_acctbal) AS DOUBLE) AS shown_value, e.event_id AS last_edit, coalesce(e.value IS NOT NULL, false) AS edited
FROM customer c LEFT JOIN e ON e.user_id = c.c_custkey AND e.n = 1""")
def review_queue(t: Tables) -> DataFrame:
    """Customers with their latest edit laid over the base value, unedited ones included."""
    edits = R.latest_per_key(t.events.filter("event_type = 'purchase'"), ["user_id"], [F.desc("ts"), F.asc("event_id")]).select("user_id", F.col("event_id").alias("last_edit"), "value")
    rows = t.customer.join(edits, F.col("c_custkey") == F.col("user_id"), "left")
    return rows.select("c_custkey", "c_mktsegment", F.coalesce("value", "c_acctbal").alias("shown_value"), "last_edit", F.col("value").isNotNull().alias("edited"))


@query("SELECT source, lang, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source, lang")
def band_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))


@query("""WITH w AS (SELECT unnest(list_filter([CASE WHEN n_chars < 500 THEN 'short:' || lang END, CASE WHEN n_chars > 5000 THEN 'long:' || lang END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL)) AS w FROM documents)
SELECT split_part(w, ':', 1) AS value, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, value LIMIT 15""")
def reason_topk(t: Tables) -> DataFrame:
    """Warnings counted by code, details stripped."""
    codes = F.array(F.when(F.col("n_chars") < 500, F.concat(F.lit("short:"), "lang")), F.when(F.col("n_chars") > 5000, F.concat(F.lit("long:"), "lang")), F.when(F.col("lang") != "en", "foreign"))
    warned = t.documents.select(F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("w"))
    return R.top_counts(warned, F.split_part("w", F.lit(":"), F.lit(1)), 15)


@query("""SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1""")
def cross_tab(t: Tables) -> DataFrame:
    table = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)
    return table.select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


@query("""WITH d AS (SELECT d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT field, applicable, filled, CASE WHEN applicable = 0 THEN 1.0 ELSE filled / applicable END AS rate FROM (
 SELECT 'quality' AS field, count(*) AS applicable, count(quality) AS filled FROM d UNION ALL
 SELECT 'toxic', count(*) FILTER (WHERE lang = 'en'), count(toxic) FILTER (WHERE lang = 'en') FROM d UNION ALL
 SELECT 'long_text', count(*) FILTER (WHERE n_chars > 1000), count(*) FILTER (WHERE n_chars > 5000) FROM d)""")
def fill_rate(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left")
    all_, en, long = F.lit(True), F.col("lang") == "en", F.col("n_chars") > 1000
    return R.fill_rate(rows, {"quality": (all_, F.col("quality").isNotNull()), "toxic": (en, F.col("toxic").isNotNull()), "long_text": (long, F.col("n_chars") > 5000)})


@query("""WITH m AS (SELECT o_custkey, round_even(median(year(o_orderdate)), 0) AS med FROM orders GROUP BY 1)
SELECT o.o_custkey, CAST(m.med AS BIGINT) AS median_year, count(*) AS outliers FROM orders o JOIN m USING (o_custkey) WHERE abs(year(o_orderdate) - m.med) > 3 GROUP BY 1, 2""")
def year_median_outlier(t: Tables) -> DataFrame:
    """Orders more than three years from their customer's median year."""
    year = t.orders.select("o_custkey", F.year("o_orderdate").alias("y"))
    median = year.groupBy("o_custkey").agg(F.bround(F.percentile("y", F.lit(0.5))).cast("long").alias("median_year"))
    return year.join(median, "o_custkey").filter(F.abs(F.col("y") - F.col("median_year")) > 3).groupBy("o_custkey", "median_year").agg(F.count("*").alias("outliers"))


@query("""SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) AS object FROM (SELECT user_id, event_type AS k, CAST(max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS VARCHAR) AS v FROM events GROUP BY 1, 2) GROUP BY 1""")
def object_agg(t: Tables) -> DataFrame:
    """One object per user from JSON values, as sorted text."""
    pairs = t.events.select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("user_id", "event_type").agg(F.max("k").alias("k"))
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.col("k").cast("string"))))
    return pairs.groupBy("user_id").agg(F.array_join(entries, ",").alias("object"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (250000.0, 500) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50""")
def keyset_page(t: Tables) -> DataFrame:
    return R.keyset_page(t.orders.select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], (250000.0, 500), 50).select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 100""")
def offset_page(t: Tables) -> DataFrame:
    page, total = R.offset_page(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), [F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")], 100, 25)
    return page.crossJoin(F.broadcast(total)).select("o_orderkey", "o_custkey", "total")  # one row


@query("""SELECT n.n_name, r.r_name, count(*) AS orders, CAST(sum(CAST(round(o.o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2""")
def join_chain(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("""SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING' AND o.o_orderpriority = '1-URGENT'""")
def conditional_outer_join(t: Tables) -> DataFrame:
    """A left join whose condition also asks for the kind of the row."""
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_mktsegment") == "BUILDING") & (F.col("o_orderpriority") == "1-URGENT")
    return t.customer.join(t.orders, on, "left").select("c_custkey", "o_orderkey")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS has_large, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS without FROM customer""")
def exists_flags(t: Tables) -> DataFrame:
    large = t.orders.filter("o_totalprice > 300000").select("o_custkey").distinct().withColumn("has_large", F.lit(True))
    some = t.orders.select(F.col("o_custkey").alias("k")).distinct().withColumn("some", F.lit(True))
    rows = t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left").join(some, F.col("c_custkey") == F.col("k"), "left")
    return rows.select("c_custkey", F.coalesce("has_large", F.lit(False)).alias("has_large"), F.col("some").isNull().alias("without"))


@query("""SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)""")
def anti_join(t: Tables) -> DataFrame:
    bad = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return t.supplier.join(bad, "s_suppkey", "left_anti").select("s_suppkey")


@query(r"""SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' AND contains(lower(translate(p_type, 'İI', 'iı')), 'o') OR p_brand LIKE '%\%%' ESCAPE '\'""")
def text_filters(t: Tables) -> DataFrame:
    from plumbline.functions.text import lower_tr

    return t.part.filter((F.col("p_name").ilike("%a%") & lower_tr(F.col("p_type")).contains("o")) | F.col("p_brand").like(r"%\%%")).select("p_partkey", "p_name")


@query("""SELECT a.l_orderkey, a.l_linenumber, a.l_returnflag IS DISTINCT FROM b.l_returnflag AS differs FROM lineitem a LEFT JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_linenumber = 1""")
def null_safe_compare(t: Tables) -> DataFrame:
    b = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_returnflag").alias("next_flag"))
    a = t.lineitem.filter("l_linenumber = 1")
    return a.join(b, ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", (~F.col("l_returnflag").eqNullSafe(F.col("next_flag"))).alias("differs"))


@query("""SELECT l_returnflag, count(*) AS rows, min(l_quantity) AS least, max(l_quantity) AS most, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(DISTINCT l_suppkey) AS suppliers, bool_or(l_quantity > 49) AS any_large, bool_and(l_quantity > 0) AS all_positive FROM lineitem GROUP BY 1""")
def aggregates(t: Tables) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("rows"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.sum(cents).alias("cents"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.bool_or(F.col("l_quantity") > 49).alias("any_large"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"),
    )


@query("""SELECT o_custkey, array_to_string(list_transform(list_sort(list({'p': -o_totalprice, 'k': o_orderkey})), lambda x: x.k)[1:3], ',') AS best_list FROM orders GROUP BY 1""")
def best_of_group(t: Tables) -> DataFrame:
    """Each customer's three dearest orders in order."""
    top = R.top_per_key(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return top.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("best_list"))


@query("""WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT p || '->' || event_type AS change, count(*) AS n FROM e WHERE p IS NOT NULL AND p <> event_type GROUP BY 1""")
def transitions(t: Tables) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    moved = t.events.withColumn("p", before).filter(F.col("p").isNotNull() & (F.col("p") != F.col("event_type")))
    return moved.groupBy(F.concat_ws("->", "p", "event_type").alias("change")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS rows, min(ts) AS first_at, max(ts) AS last_at FROM r GROUP BY 1, 2, 3""")
def latest_state(t: Tables) -> DataFrame:
    """Runs of the same state: a repeated outcome only refreshes the run's last time."""
    return R.islands(t.events, "user_id", ["ts", "event_id"], "event_type")


@query("""WITH e AS (SELECT user_id, row_number() OVER w AS place, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, min(place) AS stop_at FROM e WHERE s = 3 GROUP BY 1""")
def error_stop(t: Tables) -> DataFrame:
    return R.stop_position(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3).select("user_id", F.col("stop_at").cast("long").alias("stop_at"))


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error'""")
def rate_limit(t: Tables) -> DataFrame:
    """Failures of the same user in the six hours up to each failure."""
    return R.within_seconds(t.events.filter("event_type = 'error'"), "user_id", "ts", 6 * 3600).select("event_id", "user_id", "recent")


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 3""")
def daily_quota(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).filter("n >= 3")


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS d FROM events)
SELECT user_id, count(*) AS open_events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM e WHERE d = 0 GROUP BY 1""")
def carry_over(t: Tables) -> DataFrame:
    """What happened to each user since the last signup."""
    rows = R.since_last(t.events, "user_id", ["ts", "event_id"], F.col("event_type") == "signup")
    return rows.groupBy("user_id").agg(F.count("*").alias("open_events"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('7' || CAST(event_id AS VARCHAR)), event_id) AS rank FROM events) SELECT event_type, rank, event_id FROM s WHERE rank <= 20""")
def stratified_sample(t: Tables) -> DataFrame:
    return R.stratified(t.events, "event_type", "event_id", 20, "7").select("event_type", F.col("rank").cast("long").alias("rank"), "event_id")


@query("""WITH n AS (SELECT o_orderkey, coalesce(o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0) AS step, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM orders)
SELECT CASE WHEN high IS NULL THEN 'first' WHEN o_orderkey < high THEN 'out_of_order' WHEN o_orderkey > high + 100 THEN 'skipped' ELSE 'next' END AS kind, count(*) AS n FROM n GROUP BY 1""")
def number_series(t: Tables) -> DataFrame:
    """Numbers out of order or skipping ahead within their series."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    high = F.max("o_orderkey").over(w)
    kind = F.when(F.col("high").isNull(), "first").when(F.col("o_orderkey") < F.col("high"), "out_of_order").when(F.col("o_orderkey") > F.col("high") + 100, "skipped").otherwise("next")
    return t.orders.withColumn("high", high).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN year(o_orderdate) <= 1996 THEN '<=1996' ELSE 'later' END AS era, o_orderstatus, count(*) AS n, CASE WHEN o_orderdate IS NULL THEN 'no date' WHEN year(o_orderdate) <= 2009 THEN '<=2009' WHEN year(o_orderdate) <= 2014 THEN '2010-14' ELSE '2015+' END AS band FROM orders GROUP BY 1, 2, 4""")
def year_bands(t: Tables) -> DataFrame:
    era = F.when(F.year("o_orderdate") <= 1996, "<=1996").otherwise("later").alias("era")
    return t.orders.groupBy(era, "o_orderstatus", year_band(F.col("o_orderdate")).alias("band")).agg(F.count("*").alias("n"))


_BUYERS = "SELECT DISTINCT o_custkey AS k FROM orders"


@query(f"""SELECT 'buyers known' AS tables, count(*) = 0 AS same FROM (({_BUYERS} EXCEPT ALL SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) UNION ALL (SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) EXCEPT ALL {_BUYERS}))
UNION ALL SELECT 'orders buyers', count(*) = 0 FROM ((SELECT o_custkey AS k FROM orders EXCEPT ALL {_BUYERS}) UNION ALL ({_BUYERS} EXCEPT ALL SELECT o_custkey FROM orders))""")
def row_set_equality(t: Tables) -> DataFrame:
    """Buyers against customers with orders (two ways to one set), and orders' customers with repetitions against without."""
    orders = t.orders.select(F.col("o_custkey").alias("k"))
    buyers = orders.distinct()
    known = t.customer.select(F.col("c_custkey").alias("k")).join(orders, "k", "left_semi")
    told = lambda name, a, b: R.same_rows(a, b).select(F.lit(name).alias("tables"), "same")
    return told("buyers known", buyers, known).unionByName(told("orders buyers", orders, buyers))


@query("""WITH a AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT l_orderkey, len(list_intersect(a.s, b.s)) AS both_sides, len(list_filter(a.s, lambda x: NOT list_contains(b.s, x))) AS only_first, len(list_distinct(list_concat(a.s, b.s))) AS either FROM a JOIN b USING (l_orderkey)""")
def set_operations(t: Tables) -> DataFrame:
    side = lambda c, name: t.lineitem.filter(c).groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias(name))
    both = side("l_returnflag = 'R'", "a").join(side("l_returnflag <> 'R'", "b"), "l_orderkey")
    size = lambda c, name: F.size(c).cast("long").alias(name)
    return both.select("l_orderkey", size(F.array_intersect("a", "b"), "both_sides"), size(F.array_except("a", "b"), "only_first"), size(F.array_union("a", "b"), "either"))


@query("""SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_live_keys(t: Tables) -> DataFrame:
    return R.duplicate_keys(t.lineitem, ["l_suppkey", "l_partkey"], F.col("l_returnflag") != "A")


@query("""SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 10 DAY) AS recent, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15' - INTERVAL 10 DAY) AS expired FROM events GROUP BY 1""")
def retention(t: Tables) -> DataFrame:
    limit = F.expr("TIMESTAMP_NTZ '2024-01-15' - INTERVAL 10 DAYS")
    return t.events.groupBy("user_id").agg(F.count_if(F.col("ts") >= limit).alias("recent"), F.count_if(F.col("ts") < limit).alias("expired"))
