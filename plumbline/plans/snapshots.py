"""Publishing, refreshing and queue states over orders and documents, through a published table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import snapshots as S
from plumbline.plans.registry import Tables, query
from plumbline.session import shared_dir

_stamp = lambda s: F.lit(s).cast(S.STAMP)

# Customers are records, their orders before 1998 the live versions (extraction 1 or, for customers divisible by 4, 3),
# all orders the wanted versions (extraction 2; 3 for customers divisible by 8). Reviews of customers divisible by 11 reject.
_LIVE = "SELECT o_custkey, CAST(CASE WHEN o_custkey % 4 = 0 THEN 3 ELSE 1 END AS INTEGER) AS extraction, o_orderdate, o_orderpriority FROM orders WHERE o_orderdate < DATE '1998-01-01'"
_ASKED = "SELECT o_custkey, CAST(CASE WHEN o_custkey % 8 = 0 THEN 3 ELSE 2 END AS INTEGER) AS extraction, count(*) AS n FROM orders WHERE o_custkey % 5 > 0 GROUP BY 1"


def _versions(t: Tables, orders: DataFrame) -> DataFrame:
    """Each order until the next one of its customer."""
    entry = F.struct(F.to_date("o_orderdate").alias("valid_from"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("text"))
    rows = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    until = F.transform("x", lambda v, i: F.struct(v["valid_from"].alias("valid_from"), F.get("x", i + 1)["valid_from"].alias("valid_to"), v["text"].alias("text")))
    return rows.select("o_custkey", until.alias("versions"))


def _extracted(n):
    return F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int")).cast(S.STAMP)


@query(f"""WITH l AS ({_LIVE}), v AS (SELECT o_custkey, count(*) AS old, max(extraction) AS live FROM l GROUP BY 1), a AS ({_ASKED}),
o AS (SELECT a.*, coalesce(old, 0) AS old, CASE WHEN a.o_custkey % 11 = 0 THEN 'rejected' WHEN live = extraction THEN 'unchanged' WHEN live > extraction THEN 'stale' WHEN live IS NOT NULL THEN 'superseded' ELSE 'inserted' END AS outcome FROM a LEFT JOIN v USING (o_custkey)),
r AS (SELECT o_custkey, outcome, CASE WHEN outcome IN ('superseded', 'inserted') THEN n ELSE old END AS live_rows, CASE WHEN outcome = 'superseded' THEN old ELSE 0 END AS retired_rows FROM o)
SELECT o_custkey, outcome, live_rows, retired_rows FROM r UNION ALL SELECT o_custkey, NULL, old, 0 FROM v WHERE o_custkey % 5 = 0""")
def versions_published(t: Tables) -> DataFrame:
    """Versioned records published over a live table in two commits, the second from a stale base at first."""
    path = shared_dir(t.spark, "published")
    live = _versions(t, t.orders.filter("o_orderdate < date '1998-01-01'")).select("o_custkey", F.explode("versions").alias("v"))
    extraction = F.when(F.col("o_custkey") % 4 == 0, 3).otherwise(1)
    first = live.select("o_custkey", extraction.alias("extraction"), _extracted(extraction).alias("extracted_at"), "v.*", _stamp("2021-01-01").alias("recorded_at"), F.lit(None).cast(S.STAMP).alias("superseded_at"))
    S.commit(first, path, 0)
    try:
        S.commit(first.limit(0), path, 0)  # a second publisher from the same base
        raise AssertionError("a stale base was published")
    except S.StaleBase:
        pass
    own = F.when(F.col("o_custkey") % 8 == 0, 3).otherwise(2)
    wanted = _versions(t, t.orders.filter("o_custkey % 5 > 0")).select("o_custkey", own.alias("extraction"), _extracted(own).alias("extracted_at"), F.when(F.col("o_custkey") % 11 == 0, "reject").otherwise("approve").alias("verdict"), "versions")
    number, base = S.newest(t.spark, path)
    merged, outcomes = S.merge_versions(base, wanted, "o_custkey", ["text"], _stamp("2022-01-01"))
    S.commit(merged, path, number)
    rows = S.newest(t.spark, path)[1].groupBy("o_custkey").agg(F.count_if(F.col("superseded_at").isNull()).alias("live_rows"), F.count_if(F.col("superseded_at").isNotNull()).alias("retired_rows"))
    return rows.join(outcomes, "o_custkey", "full_outer").select("o_custkey", "outcome", F.coalesce("live_rows", F.lit(0)).alias("live_rows"), F.coalesce("retired_rows", F.lit(0)).alias("retired_rows"))


# Orders are decisions; the key is customer, day and status. Orders of even customers are live already under another key.
_EDITS = "CASE WHEN o_orderkey % 10 = 3 THEN 'F' WHEN o_orderkey % 10 = 4 THEN NULL ELSE o_orderstatus END"


@query(f"""WITH w AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, {_EDITS} AS status, o_orderkey % 13 = 0 AS rejected, o_orderkey % 7 <> 0 AS analyzed FROM orders WHERE o_orderkey % 3 > 0),
l AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 = 0), r AS (SELECT *, CASE WHEN rejected THEN 'rejected' WHEN NOT analyzed THEN 'not_analyzed' WHEN status IS NULL THEN 'incomplete' END AS refused FROM w),
f AS (SELECT o_custkey, day, status, min(o_orderkey) AS first FROM r WHERE refused IS NULL GROUP BY ALL)
SELECT o_orderkey, coalesce(refused, CASE WHEN l.o_custkey IS NOT NULL OR f.first < o_orderkey THEN 'collision' END, 'published') AS outcome FROM r LEFT JOIN l ON l.o_custkey = r.o_custkey AND l.day = r.day AND l.status = r.status LEFT JOIN f ON f.o_custkey = r.o_custkey AND f.day = r.day AND f.status = r.status""")
def records_published(t: Tables) -> DataFrame:
    """Records with edits laid over them, refused where a live record or an earlier one has their key."""
    own = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("kind"))
    live = own.filter("o_orderkey % 3 = 0").drop("o_orderkey").withColumns({"recorded_at": _stamp("2021-01-01"), "superseded_at": F.lit(None).cast(S.STAMP)})
    wanted = own.filter("o_orderkey % 3 > 0").withColumns({"verdict": F.when(F.col("o_orderkey") % 13 == 0, "reject").otherwise("approve"), "status": F.when(F.col("o_orderkey") % 7 == 0, "failed").otherwise("analyzed")})
    edits = wanted.filter("o_orderkey % 10 in (3, 4)").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 3, "F").alias("set_kind"), F.when(F.col("o_orderkey") % 10 == 4, F.array(F.lit("kind"))).otherwise(F.array().cast("array<string>")).alias("cleared"))
    return S.merge_records(live, wanted, edits, "o_orderkey", ["o_custkey", "day", "kind"], ["kind"], _stamp("2022-01-01"))[1]


# Documents are live decisions of version id % 4; newer extractions have version id % 5, other texts for every third, no
# text for every seventh, and a source where the live row has none. Edits hold the text of every eleventh, its language of every sixth.
_NEWER = "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN text || ' (rev.)' ELSE text END"


@query(f"""WITH x AS (SELECT doc_id, doc_id % 4 AS v, doc_id % 5 AS nv, text, {_NEWER} AS nt, lang, CASE WHEN doc_id % 2 = 0 THEN 'xx' ELSE lang END AS nl, CASE WHEN doc_id % 9 > 0 THEN source END AS s, source AS ns, doc_id % 11 = 0 AS et, doc_id % 6 = 0 AS el FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, nt <> '' AND nt <> text AS wt, nt <> '' AND nl <> lang AS wl, nt <> '' AND s IS NULL AND ns <> '' AS ws FROM x), c AS (SELECT *, wt AND NOT et AS ct, wl AND NOT el AS cl FROM w)
SELECT doc_id, CASE WHEN nv <= v THEN 'not_newer' WHEN ct OR cl OR ws THEN 'refreshed' WHEN wt OR wl OR ws THEN 'skipped_edits' ELSE 'skipped_same' END AS outcome,
 CASE WHEN nv > v AND (ct OR cl OR ws) THEN sha256(CASE WHEN ct THEN nt ELSE text END) || CASE WHEN cl THEN nl ELSE lang END || coalesce(CASE WHEN ws THEN ns ELSE s END, '-') ELSE sha256(text) || lang || coalesce(s, '-') END AS live, CAST(CASE WHEN nv > v AND (ct OR cl OR ws) THEN 2 ELSE 1 END AS BIGINT) AS n FROM c""")
def text_refresh(t: Tables) -> DataFrame:
    """Newer extractions laid over live rows column by column, where nobody has edited them; twice, which changes nothing more."""
    docs = t.documents.filter("text is not null")
    live = docs.select("doc_id", (F.col("doc_id") % 4).cast("int").alias("version"), "text", "lang", F.when(F.col("doc_id") % 9 > 0, F.col("source")).alias("source"), _stamp("2021-01-01").alias("recorded_at"), F.lit(None).cast(S.STAMP).alias("superseded_at"))
    text = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" (rev.)"))).otherwise(F.col("text"))
    newer = docs.select("doc_id", (F.col("doc_id") % 5).cast("int").alias("version"), text.alias("text"), F.when(F.col("doc_id") % 2 == 0, "xx").otherwise(F.col("lang")).alias("lang"), "source")
    names = F.array_compact(F.array(F.when(F.col("doc_id") % 11 == 0, "text"), F.when(F.col("doc_id") % 6 == 0, "lang")))
    edited = docs.select("doc_id", names.alias("names")).filter(F.size("names") > 0)
    again = lambda rows: S.refresh(rows, newer, edited, "doc_id", "text", ["lang"], ["source"], "version", _stamp("2022-01-01"))
    once, outcomes = again(live)
    twice = again(once)[0]
    now = F.concat(F.sha2("text", 256), F.col("lang"), F.coalesce("source", F.lit("-")))
    return twice.groupBy("doc_id").agg(F.max(F.when(F.col("superseded_at").isNull(), now)).alias("live"), F.count("*").alias("n")).join(outcomes, "doc_id").select("doc_id", "outcome", "live", "n")


@query("""WITH e AS (SELECT event_id AS extraction, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events)
SELECT extraction, user_id, CASE WHEN extraction % 9 = 0 THEN 'approved' WHEN extraction % 6 = 0 THEN 'rejected' WHEN place = 1 THEN 'pending' ELSE 'superseded' END AS status FROM e""")
def queue_states(t: Tables) -> DataFrame:
    """Every extraction's state in its record's queue."""
    rows = t.events.select(F.col("event_id").alias("extraction"), "user_id", F.col("ts").alias("extracted_at"))
    return S.queue_status(rows, rows.filter("extraction % 9 = 0"), rows.filter("extraction % 6 = 0"), "user_id")
