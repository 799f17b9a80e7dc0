"""Stateful streams over the whole events table, stopped and started again between its files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.registry import Tables, query
from plumbline.session import shared_dir
from plumbline.streaming import events as E
from plumbline.streaming import states as S

FILES = 3
_HOURS, _ATTEMPTS, _DAYS, _FAILS = 8, 3, 3, 4


def _restarted(t: Tables, shape, keep: str) -> DataFrame:
    """``shape`` of the events as a stream of ``FILES`` folders by time, run once after each of them has come."""
    root = shared_dir(t.spark, "states")
    rows = t.events.filter(keep).withColumn("at", F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    if first is None:
        return shape(rows)
    for i in range(FILES):
        low, high = (first + (last - first) * k / FILES for k in (i, i + 1))
        later = F.col("at") >= F.lit(low) if i else F.lit(True)
        rows.filter(later & ((F.col("at") < F.lit(high)) if i < FILES - 1 else F.lit(True))).write.mode("append").parquet(f"{root}/in")
        stream = E.event_stream(t.spark, f"{root}/in", rows.schema)
        with S.timers_allowed(t.spark):
            out = E.run_once(shape(stream), f"{root}/out", f"{root}/state")
    return out


_FOLD = f"""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'reset' ELSE 'other' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS started, 0 AS attempts, false AS failed, CAST(NULL AS TIMESTAMP) AS ended_at, 0 AS told FROM (SELECT DISTINCT user_id FROM e WHERE user_id IS NOT NULL)
UNION ALL SELECT user_id, n, CASE WHEN kind = 'reset' THEN NULL WHEN kind = 'claim' AND s IS NULL AND NOT fl THEN ts WHEN kind = 'done' THEN NULL ELSE s END, CASE WHEN kind = 'reset' OR (kind = 'done' AND s IS NOT NULL) THEN 0 WHEN kind = 'claim' AND s IS NULL AND NOT fl THEN attempts + 1 ELSE attempts END,
 CASE WHEN kind = 'reset' THEN false ELSE fl END, CASE WHEN stuck THEN started + INTERVAL {_HOURS} HOUR END, CASE WHEN stuck THEN attempts ELSE 0 END
 FROM (SELECT e.user_id, e.n, e.ts, e.kind, f.started, f.attempts, stuck, CASE WHEN stuck THEN NULL ELSE f.started END AS s, CASE WHEN stuck THEN f.attempts >= {_ATTEMPTS} ELSE f.failed END AS fl
  FROM (SELECT *, 1 AS one FROM f) f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1, LATERAL (SELECT coalesce(e.ts > f.started + INTERVAL {_HOURS} HOUR, false) AS stuck))),
last AS (SELECT user_id, started + INTERVAL {_HOURS} HOUR AS ended_at, attempts AS told FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT user_id, ended_at, CASE WHEN told >= {_ATTEMPTS} THEN 'failed' ELSE 'queued' END AS status, CAST(told AS BIGINT) AS attempts FROM (SELECT user_id, ended_at, told FROM f WHERE ended_at IS NOT NULL UNION ALL SELECT user_id, ended_at, told FROM last WHERE ended_at < (SELECT max(ts) - INTERVAL 1 HOUR FROM events))"""


@query(_FOLD)
def stuck_jobs(t: Tables) -> DataFrame:
    """Users as jobs: views and clicks claim them, purchases finish them, signups reset them."""
    kind = F.when(F.col("event_type").isin("view", "click"), "claim").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "reset").otherwise("other")
    shape = lambda s: S.stuck_jobs(s.select("user_id", "at", F.col("event_id").alias("number"), kind.alias("kind")), "user_id", minutes=60 * _HOURS, attempts=_ATTEMPTS)
    return _restarted(t, shape, "true").select("user_id", F.col("at").cast("timestamp_ntz").alias("ended_at"), "status", "attempts")


@query(f"""SELECT event_id, user_id, CASE WHEN k > ts - INTERVAL {_DAYS} DAY THEN k + INTERVAL {_DAYS} DAY END AS locked_until FROM (SELECT event_id, user_id, ts, lag(ts, {_FAILS - 1}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)""")
def failure_locks(t: Tables) -> DataFrame:
    """Each error of a user with the end of the lock that it brings."""
    shape = lambda s: S.locks(s.select("user_id", "at", F.col("event_id").alias("number")), "user_id", minutes=24 * 60 * _DAYS, most=_FAILS)
    return _restarted(t, shape, "event_type = 'error'").select(F.col("number").alias("event_id"), "user_id", F.col("locked_until").cast("timestamp_ntz").alias("locked_until"))
