"""Rules over records: job states, usage, totals, ratios, date filters, sessions, merged orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.intervals import in_interval


def job_states(children: DataFrame, job: str, status: str, states: list[str]) -> DataFrame:
    """job, files, a count of each of ``states`` and the job's status: running while a child is queued
    or running, then failed if any child failed, else completed. A null status counts as a file only."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in states]
    open_, failed = F.bool_or(F.col(status).isin("queued", "running")), F.bool_or(F.col(status) == "failed")
    state = F.when(open_, "running").when(failed, "failed").otherwise("completed")
    return children.groupBy(job).agg(F.count("*").alias("files"), *counts, state.alias("status"))


def usage(calls: DataFrame, by: list[str], tokens: list[str], cost: str) -> DataFrame:
    """Sums of tokens (null as 0) and of known costs; the cost is null where none is known."""
    return calls.groupBy(*by).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in tokens], F.sum(cost).alias(cost))


def running_totals(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """df with ``total_<column>``: sums over the key's rows up to each one. ``order`` tells rows apart."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"total_{c}": F.sum(c).over(w) for c in columns})


def parsed_ratio(snapshots: DataFrame, notes: DataFrame, key: str, parsed: Column) -> DataFrame:
    """key, parsed, unparsed, ratio of each snapshot's notes; the ratio is 1.0 without notes."""
    counts = notes.groupBy(key).agg(F.count_if(parsed).alias("parsed"), F.count_if(~F.coalesce(parsed, F.lit(False))).alias("unparsed"))
    out = snapshots.select(key).join(counts, key, "left").fillna(0, ["parsed", "unparsed"])
    ratio = F.bround(F.coalesce(F.try_divide(F.col("parsed"), F.col("parsed") + F.col("unparsed")), F.lit(1.0)), 4)
    return out.withColumn("ratio", ratio)


def dated(df: DataFrame, decision: Column, as_of: Column | None = None, date_from: Column | None = None, date_to: Column | None = None) -> DataFrame:
    """Rows in force: on ``as_of`` decisions are there from ``doc_date`` on, others within
    [valid_from, valid_to); ``date_from`` and ``date_to`` bound decisions only. A decision without a date
    passes none of these, nor does another row without a start pass ``as_of``."""
    if as_of is not None:
        df = df.filter((decision & (F.col("doc_date") <= as_of)) | (~decision & F.col("valid_from").isNotNull() & in_interval(as_of, F.col("valid_from"), F.col("valid_to"))))
    if date_from is not None:
        df = df.filter(~decision | (F.col("doc_date") >= date_from))
    if date_to is not None:
        df = df.filter(~decision | (F.col("doc_date") <= date_to))
    return df


def live_sessions(sessions: DataFrame, users: DataFrame, user: str, now: Column) -> DataFrame:
    """Sessions that are neither revoked nor expired, of active users (users: user, is_active)."""
    live = sessions.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    return live.join(users.filter("is_active").select(user), user, "left_semi")


def merged_order(lists: DataFrame, item: str, newest: str, position: str) -> DataFrame:
    """item, newest, position: each item's place in the newest list that holds it.

    Ordered by newest descending, then position, that is the newest list followed by what only older
    ones hold, newer lists first.
    """
    best = F.min(F.struct((-F.col(newest)).alias("n"), F.col(position).alias("p")))
    return lists.groupBy(item).agg(best.alias("x")).select(item, (-F.col("x.n")).alias(newest), F.col("x.p").alias(position))
