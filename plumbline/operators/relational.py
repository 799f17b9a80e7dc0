"""Latest rows, paging, counts, islands and limits: the relational base."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (end it with a unique column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def keyset_page(df: DataFrame, order: list[str], after: tuple, n: int) -> DataFrame:
    """The next ``n`` rows in descending order of ``order`` after the row with the values ``after``."""
    return df.filter(F.struct(*order) < F.struct(*[F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, after, strict=True)])).orderBy(*[F.desc(c) for c in order]).limit(n)


def offset_page(df: DataFrame, order: list[Column], skip: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(a page, the total as a one-row frame): the count is its own job, not a window over all rows."""
    return df.orderBy(*order).offset(skip).limit(n), df.agg(F.count("*").alias("total"))


def overlay(base: Column, edits: Column) -> Column:
    """Maps: edits win, null edits change nothing."""
    edits = F.map_filter(edits, lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(edits), k)), edits)


def fill_rate(df: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """field, applicable, filled, rate from (applies, is filled) conditions, in one pass."""
    sums = [F.struct(F.lit(f).alias("field"), F.count_if(a).alias("applicable"), F.count_if(a & v).alias("filled")) for f, (a, v) in fields.items()]
    rows = df.agg(F.array(*sums).alias("x")).select(F.inline("x"))
    return rows.withColumn("rate", F.coalesce(F.try_divide("filled", "applicable"), F.lit(1.0)))


def top_counts(df: DataFrame, column: Column, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.select(column.alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(1.0))


def islands(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Runs of equal states: key, run, state, first and last of order[0], rows."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(changed)
    marked = df.withColumn("_c", first).withColumn("run", F.sum("_c").over(w))
    return marked.groupBy(key, "run", state).agg(F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"), F.count("*").alias("rows"))


def stop_position(df: DataFrame, key: str, order: list[str], bad: Column, streak: int) -> DataFrame:
    """Per key the place of the row that completes ``streak`` bad rows in a row."""
    w = Window.partitionBy(key).orderBy(*order)
    recent = F.sum(bad.cast("int")).over(w.rowsBetween(-(streak - 1), 0))
    return df.withColumn("place", F.row_number().over(w)).withColumn("_s", recent).filter(F.col("_s") == streak).groupBy(key).agg(F.min("place").alias("stop_at"))


def since_last(df: DataFrame, key: str, order: list[str], done: Column) -> DataFrame:
    """Rows after each key's last row that is ``done`` (all, if none is)."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_d", F.sum(F.when(done, 1).otherwise(0)).over(w)).filter("_d = 0").drop("_d")


def within_seconds(df: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """How many rows of the key lie in the last ``seconds`` up to each row."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.count("*").over(w))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each stratum, always the same ones for a seed."""
    return top_per_key(df, [stratum], [F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), F.col(key)], n)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same rows, repetitions included."""
    only = a.exceptAll(b).select(F.lit(1)).limit(1).unionByName(b.exceptAll(a).select(F.lit(1)).limit(1))
    return only.agg((F.count("*") == 0).alias("same"))


def duplicate_keys(df: DataFrame, keys: list[str], live: Column) -> DataFrame:
    """Keys that more than one live row has."""
    return df.filter(live).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)
