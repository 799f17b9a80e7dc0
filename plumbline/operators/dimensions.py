"""Dated dimensions: the value in force on a fact's day, without multiplying either side.

Facts and dimension rows are put in one table and dealt out by ranges of (key, day), so a key with very
many rows spans several ranges and no range holds more than its share. Within a range the last
dimension row is carried forward to the facts behind it. What a range inherits is the last dimension
row of its first key in the ranges before: one row for each range, which is all that is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import lower_tr
from plumbline.session import stored


def in_force(facts: DataFrame, dims: DataFrame, key: str, day: str, since: str, value: str, ranges: int | None = None) -> DataFrame:
    """``facts`` with ``value``: that of the key's last row of ``dims`` whose ``since`` is not after the fact's day.

    Null where there is none. A dimension row without a start holds from the beginning; of several with
    the same start the largest value holds. A fact without a day or key has no value. ``ranges``: their
    number, by default the session's number of shuffle partitions. ``facts`` keep all their rows.
    """
    spark = facts.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*[F.col(c) for c in facts.columns])
    kind = dict(dims.dtypes)[value]
    known = facts.filter(F.col(key).isNotNull() & F.col(day).isNotNull())
    # a dimension row comes before the facts of its day; null starts first of all
    a = known.select(F.col(key).alias("_key"), F.col(day).cast("timestamp_ntz").alias("_day"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_value"), row.alias("_row"), F.xxhash64(row).alias("_spread"))
    b = dims.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(since).cast("timestamp_ntz").alias("_day")).agg(F.max(value).alias("_value"))
    b = b.select("_key", "_day", F.lit(0).alias("_side"), "_value", F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.lit(0).cast("long").alias("_spread"))
    order = ["_key", F.asc_nulls_first("_day"), "_side"]
    dealt = a.unionByName(b).repartitionByRange(n, *order, "_spread").withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "dimension")
    within = Window.partitionBy("_range", "_key").orderBy(F.asc_nulls_first("_day"), "_side")
    last = F.last(F.when(F.col("_side") == 0, F.struct("_value")), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    carried = dealt.withColumn("_last", last).filter("_side = 1")
    inherited = spark.createDataFrame(_inherited(dealt), f"_range int, _old struct<_value:{kind}>, _key {dict(dealt.dtypes)['_key']}")
    out = carried.join(F.broadcast(inherited), ["_range", "_key"], "left").select("_row.*", F.coalesce("_last", "_old")["_value"].alias(value))
    unknown = facts.filter(F.col(key).isNull() | F.col(day).isNull()).withColumn(value, F.lit(None).cast(kind))
    return out.unionByName(unknown)


def _inherited(dealt: DataFrame) -> list[tuple]:
    """(range, (value,), key): for each range's first key, its last dimension row in the ranges before."""
    at = F.struct(F.col("_day").isNotNull().alias("dated"), "_day")
    ends = dealt.groupBy("_range").agg(F.min("_key").alias("first"), F.max("_key").alias("last"))
    both = dealt.filter("_side = 0").join(F.broadcast(ends.select("_range", F.col("last").alias("_key"))), ["_range", "_key"], "left_semi")
    newest = {r["_range"]: (r["_key"], r["x"]) for r in both.groupBy("_range", "_key").agg(F.max_by("_value", at).alias("x")).collect()}
    out, held = [], {}
    for r in sorted(ends.collect(), key=lambda r: r["_range"]):
        if r["first"] in held:
            out.append((r["_range"], (held[r["first"]],), r["first"]))
        if r["_range"] in newest:
            held = {newest[r["_range"]][0]: newest[r["_range"]][1]}
        elif r["last"] not in held:
            held = {}
    return out


def label_key(label: Column) -> Column:
    """A printed abbreviation without spaces, dots and dashes, in lower case."""
    return F.regexp_replace(lower_tr(label), r"[\s.\-]", "")


def resolved(facts: DataFrame, number: str, label: str, day: str, static: DataFrame, dated: DataFrame, value: str, ranges: int | None = None) -> DataFrame:
    """``facts`` with ``value`` and ``inferred``: a printed number wins, then the label's only meaning, then
    the meaning that it had on the fact's day (``inferred``).

    static: label (normalised, unique), value; dated: label, since (null: from the beginning), value. A
    label of ``static`` is not looked up in ``dated``; without a day a dated label has no value.
    """
    keyed = facts.withColumn("_label", label_key(F.col(label))).join(static.select(F.col("label").alias("_label"), F.col(value).alias("_only")), "_label", "left")
    plain = F.coalesce(F.col(number), F.col("_only"))
    settled = keyed.filter(plain.isNotNull()).select(*facts.columns, plain.alias(value), F.lit(False).alias("inferred"))
    open_ = keyed.filter(plain.isNull()).select(*facts.columns, "_label")
    found = in_force(open_, dated.select(F.col("label").alias("_label"), "since", value), "_label", day, "since", value, ranges)
    return settled.unionByName(found.select(*facts.columns, value, F.col(value).isNotNull().alias("inferred")))
