"""A fold over ordered rows of a key that can be cut: ranges are folded side by side until their ends agree.

Rows are dealt out by ranges of (key, day), so a key with very many snapshots spans several ranges. Every
range is folded at once; what a range ends with is handed to the next one if the key goes on there, and
ranges that have been handed something new are folded again. A change inside a range makes its end
independent of what came before it, so ends settle after a few rounds; a key that never changes over m
ranges takes m rounds, each of which reads only the ranges that wait.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import attach, stored

_NONE = object()


def version_timeline(snapshots: DataFrame, key: str, changed: Callable[[str, str], bool], ranges: int | None = None) -> DataFrame:
    """key, kind, valid_from, valid_to, text, reason: versions and gaps of each key's texts in dated snapshots.

    snapshots: key, snapshot, text (null: the key is absent there). A text is held against the text that the
    running version has, by ``changed``; small drifts cannot add up unseen. A change between two snapshots
    happened on an unknown day, which is a gap. Rows without a day are left out; a null key is a key; rows
    of the same key and day are taken in the order of their texts. ``ranges``: their number, by default the
    session's number of shuffle partitions.
    """
    spark = attach(snapshots.sparkSession)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = snapshots.schema[key].dataType.simpleString()
    names = [key, "kind", "valid_from", "valid_to", "text", "reason"]
    rows = snapshots.filter(F.col("snapshot").isNotNull()).select(F.col(key).alias("k"), F.col("snapshot").cast("date").alias("day"), "text")
    dealt = stored(rows.repartitionByRange(n, "k", "day", "text").withColumn("range", F.spark_partition_id()), "fold")
    dealt = dealt.withColumns({"side": F.lit(1), "since": F.lit(None).cast("date"), "reason": F.lit(None).cast("string")})
    whole = F.struct(F.col("k").isNotNull().alias("there"), F.col("k").alias("k"))
    edges = dealt.groupBy("range").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    beside = stored(edges.select("range", "first", F.lead("first").over(Window.orderBy("range")).alias("after"), "last"), "edges")  # a row for each range
    goes_on = beside.select("range", F.col("last").eqNullSafe(F.col("after")).alias("goes_on"), "first")
    waiting = goes_on.select("range", F.lit(None).cast(f"struct<k:{kind},day:date,text:string,since:date,reason:string>").alias("given"))
    folds, held = None, waiting
    schema = f"range int, k {kind}, kind string, valid_from date, valid_to date, text string, reason string"
    while True:
        own = dealt.join(F.broadcast(waiting.select("range")), "range", "left_semi")
        begun = waiting.filter("given is not null").select("range", "given.k", "given.day", "given.text", F.lit(0).alias("side"), "given.since", "given.reason")
        both = own.unionByName(begun).repartition("range").sortWithinPartitions("range", "side", "k", "day", "text").select("range", "k", "day", "text", "side", "since", "reason")
        new = stored(both.mapInArrow(lambda batches: _fold(batches, changed), schema), "fold")
        folds = new if folds is None else stored(folds.join(F.broadcast(waiting.select("range")), "range", "left_anti").unionByName(new), "folds")
        ends = folds.filter("kind = 'end'").select("range", F.struct("k", F.col("valid_to").alias("day"), "text", F.col("valid_from").alias("since"), "reason").alias("end"))
        passed = goes_on.join(ends, "range", "left").select("range", F.lag(F.when(F.col("goes_on"), F.col("end"))).over(Window.orderBy("range")).alias("given"))
        passed = stored(passed, "ends")
        waiting = stored(passed.join(held.withColumnRenamed("given", "_old"), "range").filter(~F.col("given").eqNullSafe(F.col("_old"))).select("range", "given"), "waiting")
        held = passed
        if waiting.isEmpty():
            break
    out = folds.join(F.broadcast(goes_on.select("range", "goes_on")), "range")
    out = out.filter("kind in ('version', 'gap') or (kind = 'open' and not goes_on)").withColumn("kind", F.when(F.col("kind") == "open", "version").otherwise(F.col("kind")))
    return out.select(F.col("k").alias(key), *names[1:])


def _fold(batches: Iterator[pa.RecordBatch], changed: Callable[[str, str], bool]) -> Iterator[pa.RecordBatch]:
    """Finished versions and gaps of each range; its last running version as ``open``, its last state as ``end``."""
    where, name, since, held, reason, last, seen = None, _NONE, None, None, None, None, False
    names = ["range", "k", "kind", "valid_from", "valid_to", "text", "reason"]
    schema = None

    def end() -> list[tuple]:
        if name is _NONE:
            return []
        return [(where, name, "open", since, None, held, reason)] * (since is not None) + [(where, name, "end", since, last, held, reason)]

    for batch in batches:
        r, k, day, text, *_ = batch.schema.types
        schema = pa.schema(list(zip(names, (r, k, pa.string(), day, day, text, pa.string()), strict=True)))
        done: list[tuple] = []
        for own, key, at, words, side, from_, why in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != where:
                done += end()
                where, name, since, held, reason, last, seen = own, _NONE, None, None, None, None, False
            if side == 0:
                name, since, held, reason, last, seen = key, from_, words, why, at, True
                continue
            if key != name:
                if name is not _NONE and since is not None:
                    done.append((where, name, "version", since, None, held, reason))
                name, since, held, reason, last, seen = key, None, None, None, None, False
            if since is None and words is not None:
                since, held, reason = at, words, "added" if seen else "original"
            elif since is not None and (words is None or changed(held, words)):
                done.append((where, name, "version", since, last, held, reason))
                if words is None or last < at:
                    done.append((where, name, "gap", last, at, None, "removed" if words is None else "changed"))
                since, held, reason = (None, None, None) if words is None else (at, words, "amended")
            last, seen = at, True
        yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=schema)
    if schema is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in end()], schema=schema)
