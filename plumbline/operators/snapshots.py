"""Published tables: immutable snapshots, a publish that refuses stale bases, and the merges behind it.

A published table is a folder of Parquet snapshots and numbered manifest entries, each of which names
the snapshot that is the table from then on. Readers follow the newest entry. A publisher merges against
the entry that it read and creates the next number; creating a file that is there fails, so of two
publishers from one base one is refused and merges again. Snapshots are never changed.

The merges are functions from DataFrames to DataFrames, all of them joins on the record key. Where a key
may repeat in what is wanted, rows are counted first and the key is refused with its reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_dir

STAMP = "timestamp_ntz"


class StaleBase(Exception):
    """Another publisher has published since the base was read."""


def _files(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def newest(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """(number, rows) of the table's newest entry; (0, None) where nothing is published yet."""
    fs, entries = _files(spark, f"{path}/manifest")
    if not fs.exists(entries):
        return 0, None
    name = max((f.getPath().getName() for f in fs.listStatus(entries)), default="")
    if not name:
        return 0, None
    return int(name), spark.read.parquet(f"{path}/{spark.read.text(f'{path}/manifest/{name}').first()[0]}")


def commit(rows: DataFrame, path: str, base: int) -> int:
    """Publish ``rows`` as the entry after ``base``; StaleBase if there is one already."""
    spark = rows.sparkSession
    folder = shared_dir(spark, "snapshot").rsplit("/", 1)[-1]
    rows.write.parquet(f"{path}/{folder}")
    fs, entry = _files(spark, f"{path}/manifest/{base + 1:012d}")
    try:
        out = fs.create(entry, False)
    except Exception as error:  # a JVM exception: only that the file is there is ours to tell
        if not fs.exists(entry):
            raise
        raise StaleBase(f"entry {base + 1} is published already") from error
    out.write(bytearray(folder.encode()))
    out.close()
    return base + 1


def publish(spark: SparkSession, path: str, merge, attempts: int = 5) -> int:
    """Merge (rows or None -> rows) against the newest entry and commit; again from the new base when stale."""
    for left in range(attempts - 1, -1, -1):
        number, rows = newest(spark, path)
        try:
            return commit(merge(rows), path, number)
        except StaleBase:
            if not left:
                raise
    raise ValueError("attempts must be at least 1")


def _why(*cases: tuple[Column, str]) -> Column:
    return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0]))


def merge_versions(live: DataFrame, wanted: DataFrame, key: str, payload: list[str], at: Column) -> tuple[DataFrame, DataFrame]:
    """(table after publishing, key and outcome) of versioned records such as an article's timeline.

    live: key, extraction, extracted_at, valid_from, valid_to, payload, recorded_at, superseded_at.
    wanted: key, extraction, extracted_at, verdict, versions (array of structs of valid_from, valid_to and
    payload). The extraction that is live is published again as nothing; an older one than the live one
    is stale; a newer one supersedes the live rows and inserts its own. Refused are rejected reviews,
    records without versions, versions without a start or that overlap, and keys wanted more than once.
    """
    current = live.filter("superseded_at is null").groupBy(key).agg(F.max("extraction").alias("_live"), (F.min("extraction") == F.max("extraction")).alias("_one"), F.max("extracted_at").alias("_live_at"))
    asked = wanted.join(wanted.groupBy(key).agg(F.count("*").alias("_n")), key).join(current, key, "left")
    ordered = F.array_sort("versions", lambda a, b: F.when(a["valid_from"] < b["valid_from"], -1).when(a["valid_from"] > b["valid_from"], 1).otherwise(0))
    clash = F.exists(F.zip_with(F.slice(ordered, 1, F.greatest(F.size("versions") - 1, F.lit(0))), F.slice(ordered, 2, F.greatest(F.size("versions"), F.lit(1))), lambda a, b: b.isNotNull() & (a["valid_to"].isNull() | (b["valid_from"] < a["valid_to"]))), lambda x: x)
    empty = F.coalesce(F.size("versions"), F.lit(0)) <= 0
    outcome = _why(
        (F.col("_n") > 1, "repeated_key"), (F.coalesce("verdict", F.lit("")) == "reject", "rejected"), (empty, "no_version"),
        (F.coalesce(F.col("_one") & (F.col("_live") == F.col("extraction")), F.lit(False)), "unchanged"), (F.coalesce(F.col("_live_at") > F.col("extracted_at"), F.lit(False)), "stale"), (F.exists("versions", lambda v: v["valid_from"].isNull()), "no_start"), (clash, "overlap"), (F.col("_live").isNotNull(), "superseded"),
    ).otherwise("inserted")
    judged = asked.withColumn("outcome", outcome)
    goes = judged.filter(F.col("outcome").isin("superseded", "inserted"))
    retired = goes.select(key, F.lit(True).alias("_gone"))
    old = live.join(retired, key, "left").withColumn("superseded_at", F.when(F.col("superseded_at").isNull() & F.col("_gone"), at).otherwise(F.col("superseded_at"))).select(*live.columns)
    new = goes.select(key, "extraction", "extracted_at", F.explode("versions").alias("v")).select(key, "extraction", "extracted_at", "v.valid_from", "v.valid_to", *[f"v.{c}" for c in payload], at.alias("recorded_at"), F.lit(None).cast(STAMP).alias("superseded_at"))
    return old.unionByName(new.select(*live.columns)), judged.select(key, "outcome").distinct()


def merge_records(live: DataFrame, wanted: DataFrame, edits: DataFrame, row: str, key: list[str], required: list[str], at: Column) -> tuple[DataFrame, DataFrame]:
    """(table after publishing, row and outcome) of single records with reviewers' edits laid over.

    live: the record's columns, recorded_at, superseded_at; wanted: ``row`` (unique), verdict, status
    and the record's columns; edits: ``row`` and one nullable column ``set_<name>`` for each edited
    column, where ``cleared`` lists names whose edit is to null. Refused are rejected reviews, sources that
    are not analysed, records without a required column, and keys that a live record or an earlier
    wanted row has (a key with a null part collides with nothing).
    """
    columns = [c for c in live.columns if c not in ("recorded_at", "superseded_at")]
    laid = wanted.join(edits, row, "left")
    edited = [c.removeprefix("set_") for c in edits.columns if c.startswith("set_")]
    value = lambda c: F.when(F.coalesce(F.array_contains("cleared", c), F.lit(False)), F.lit(None)).otherwise(F.coalesce(f"set_{c}", c))
    laid = laid.withColumns({c: value(c) for c in edited})
    taken = live.filter("superseded_at is null").select(*key, F.lit(True).alias("_taken")).distinct()
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    lacks = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in required])
    refused = _why((F.coalesce("verdict", F.lit("")) == "reject", "rejected"), (~F.col("status").eqNullSafe("analyzed"), "not_analyzed"), (lacks, "incomplete"))
    judged = laid.withColumn("_refused", refused)
    first = judged.filter("_refused is null").groupBy(*key).agg(F.min(row).alias("_first"))
    judged = judged.join(taken, key, "left").join(first, key, "left")
    outcome = F.coalesce("_refused", F.when(whole & (F.col("_taken") | (F.col("_first") < F.col(row))), "collision"), F.lit("published"))
    judged = judged.withColumn("outcome", outcome)
    new = judged.filter("outcome = 'published'").select(*columns, at.alias("recorded_at"), F.lit(None).cast(STAMP).alias("superseded_at"))
    return live.unionByName(new.select(*live.columns)), judged.select(row, "outcome")


def refresh(live: DataFrame, newer: DataFrame, edited: DataFrame, key: str, text: str, follows: list[str], fills: list[str], version: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(table after the refresh, key and outcome): newer extractions change only what nobody has edited.

    live: key, version (int), columns, recorded_at, superseded_at, one live row per key; newer: key,
    version and the columns; edited: key and ``names``, an array of edited columns. ``text`` and the
    columns that ``follow`` it are taken from a newer version that has a text; ``fills`` only where the
    live row has none. A row with changes is superseded and copied with them. Outcomes: not_newer,
    skipped_same, skipped_edits, refreshed; keys without a newer extraction have no outcome.
    """
    names = [text, *follows, *fills]
    fresh = newer.select(key, F.col(version).alias("_version"), *[F.col(c).alias(f"_{c}") for c in names])
    both = live.filter("superseded_at is null").join(fresh, key).join(edited.select(key, F.col("names").alias("_edited")), key, "left")
    held = lambda c: F.coalesce(F.array_contains("_edited", c), F.lit(False))
    there = F.coalesce(F.col(f"_{text}"), F.lit("")) != ""
    wanted = {c: there & ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (text, *follows)}
    wanted |= {c: there & (F.coalesce(F.col(c).cast("string"), F.lit("")) == "") & (F.coalesce(F.col(f"_{c}").cast("string"), F.lit("")) != "") for c in fills}
    any_of = lambda x: F.coalesce(reduce(lambda a, b: a | b, x), F.lit(False))
    changes = {c: w & ~held(c) for c, w in wanted.items()}
    outcome = F.when(F.col("_version") <= F.coalesce(F.col(version), F.lit(-1)), "not_newer").when(any_of(changes.values()), "refreshed").when(any_of(wanted.values()), "skipped_edits").otherwise("skipped_same")
    judged = both.withColumns({f"_take_{c}": w for c, w in changes.items()}).withColumn("_outcome", outcome)
    goes = judged.filter("_outcome = 'refreshed'")
    new = goes.select(*[F.when(F.col(f"_take_{c}"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in names else at.alias(c) if c == "recorded_at" else F.col("_version").alias(c) if c == version else F.col(c) for c in live.columns])
    old = live.join(goes.select(key, F.lit(True).alias("_gone")), key, "left")
    old = old.withColumn("superseded_at", F.when(F.col("superseded_at").isNull() & F.col("_gone"), at).otherwise(F.col("superseded_at"))).select(*live.columns)
    return old.unionByName(new), judged.select(key, F.col("_outcome").alias("outcome"))


def queue_status(extractions: DataFrame, live: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """extraction, status: approved (live), rejected, pending (the newest of its key) or superseded.

    extractions: extraction (unique), key, extracted_at; the newest is the latest, of ties the smallest
    extraction. live, rejected: extraction. Live wins over rejected.
    """
    last = extractions.groupBy(key).agg(F.min_by("extraction", F.struct(-F.unix_micros(F.col("extracted_at").cast("timestamp")), "extraction")).alias("_newest"))
    out = extractions.join(last, key, "left")
    for name, rows in (("_live", live), ("_rejected", rejected)):
        out = out.join(rows.select("extraction").distinct().withColumn(name, F.lit(True)), "extraction", "left")
    status = F.when(F.col("_live"), "approved").when(F.col("_rejected"), "rejected").when(F.col("_newest") == F.col("extraction"), "pending").otherwise("superseded")
    return out.select("extraction", key, status.alias("status"))
