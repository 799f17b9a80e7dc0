"""Files, JSON Lines and pages as sources, and the sinks beside them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import config as C
from plumbline.functions.text import extension


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``: path, length, sha256, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def content_type(content: Column) -> Column:
    """Type by first bytes; zip containers by their directory's names, OLE ones by stream names they hold.

    A text's letter may be cut at the end of the first kilobyte.
    """
    hex8 = F.hex(F.substring(content, 1, 8))
    head = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    raw = F.decode(content, "ISO-8859-1")
    member = lambda name: raw.rlike("(?s)PK\x01\x02.{42}" + name)  # noqa: E731  (a directory entry's name is its 47th byte on)
    zipped = F.when(member("word/"), "docx").when(member("xl/"), "xlsx_xlsm").when(member("content[.]xml"), "udf").otherwise("unknown")
    whole = lambda n: F.is_valid_utf8(F.substring(content, 1, n).cast("string"))
    valid = whole(1024) | ((F.length(content) > 1024) & (whole(1023) | whole(1022) | whole(1021)))
    ole = F.when(raw.contains("W\x00o\x00r\x00d\x00D\x00o\x00c"), "doc").when(raw.contains("W\x00o\x00r\x00k\x00b\x00o\x00o\x00k"), "xls").otherwise("unknown")
    return (
        F.when(hex8.startswith("25504446"), "pdf")
        .when(hex8.startswith("504B0304"), zipped)
        .when(hex8 == "D0CF11E0A1B11AE1", ole)
        .when(hex8.startswith("FFD8FF") | hex8.startswith("89504E47") | hex8.startswith("49492A00") | hex8.startswith("4D4D002A"), "image")
        .when(F.ltrim(head).startswith("<!doctype html") | head.contains("<html"), "html")
        .when((F.length(content) > 0) & valid & ~head.rlike("[\\x00-\\x08\\x0E-\\x1F]"), "text")
        .otherwise("unknown")
    )


def extension_mismatch(path: Column, found: Column) -> Column:
    """Whether the name promises another type than ``found``; unknown extensions promise nothing."""
    types = F.create_map(*[x for k, v in C.EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(~F.array_contains(types[extension(path)], found), F.lit(False))


#: Where Windows Turkish differs from Latin-1: bytes and letters, in the same order.
TURKISH_BYTES, TURKISH_LETTERS = "\u00d0\u00dd\u00de\u00f0\u00fd\u00fe", "\u011e\u0130\u015e\u011f\u0131\u015f"


def decoded_text(content: Column) -> Column:
    """UTF-8 text (byte order mark dropped), else the letters of Windows Turkish."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    turkish = F.translate(F.decode(content, "ISO-8859-1"), TURKISH_BYTES, TURKISH_LETTERS)
    return F.coalesce(F.regexp_replace(utf8, "^\ufeff", ""), turkish)


def not_cached(files: DataFrame, cache: DataFrame, fingerprint: str) -> DataFrame:
    """Files whose sha256 has no cached result made with this fingerprint of code and thresholds."""
    return files.join(cache.filter(F.col("fingerprint") == fingerprint).select("sha256"), "sha256", "left_anti")


def imported(files: DataFrame, known: DataFrame) -> DataFrame:
    """files with ``action``: insert, fill (known without a stored copy) or skip."""
    k = known.select("sha256", F.lit(True).alias("_k"), F.col("storage_key").alias("_s"))
    return files.join(k, "sha256", "left").withColumn("action", F.when(F.col("_k").isNull(), "insert").when(F.col("_s").isNull(), "fill").otherwise("skip")).drop("_k", "_s")


def storage_path(sha256: Column) -> Column:
    return F.concat_ws("/", F.lit("sha256"), F.substring(sha256, 1, 2), F.substring(sha256, 3, 2), sha256)


def read_strict(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON Lines: rows that do not parse or lack a required key are set aside."""
    bad = T.StructField("_corrupt", T.StringType())
    rows = spark.read.schema(T.StructType([*schema.fields, bad])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in required]), lambda c: c.isNotNull())
    checked = rows.withColumn("missing", missing)
    good = F.col("_corrupt").isNull() & (F.size("missing") == 0)
    return checked.filter(good).drop("_corrupt", "missing"), checked.filter(~good).select("_corrupt", "missing")


def write_with_summary(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Write JSON Lines and, beside them, counts by columns; return the counts."""
    df.write.json(f"{path}/records")
    summary = df.groupBy(*by).agg(F.count("*").alias("n"))
    summary.coalesce(1).write.json(f"{path}/summary")
    return summary


LINKS = "page_id long, url string, link string"


def page_links(pages: DataFrame, same_host: bool = True) -> DataFrame:
    """Absolute links of each page; HTML is parsed in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from html.parser import HTMLParser
        from urllib.parse import urljoin, urlsplit

        class Anchors(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag == "a":
                    self.found += [v for k, v in attrs if k == "href" and v]

        for pdf in batches:
            rows = []
            for page, url, html in pdf.itertuples(index=False):
                parser = Anchors()
                parser.found = []
                parser.feed(html or "")
                for href in dict.fromkeys(parser.found):
                    link = urljoin(url or "", href)
                    if not same_host or urlsplit(link).netloc == urlsplit(url or "").netloc:
                        rows.append((page, url, link))
            yield pd.DataFrame(rows, columns=["page_id", "url", "link"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, LINKS)


def due_files(files: DataFrame, status: str, checked: str, now: Column, days: int = C.RECHECK_DAYS) -> DataFrame:
    """Records to check: never checked, or not found more than ``days`` ago."""
    old = F.col(checked) < now - F.expr(f"INTERVAL {days} DAYS")
    return files.filter((F.col(status) == "unverified") | ((F.col(status) == "not_in_source") & old))
