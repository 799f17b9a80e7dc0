"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did.

    On a cluster without a shared file system, ship it with ``--py-files`` instead.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local session may do without that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local(cores: int | str = 8, app: str = "plumbline") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return attach(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
