"""Session helpers: defaults for tests, and table access that never overrides a cluster's settings."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, name: str = "quilate") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; days and weeks are those of UTC, so the session's zone has to be."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(values: DataFrame) -> DataFrame:
    """Distinct values over as many tasks as the session's shuffles have: few bytes of them are much work, so size alone must not merge them."""
    # By a hash of its own: a repartition by the columns themselves is dropped as the one that made the values distinct.
    return values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*values.columns))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where none is set (tests)."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = Path(tempfile.mkdtemp(prefix="quilate-")).as_uri()
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def bounded_rows(df: DataFrame, bound: int, what: str) -> list:
    """Rows of a dimension on the driver; refuses more than ``bound`` of them."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what} has more than {bound} rows; raise the bound only if it fits every executor")
    return rows
