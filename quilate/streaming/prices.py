"""Streaming forms of the batch operators (extensions): weekly windows, upserts, latest prices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilate.operators.upsert import upsert_listings


def weekly_windows(snapshots: DataFrame, lateness: str = "14 days") -> DataFrame:
    """Counts, mean, extremes and an approximate median per product and Monday week, late rows within ``lateness`` included."""
    week = F.window("timestamp", "7 days", "7 days", "4 days")
    rows = snapshots.where("price_usd > 0 AND NOT isnan(price_usd)").withWatermark("timestamp", lateness)
    out = rows.groupBy(week.alias("w"), "canonical_product_id").agg(F.count("*").alias("readings"), F.avg("price_usd").alias("mean_price"), F.min("price_usd").alias("least_price"), F.max("price_usd").alias("most_price"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("week_start"), "canonical_product_id", "readings", "mean_price", "least_price", "most_price")


def upsert_batches(path: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch is upserted into version ``n + 1`` of the table.

    A batch that runs again after a failure writes the same version again, so it counts once.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        existing = spark.read.parquet(f"{path}/v{n}") if n else None
        upsert_listings(batch, existing, order=order).write.mode("overwrite").parquet(f"{path}/v{n + 1}")

    return apply


def latest_prices(snapshots: DataFrame) -> DataFrame:
    """Newest price per product and source, in update or complete mode; state is one row per key."""
    return snapshots.where("price_usd > 0 AND NOT isnan(price_usd)").groupBy("canonical_product_id", "source").agg(F.max_by("price_usd", F.struct("timestamp", "id")).alias("price_usd"), F.max("timestamp").alias("timestamp"))
