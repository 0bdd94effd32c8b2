"""Weekly time-series features over a gap-free calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quilate.functions.listing import week_start

ROLLING_WEEKS = 4


def weekly_prices(snapshots: DataFrame) -> DataFrame:
    """Median and sample deviation per product and week; NULL and NaN prices are left out.

    The median is exact and holds one week of one product in a task; of a week of more than some
    hundred million rows per product use the llm subpackage's cumulative counts instead.
    """
    rows = snapshots.where("price_usd IS NOT NULL AND NOT isnan(price_usd)").select("canonical_product_id", week_start(F.col("timestamp")).alias("week"), "price_usd")
    return rows.groupBy("canonical_product_id", "week").agg(F.median("price_usd").alias("mediana_semanal"), F.stddev_samp("price_usd").alias("dispersion_precios"))


def calendar_spine(weekly: DataFrame) -> DataFrame:
    """Every product with every week from the first to the last of all products.

    The weeks come as one array of a one-row aggregate; products explode it, so no join multiplies.
    """
    span = weekly.agg(F.expr("sequence(min(week), max(week), interval 7 days)").alias("weeks"))
    return weekly.select("canonical_product_id").distinct().join(F.broadcast(span), F.lit(True)).select("canonical_product_id", F.explode("weeks").alias("week"))


def add_lags(spine: DataFrame) -> DataFrame:
    w = Window.partitionBy("canonical_product_id").orderBy("week")
    recent = w.rowsBetween(1 - ROLLING_WEEKS, 0)
    return (
        spine.withColumn("precio_lag_1", F.lag("mediana_semanal", 1).over(w))
        .withColumn("precio_lag_2", F.lag("mediana_semanal", 2).over(w))
        .withColumn("mediana_movil", F.percentile("mediana_semanal", F.lit(0.5)).over(recent))
    )


def weekly_features(snapshots: DataFrame, rates: DataFrame | None = None, since=None, warm_up_weeks: int = 0) -> DataFrame:
    """week_start, product, median, deviation, two lags, rolling median, rate. Empty input, empty output.

    ``since`` cuts the history before lags and rolling values are made; with ``warm_up_weeks`` so many
    earlier weeks are read for them, but do not come out.
    """
    if since is not None:
        start = F.lit(since).cast("timestamp")
        snapshots = snapshots.where(F.col("timestamp") >= start - F.expr(f"INTERVAL {7 * warm_up_weeks} DAYS"))
    weekly = weekly_prices(snapshots)
    full = add_lags(calendar_spine(weekly).join(weekly, ["canonical_product_id", "week"], "left"))
    if rates is not None:
        full = full.join(rates.select(F.to_date("week_start").alias("week"), "usd_uyu_rate"), "week", "left")
    else:
        full = full.withColumn("usd_uyu_rate", F.lit(None).cast("double"))
    if since is not None and warm_up_weeks:
        full = full.where(F.col("week") >= week_start(start))
    return full.select(F.date_format("week", "yyyy-MM-dd").alias("week_start"), "canonical_product_id", "mediana_semanal", "dispersion_precios", "precio_lag_1", "precio_lag_2", "mediana_movil", "usd_uyu_rate")
