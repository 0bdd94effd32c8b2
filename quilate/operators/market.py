"""Market queries: latest prices, history, deviation from the median, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quilate.functions.listing import percent_difference, price_signal, round_half_up

NEWEST_ROWS = 10


def since_hours(snapshots: DataFrame, as_of, hours: int) -> DataFrame:
    return snapshots.where(F.col("timestamp") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours)))


def latest_per_source(snapshots: DataFrame) -> DataFrame:
    """The newest row of each product and source; ties go to the higher id."""
    w = Window.partitionBy("canonical_product_id", "source").orderBy(F.desc("timestamp"), F.desc("id"))
    return snapshots.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_per_product(snapshots: DataFrame) -> DataFrame:
    w = Window.partitionBy("canonical_product_id").orderBy(F.desc("timestamp"), F.desc("id"))
    return latest_per_source(snapshots).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def current_prices(snapshots: DataFrame, as_of, hours: int = 720) -> DataFrame:
    """Per product: the newest ten rows of the window, then the newest of each source among them."""
    w = Window.partitionBy("canonical_product_id").orderBy(F.desc("timestamp"), F.desc("id"))
    newest = since_hours(snapshots, as_of, hours).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= NEWEST_ROWS)
    s = Window.partitionBy("canonical_product_id", "source").orderBy("_rn")
    return newest.withColumn("_s", F.row_number().over(s)).where("_s = 1").select("canonical_product_id", "source", "seller", "price_usd", "timestamp", "listing_id")


def price_history(snapshots: DataFrame, product: str) -> DataFrame:
    return snapshots.where(F.col("canonical_product_id") == product).select("id", "timestamp", "source", "price_usd").orderBy("timestamp", "id")


def historical_medians(snapshots: DataFrame) -> DataFrame:
    return snapshots.where("price_usd IS NOT NULL AND NOT isnan(price_usd)").groupBy("canonical_product_id").agg(F.median("price_usd").alias("median_all"))


def market_summary(snapshots: DataFrame, as_of, hours: int = 720) -> DataFrame:
    """Per product in the window: current price, median of all history (2 digits), deviation in percent (1 digit).

    The median is over the whole history of the products that are current; a NaN current price counts as none.
    """
    usable = snapshots.where("price_usd IS NOT NULL AND NOT isnan(price_usd)")
    current = latest_per_product(since_hours(usable, as_of, hours)).select("canonical_product_id", "source", F.col("price_usd").alias("current_price"), "timestamp")
    history = usable.join(current.select("canonical_product_id"), "canonical_product_id", "left_semi")
    joined = current.join(historical_medians(history), "canonical_product_id", "left")
    median = F.coalesce("median_all", F.lit(0.0))
    pct = percent_difference(F.col("current_price"), median)
    return joined.select("canonical_product_id", "source", "current_price", "timestamp", round_half_up(median, 2).alias("historical_median"), round_half_up(pct, 1).alias("pct_diff"))


def by_deviation(summary: DataFrame) -> DataFrame:
    """The summary with the lowest deviation from the median first, and its place."""
    w = Window.orderBy("pct_diff", "canonical_product_id")  # one row a product
    return summary.withColumn("place", F.row_number().over(w)).orderBy("place")


def with_signals(summary: DataFrame, catalog: DataFrame, threshold: float = 10.0) -> DataFrame:
    """The summary with category and family (Unknown without an entry) and the signal of the rounded median."""
    meta = catalog.select(F.col("sku").alias("canonical_product_id"), "category", "brand_family")
    out = summary.join(meta, "canonical_product_id", "left")
    return out.withColumns({"category": F.coalesce("category", F.lit("Unknown")), "brand_family": F.coalesce("brand_family", F.lit("Unknown")), "signal": price_signal(F.col("current_price"), F.col("historical_median"), threshold)})


def skus_by_brand(catalog: DataFrame, family: str) -> DataFrame:
    return catalog.where(F.upper(F.coalesce("brand_family", F.lit(""))) == family.upper()).select("sku").orderBy("sku")


def scan_listings(listings: DataFrame, source: str | None = None, since=None) -> DataFrame:
    """Listings in order of time; the conditions given reach the scan."""
    rows = listings if source is None else listings.where(F.col("source") == source)
    if since is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    return rows.orderBy("timestamp", "id")


def least_current_price(snapshots: DataFrame, as_of, hours: int = 720) -> DataFrame:
    """The least current price of each product against its median over all history, with the signal; none without current prices."""
    current = current_prices(snapshots, as_of, hours).groupBy("canonical_product_id").agg(F.min("price_usd").alias("least_price"))
    joined = current.join(historical_medians(snapshots), "canonical_product_id")
    return joined.withColumn("signal", price_signal(F.col("least_price"), F.col("median_all")))


def latest_listings(listings: DataFrame, limit: int, source: str | None = None) -> DataFrame:
    rows = listings if source is None else listings.where(F.col("source") == source)
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)
