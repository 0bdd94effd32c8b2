"""Table schemas and validation of raw listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCES, CURRENCIES, CONDITIONS = ("thot", "banifox", "pccompu"), ("UYU", "USD"), ("new", "used")


STRING, DOUBLE, INTEGER, TIMESTAMP = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()

#: Columns of the tables, in their order; False: never NULL. Fixed values.
RAW_LISTINGS = T.StructType(
    [
        T.StructField("listing_key", STRING, False),
        T.StructField("source", STRING, False),
        T.StructField("item_id", STRING),
        T.StructField("url", STRING, False),
        T.StructField("timestamp", TIMESTAMP, False),
        T.StructField("title", STRING, False),
        T.StructField("price", DOUBLE, False),
        T.StructField("currency", STRING, False),
        T.StructField("seller", STRING, False),
        T.StructField("condition", STRING),
        T.StructField("available_quantity", INTEGER),
        T.StructField("base_price", DOUBLE),
        T.StructField("created_at", TIMESTAMP, False),
        T.StructField("updated_at", TIMESTAMP, False),
    ]
)
PRICE_SNAPSHOTS = T.StructType(
    [
        T.StructField("timestamp", TIMESTAMP, False),
        T.StructField("canonical_product_id", STRING, False),
        T.StructField("source", STRING, False),
        T.StructField("seller", STRING, False),
        T.StructField("listing_id", STRING),
        T.StructField("price", DOUBLE, False),
        T.StructField("currency", STRING, False),
        T.StructField("price_usd", DOUBLE, False),
        T.StructField("availability", INTEGER),
        T.StructField("created_at", TIMESTAMP, False),
    ]
)
FEATURE_SNAPSHOTS = T.StructType(
    [
        T.StructField("week_start", STRING, False),
        T.StructField("canonical_product_id", STRING, False),
        T.StructField("run_at", STRING, False),
        T.StructField("precio_lag_1", DOUBLE),
        T.StructField("precio_lag_2", DOUBLE),
        T.StructField("mediana_movil", DOUBLE),
        T.StructField("dispersion_precios", DOUBLE),
        T.StructField("usd_uyu_rate", DOUBLE),
    ]
)
PREDICTIONS = T.StructType(
    [
        T.StructField("week_start", STRING, False),
        T.StructField("canonical_product_id", STRING, False),
        T.StructField("predicted_price_usd", DOUBLE, False),
        T.StructField("lower_bound", DOUBLE),
        T.StructField("upper_bound", DOUBLE),
        T.StructField("model_id", STRING, False),
        T.StructField("run_at", STRING, False),
    ]
)
CATALOG = T.StructType(
    [
        T.StructField("pos", INTEGER, False),
        T.StructField("sku", STRING, False),
        T.StructField("brand_family", STRING),
        T.StructField("category", STRING),
        T.StructField("release_year", INTEGER),
        T.StructField("notes", STRING),
    ]
)
TABLES = {"raw_listings": RAW_LISTINGS, "price_snapshots": PRICE_SNAPSHOTS, "feature_snapshots": FEATURE_SNAPSHOTS, "predictions": PREDICTIONS}


def create_missing(spark, folder: str) -> None:
    """Empty tables where there are none yet; existing ones stay."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


def rebuilt_listings(df: DataFrame) -> DataFrame:
    """Stored rows as listings again: an empty condition and a base price of 0 are none."""
    return df.withColumns({"condition": F.when(F.col("condition") != "", F.col("condition")), "base_price": F.when(F.col("base_price") != 0, F.col("base_price"))})


def validate_listings(df: DataFrame) -> DataFrame:
    """``df`` with the title stripped and ``reject_reason`` (NULL for a valid row)."""
    title = F.regexp_replace("title", r"(?U)^\s+|\s+$", "")
    positive = lambda c: F.col(c).isNull() | (F.col(c) > 0)
    reason = (
        F.when(F.col("title").isNull() | (title == ""), "title")
        .when(~F.col("source").isin(*SOURCES) | F.col("source").isNull(), "source")
        .when(~F.col("currency").isin(*CURRENCIES) | F.col("currency").isNull(), "currency")
        .when(F.col("condition").isNotNull() & ~F.col("condition").isin(*CONDITIONS), "condition")
        .when(F.col("price").isNull() | F.isnan("price") | ~positive("price"), "price")
        .when(~positive("base_price"), "base_price")
    )
    return df.withColumn("reject_reason", reason).withColumn("title", title)
