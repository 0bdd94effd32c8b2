"""Keyed upserts folded in arrival order, outcome counters, replace and append sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_outcomes(incoming: DataFrame, existing: DataFrame | None = None, key: str = "listing_key", order: list[str] = ("arrival",)) -> DataFrame:
    """``incoming`` with ``outcome``: inserted, updated or unchanged, as if applied row by row.

    A row's predecessor is the row of its key before it, or the stored one for the first; a new key
    inserts, another price updates, an equal price changes nothing. A hot key's rows need only the
    row before, so its window keeps one row of state.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = incoming.withColumn("_first", F.row_number().over(w) == 1).withColumn("_before", F.lag("price").over(w))
    if existing is not None:
        stored = existing.select(F.col(key).alias("_key"), F.col("price").alias("_stored"))
        rows = rows.join(stored, F.col(key) == F.col("_key"), "left").withColumn("_known", F.col("_key").isNotNull())
        rows = rows.withColumn("_before", F.when(F.col("_first"), F.col("_stored")).otherwise(F.col("_before"))).drop("_key", "_stored")
    else:
        rows = rows.withColumn("_known", F.lit(False))
    outcome = F.when(F.col("_first") & ~F.col("_known"), "inserted").when(F.col("_before") != F.col("price"), "updated").otherwise("unchanged")
    return rows.withColumn("outcome", outcome).drop("_first", "_before", "_known")


def upsert_listings(incoming: DataFrame, existing: DataFrame | None = None, key: str = "listing_key", order: list[str] = ("arrival",), updated_at: str = "updated_at", arrived_at: str = "created_at") -> DataFrame:
    """The table after the upsert: one row per key, first-seen columns, the last price and update time.

    Everything comes from one aggregation with map-side partial results: the first row of a key, the
    last price, and the time of the last insert or update.
    """
    folded = fold_outcomes(incoming, existing, key, list(order))
    rank = F.struct(*(F.col(c) for c in order))
    columns = [c for c in incoming.columns if c not in (key, "price", updated_at)]
    changed = F.when(F.col("outcome") != "unchanged", F.col(arrived_at))
    new = folded.groupBy(key).agg(
        F.min_by(F.struct(*columns), rank).alias("_first"), F.max_by("price", rank).alias("price"), F.max_by(changed, F.when(changed.isNotNull(), rank)).alias("_changed")
    )
    if existing is None:
        return new.select(key, *(F.col(f"_first.{c}").alias(c) for c in columns), "price", F.col("_changed").alias(updated_at)).select(*incoming.columns)
    old = existing.select(F.col(key).alias("_key"), F.struct(*columns).alias("_old"), F.col("price").alias("_old_price"), F.col(updated_at).alias("_old_updated"))
    both = new.join(old, F.col(key) == F.col("_key"), "full_outer")
    base = F.coalesce("_old", "_first")
    return both.select(F.coalesce(key, "_key").alias(key), *(base[c].alias(c) for c in columns), F.coalesce("price", "_old_price").alias("price"), F.coalesce("_changed", "_old_updated").alias(updated_at)).select(*incoming.columns)


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``: insert or replace."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys), allowMissingColumns=True)


def write_replacing(new: DataFrame, path: str, partition: str = "week_start") -> None:
    """Dynamic partition overwrite: only the partitions that ``new`` holds are replaced."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_snapshots(rows: DataFrame, path: str) -> None:
    """Append; rows without a product are an error of the caller and never written."""
    checked = rows.withColumn("canonical_product_id", F.when(F.col("canonical_product_id").isNull(), F.raise_error(F.lit("canonical_product_id is NULL")).cast("string")).otherwise(F.col("canonical_product_id")))
    checked.withColumn("price_usd", F.coalesce("price_usd", "price")).write.mode("append").parquet(path)


def unseen_snapshots(rows: DataFrame, existing: DataFrame, keys: list[str] = ("source", "listing_id", "timestamp")) -> DataFrame:
    """Rows whose keys no existing snapshot has, each once: appending them twice changes nothing."""
    match = [rows[k].eqNullSafe(existing[k]) for k in keys]
    on = match[0]
    for m in match[1:]:
        on = on & m
    return rows.join(existing, on, "left_anti").dropDuplicates(list(keys))


def missing_sources(expected: DataFrame, rows: DataFrame) -> DataFrame:
    """Expected sources without any row: (source, alert)."""
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    return expected.join(counts, "source", "left").where("n IS NULL").select("source", F.concat(F.lit("no rows from "), "source").alias("alert"))
