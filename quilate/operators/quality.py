"""Aggregates for looking at the data: counts, statistics, pivots, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quilate.functions.listing import round_half_up as rounded


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value; NULL is a value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def sku_stats(snapshots: DataFrame) -> DataFrame:
    p = F.col("price_usd")
    return snapshots.groupBy("canonical_product_id").agg(F.count("*").alias("n"), rounded(F.min(p), 2).alias("least"), rounded(F.median(p), 2).alias("median"), rounded(F.max(p), 2).alias("most"), rounded(F.stddev_samp(p), 2).alias("deviation"))


def source_pivot(snapshots: DataFrame, sources: list[str]) -> DataFrame:
    """Median price per product, one column a source."""
    return snapshots.groupBy("canonical_product_id").pivot("source", sources).agg(F.round(F.median("price_usd"), 6))


def daily_volume(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def top_products(snapshots: DataFrame, n: int) -> DataFrame:
    return snapshots.groupBy("canonical_product_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "canonical_product_id").limit(n)


def daily_median(snapshots: DataFrame, products: DataFrame) -> DataFrame:
    rows = snapshots.join(F.broadcast(products.select("canonical_product_id")), "canonical_product_id", "left_semi")
    return rows.groupBy("canonical_product_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.round(F.median("price_usd"), 6).alias("median"))


def rolling_mean(daily: DataFrame, rows: int = 7) -> DataFrame:
    w = Window.partitionBy("canonical_product_id").orderBy("day").rowsBetween(1 - rows, 0)
    return daily.withColumn("rolling_mean", F.round(F.avg("median").over(w), 6))


def history_against_current(snapshots: DataFrame) -> DataFrame:
    """Median of all earlier days and of the last day of all, per product with both; difference in percent."""
    last = snapshots.agg(F.max(F.to_date("timestamp")).alias("_last"))
    rows = snapshots.join(F.broadcast(last), F.lit(True))
    now = F.to_date("timestamp") == F.col("_last")
    both = rows.groupBy("canonical_product_id").agg(F.median(F.when(~now, F.col("price_usd"))).alias("historical"), F.median(F.when(now, F.col("price_usd"))).alias("current")).na.drop()
    return both.withColumn("delta_pct", rounded((F.col("current") - F.col("historical")) / F.col("historical") * 100, 1))


def precision_recall(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Counts and rates of labelled matches; a wrong match counts as false positive and false negative."""
    t, f = F.col(truth), F.col(found)
    tp = F.count_if(t.isNotNull() & f.isNotNull() & (t == f))
    fp = F.count_if(f.isNotNull() & (t.isNull() | (t != f)))
    fn = F.count_if(t.isNotNull() & (f.isNull() | (t != f)))
    out = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return out.select("*", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


def winner_counts(df: DataFrame, target: str, a: str, b: str) -> DataFrame:
    ea, eb = F.abs(F.col(target) - F.col(a)), F.abs(F.col(target) - F.col(b))
    return df.groupBy(F.when(ea < eb, a).when(eb < ea, b).otherwise("tie").alias("winner")).agg(F.count("*").alias("n"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls, rows) in one pass."""
    one = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls"), F.col("_n").alias("rows")) for c in columns))).alias("x")).select("x.*")


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, extremes, quartiles and the 99th percentile of a column, in one row."""
    c = F.col(column)
    quantiles = F.percentile(c, F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75, 0.99))))
    one = df.agg(F.count(c).alias("n"), rounded(F.avg(c), 2).alias("mean"), rounded(F.stddev_samp(c), 2).alias("deviation"), F.min(c).alias("least"), F.max(c).alias("most"), quantiles.alias("_q"))
    return one.select("n", "mean", "deviation", "least", "most", *(rounded(F.col("_q")[i], 2).alias(name) for i, name in enumerate(("q25", "q50", "q75", "q99"))))


def overview(listings: DataFrame) -> DataFrame:
    """Rows, distinct addresses and titles, first and last day, days covered."""
    day = F.date_format("timestamp", "yyyy-MM-dd")
    return listings.agg(F.count("*").alias("rows"), F.count_distinct("url").alias("urls"), F.count_distinct("title").alias("titles"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_distinct(day).alias("days"))
