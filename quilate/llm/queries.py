"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilate.llm import leaks, listings, packing, percentiles, reference_map, spam
from quilate.session import spread, table

PS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the positive prices per product."""
    prices = table(spark, sf_dir, "price_snapshots").where("price_usd > 0")
    counts = percentiles.value_counts(prices, ["canonical_product_id"], "price_usd")
    return percentiles.percentiles(counts, ["canonical_product_id"], PS)


def _weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = table(spark, sf_dir, "feature_snapshots").select("week_start").distinct()
    week = F.date_format(F.date_trunc("week", "timestamp"), "yyyy-MM-dd")
    return table(spark, sf_dir, "price_snapshots").where("price_usd > 0").select("canonical_product_id", "price_usd", "timestamp", week.alias("week_start")).join(weeks, "week_start", "left_semi")


def p1_weekly_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles per product within each week of feature_snapshots."""
    keys = ["canonical_product_id", "week_start"]
    return percentiles.percentiles(percentiles.value_counts(_weekly(spark, sf_dir), keys, "price_usd"), keys, PS)


def p1_combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts, combined to those of the weeks: equal to the weekly percentiles."""
    keys = ["canonical_product_id", "week_start"]
    daily = percentiles.value_counts(_weekly(spark, sf_dir).withColumn("day", F.to_date("timestamp")), [*keys, "day"], "price_usd")
    return percentiles.percentiles(percentiles.combine([daily], keys), keys, PS)


def p1_bounded_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per product within 0.5 % of the exact ones, from daily sketches of bounded size."""
    prices = table(spark, sf_dir, "price_snapshots").where("price_usd > 0").withColumn("day", F.to_date("timestamp"))
    daily = percentiles.value_counts(prices, ["canonical_product_id", "day"], "price_usd", 0.005)
    return percentiles.percentiles(percentiles.combine([daily], ["canonical_product_id"]), ["canonical_product_id"], PS).withColumn("value", F.round("value", 6)).withColumn("relative_error", F.lit(0.005))


def p1_bounded_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact percentiles per product, and whether those of the sketches lie within the stated 0.5 %."""
    exact = p1_percentiles(spark, sf_dir).select("canonical_product_id", "pct", F.col("value").alias("exact_value"))
    off = F.abs(F.col("value") - F.col("exact_value")) <= (0.005 + 1e-9) * F.col("exact_value") + 1e-6
    return p1_bounded_error(spark, sf_dir).join(exact, ["canonical_product_id", "pct"]).select("canonical_product_id", "pct", "exact_value", off.alias("within_bound"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue entry meant by each listing title and each identifier that is no sku."""
    catalog = table(spark, sf_dir, "canonical_catalog").select("sku")
    titles = reference_map.map_to_reference(table(spark, sf_dir, "raw_listings"), "title", catalog, "sku", ["id"])
    listed = titles.select(F.lit("raw_listings").alias("origin"), F.col("id").alias("row_id"), F.coalesce("entry", F.lit(reference_map.UNMATCHED)).alias("sku"))
    typed = table(spark, sf_dir, "price_snapshots").select("id", "canonical_product_id").join(catalog, F.col("canonical_product_id") == F.col("sku"), "left_anti")
    values = spread(typed.select("canonical_product_id").distinct())
    meant = reference_map.map_to_reference(values, "canonical_product_id", catalog, "sku").where("entry IS NOT NULL")
    ids = typed.join(meant, typed["canonical_product_id"] == meant["value"], "left")
    return listed.unionByName(ids.select(F.lit("price_snapshots").alias("origin"), F.col("id").alias("row_id"), F.coalesce("entry", F.lit(reference_map.UNMATCHED)).alias("sku")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of listings of one item by different sellers."""
    groups = listings.group_listings(table(spark, sf_dir, "raw_listings"), table(spark, sf_dir, "canonical_catalog"))
    return listings.same_item_pairs(groups)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per listing with its group and the number of listings and sellers in it."""
    groups = listings.group_listings(table(spark, sf_dir, "raw_listings"), table(spark, sf_dir, "canonical_catalog"))
    sizes = groups.where("group_id IS NOT NULL").groupBy("group_id").agg(F.count("*").alias("listings"), F.count_distinct("seller").alias("sellers"))
    return groups.join(sizes, "group_id", "left").select("id", "group_id", "listings", "sellers")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text (or piece of a long one) with its container of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, unused room and fill of the packing."""
    return packing.fill(p7_pack(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a substantial share of an evaluation passage."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the words of the passage that the document holds."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are keywords, links or tags rather than sentences."""
    return spam.spam_pages(table(spark, sf_dir, "documents")).where("is_spam").select("doc_id")


def p9_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the trees, and then the hosts, find among the labelled pages held out from training."""
    return spam.stage_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_percentiles": p1_percentiles,
    "p1_weekly_percentiles": p1_weekly_percentiles,
    "p1_combined_days": p1_combined_days,
    "p1_bounded_error": p1_bounded_error,
    "p1_bounded_check": p1_bounded_check,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p7_pack": p7_pack,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_found": p9_found,
    "p9_stages": p9_stages,
}


def _percentile_sql(keys: str, source: str) -> str:
    return f"""
        WITH v AS ({source}),
        c AS (SELECT {keys}, price_usd AS value, count(*) AS k FROM v GROUP BY ALL),
        r AS (SELECT *, sum(k) OVER (PARTITION BY {keys} ORDER BY value) AS cum, sum(k) OVER (PARTITION BY {keys}) AS n FROM c),
        p AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS pct)
        SELECT {keys}, pct, min(value) AS value, any_value(n)::BIGINT AS n_values
        FROM r, p WHERE cum >= greatest(1, ceil(round(pct * n, 9))) GROUP BY {keys}, pct
    """


_WEEKLY = """
    SELECT canonical_product_id, price_usd, strftime(date_trunc('week', timestamp AT TIME ZONE 'UTC'), '%Y-%m-%d') AS week_start
    FROM price_snapshots WHERE price_usd > 0 AND price_usd::VARCHAR <> 'nan'
    AND strftime(date_trunc('week', timestamp AT TIME ZONE 'UTC'), '%Y-%m-%d') IN (SELECT week_start FROM feature_snapshots)
"""
_POSITIVE = "SELECT canonical_product_id, price_usd FROM price_snapshots WHERE price_usd > 0 AND price_usd::VARCHAR <> 'nan'"
_SKETCH = "SELECT canonical_product_id, pow(1.005 / 0.995, ceil(ln(price_usd) / ln(1.005 / 0.995))) * (2 / (1 + 1.005 / 0.995)) AS price_usd FROM price_snapshots WHERE price_usd > 0 AND price_usd::VARCHAR <> 'nan'"
SQL = {
    "p1_bounded_error": f"SELECT canonical_product_id, pct, round(value, 6) AS value, n_values, 0.005::DOUBLE AS relative_error FROM ({_percentile_sql('canonical_product_id', _SKETCH)})",
    "p1_bounded_check": f"SELECT canonical_product_id, pct, value AS exact_value, true AS within_bound FROM ({_percentile_sql('canonical_product_id', _POSITIVE)})",
    "p1_percentiles": _percentile_sql("canonical_product_id", _POSITIVE),
    "p1_weekly_percentiles": _percentile_sql("canonical_product_id, week_start", _WEEKLY),
    "p1_combined_days": _percentile_sql("canonical_product_id, week_start", _WEEKLY),
}
