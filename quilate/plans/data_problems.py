"""Queries of the core's data problems: missing values, implausible readings, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilate.operators import anomalies, identifiers, impute, units
from quilate.session import ensure_checkpoint_dir, table

#: Groups of similar records, the closest first.
DECKS = [["canonical_product_id"], ["category", "brand_family"], ["category"], []]
LAGS = {"precio_lag_1": 1, "precio_lag_2": 2}


def lag_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lag cell: the week it refers to, its observed value, and whether a value existed."""
    features = table(spark, sf_dir, "feature_snapshots")
    category = table(spark, sf_dir, "canonical_catalog").select(F.col("sku").alias("canonical_product_id"), "category", "brand_family")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.lit(k).alias("k"), F.col(c).alias("cell")) for c, k in LAGS.items())))
    long = features.select(F.col("id").alias("row_id"), "canonical_product_id", F.to_date("week_start").alias("week"), cells.alias("c"))
    long = long.select("row_id", "canonical_product_id", "c.field_name", impute.observed(F.col("c.cell")).alias("obs"), F.date_sub("week", F.col("c.k") * 7).alias("of_week"))
    prices = table(spark, sf_dir, "price_snapshots").select("canonical_product_id", F.to_date(F.date_trunc("week", "timestamp")).alias("of_week")).distinct().withColumn("existed", F.lit(True))
    rows = long.join(prices, ["canonical_product_id", "of_week"], "left").join(category, "canonical_product_id", "left")
    at = F.floor(F.datediff("of_week", F.lit("1970-01-05")) / 7)
    return rows.select("row_id", "field_name", "canonical_product_id", "brand_family", "category", at.alias("at"), "obs", (F.col("obs").isNull() & F.coalesce("existed", F.lit(False))).alias("wanted"))


def p4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lag cell with its value, filled from the product's other weeks, else from similar products.

    Distance (weeks) and level of the donor are -1 where nothing was filled.
    """
    filled = impute.hot_deck(lag_cells(spark, sf_dir), DECKS)
    return filled.select("row_id", "field_name", "canonical_product_id", F.col("obs").alias("observed_value"), "filled_value", "was_filled", F.coalesce("donor_distance", F.lit(-1)).alias("donor_distance"), F.coalesce("donor_level", F.lit(-1)).alias("donor_level"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells whose lost value was filled."""
    return p4_filled(spark, sf_dir).where("was_filled").select("row_id", "field_name")


def p4_masked_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each level of the deck errs by on observed cells that were hidden from it."""
    return impute.masked_error(lag_cells(spark, sf_dir), DECKS)


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price snapshots in dollars, with the catalogue entry their identifier means.

    The prices are read three times: for the values of identifier, label and week, for the levels, and as they are.
    """
    ensure_checkpoint_dir(spark)
    prices = table(spark, sf_dir, "price_snapshots").select("id", "timestamp", "canonical_product_id", "source", "seller", "price", "currency", "price_usd")
    summary = units.price_summary(prices).checkpoint()
    prices = identifiers.with_entry(prices, "canonical_product_id", table(spark, sf_dir, "canonical_catalog"), "sku", "entry", summary)
    rates = units.weekly_rate(table(spark, sf_dir, "feature_snapshots"), "week_start", "usd_uyu_rate")
    key = F.coalesce("entry", identifiers.squeezed(F.col("canonical_product_id")))
    return units.convert_prices(prices, table(spark, sf_dir, "price_texts"), rates, key, summary)


def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of tracked products that are impossible, a spike or stuck, with score and reason."""
    tracked = table(spark, sf_dir, "feature_snapshots").select(F.col("canonical_product_id").alias("entry")).distinct()
    converted = _converted(spark, sf_dir).join(tracked, "entry", "left_semi")
    bad = units.impossible(F.col("price_usd"), F.col("usd_value"))
    readings = converted.select("id", "source", F.concat_ws("\x01", "entry", "source", "seller").alias("series"), F.col("timestamp").alias("at"), F.when(~bad, F.col("usd_value")).alias("value"), F.col("price_usd").alias("reading"), F.coalesce(bad, F.lit(True)).alias("impossible"), F.col("level_rows").alias("per_week"))
    flags = anomalies.flag_readings(readings)
    reason = F.when(F.col("is_impossible"), "impossible").when(F.col("is_spike"), "spike").when(F.col("is_stuck"), "stuck")
    return flags.select("id", "source", "score", reason.alias("reason")).where("reason IS NOT NULL")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_flags(spark, sf_dir).select("id")


def p6_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every price in dollars next to its recorded price_usd, with its unit."""
    return _converted(spark, sf_dir).select("id", "price", "currency", "price_usd", "unit_code", "usd_value")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rate in pesos per dollar, with the unit it was recorded in."""
    return units.rate_units(table(spark, sf_dir, "feature_snapshots"), "id", "week_start", "usd_uyu_rate")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices under a wrong label or in another unit, and rates recorded the wrong way."""
    prices = units.unit_findings(_converted(spark, sf_dir)).select(F.lit("price_snapshots").alias("origin"), "row_id", "unit_code")
    rates = p6_rates(spark, sf_dir).where("unit_code <> 'uyu_per_usd'")
    return prices.unionByName(rates.select(F.lit("feature_snapshots").alias("origin"), "row_id", "unit_code"))


QUERIES = {"p4_found": p4_found, "p4_filled": p4_filled, "p4_masked_error": p4_masked_error, "p5_found": p5_found, "p5_flags": p5_flags, "p6_found": p6_found, "p6_converted": p6_converted, "p6_rates": p6_rates}


def _deck_sql() -> str:
    """The hot deck level by level: the nearest place before or after, the largest value of the one, the least of the other."""
    keys = ["p", "coalesce(cat, '~') || '|' || coalesce(fam, '~')", "coalesce(cat, '~')", "''"]
    ctes, columns, joins = [], [], []
    for i, k in enumerate(keys):
        ctes.append(f"d{i} AS (SELECT {k} AS k, place, max(obs) AS mx, min(obs) AS mn FROM cells WHERE obs IS NOT NULL GROUP BY ALL)")
        ctes.append(
            f"n{i} AS (SELECT c.row_id, c.field_name, b.place AS b_at, b.mx, a.place AS a_at, a.mn FROM (SELECT *, {k} AS k FROM cells WHERE wanted) c"
            f" ASOF LEFT JOIN d{i} b ON c.k = b.k AND c.place >= b.place ASOF LEFT JOIN d{i} a ON c.k = a.k AND c.place < a.place)"
        )
        back = f"(n{i}.a_at IS NULL OR cells.place - n{i}.b_at <= n{i}.a_at - cells.place)"
        columns.append((f"CASE WHEN {back} THEN n{i}.mx ELSE n{i}.mn END", f"CASE WHEN {back} THEN cells.place - n{i}.b_at ELSE n{i}.a_at - cells.place END"))
        joins.append(f"LEFT JOIN n{i} USING (row_id, field_name)")
    level = " ".join(f"WHEN ({v}) IS NOT NULL THEN {i}" for i, (v, _) in enumerate(columns))
    value = ", ".join(v for v, _ in columns)
    distance = " ".join(f"WHEN ({v}) IS NOT NULL THEN {g}" for v, g in columns)
    return f"""
        WITH c AS (
            SELECT id AS row_id, 'precio_lag_1' AS field_name, precio_lag_1 AS v, canonical_product_id AS p, week_start::DATE - 7 AS w FROM feature_snapshots
            UNION ALL SELECT id, 'precio_lag_2', precio_lag_2, canonical_product_id, week_start::DATE - 14 FROM feature_snapshots),
        had AS (SELECT DISTINCT canonical_product_id AS p, date_trunc('week', timestamp AT TIME ZONE 'UTC')::DATE AS w FROM price_snapshots),
        cells AS (
            SELECT row_id, field_name, c.p, category AS cat, brand_family AS fam, date_diff('day', DATE '1970-01-05', c.w) // 7 AS place, CASE WHEN v > 0 AND NOT isnan(v) THEN v END AS obs,
                   (CASE WHEN v > 0 AND NOT isnan(v) THEN v END) IS NULL AND had.p IS NOT NULL AS wanted
            FROM c LEFT JOIN had ON had.p = c.p AND had.w = c.w LEFT JOIN canonical_catalog ON sku = c.p),
        {', '.join(ctes)}
        SELECT cells.row_id, cells.field_name, cells.p AS canonical_product_id, obs AS observed_value, coalesce(obs, {value}) AS filled_value,
               wanted AND coalesce({value}) IS NOT NULL AS was_filled, (CASE {distance} ELSE -1 END)::BIGINT AS donor_distance, (CASE {level} ELSE -1 END)::INT AS donor_level
        FROM cells {' '.join(joins)}
    """


SQL = {
    "p4_filled": _deck_sql(),
    "p4_found": """
        WITH c AS (
            SELECT id AS row_id, 'precio_lag_1' AS field_name, precio_lag_1 AS v, canonical_product_id AS p, week_start::DATE - 7 AS w FROM feature_snapshots
            UNION ALL SELECT id, 'precio_lag_2', precio_lag_2, canonical_product_id, week_start::DATE - 14 FROM feature_snapshots)
        SELECT row_id, field_name FROM c
        WHERE (v IS NULL OR isnan(v) OR v <= 0)
          AND (p, w) IN (SELECT canonical_product_id, date_trunc('week', timestamp AT TIME ZONE 'UTC')::DATE FROM price_snapshots)
    """,
    "p6_rates": """
        WITH s AS (SELECT week_start, round(CASE WHEN usd_uyu_rate BETWEEN 5 AND 500 THEN usd_uyu_rate WHEN usd_uyu_rate BETWEEN 1/500.0 AND 1/5.0 THEN 1/usd_uyu_rate
                          WHEN usd_uyu_rate BETWEEN 500 AND 50000 THEN usd_uyu_rate/100 END, 4) AS r FROM feature_snapshots WHERE NOT isnan(usd_uyu_rate)),
        n AS (SELECT week_start, r, count(*) AS k FROM s WHERE r IS NOT NULL GROUP BY ALL),
        m AS (SELECT week_start, r FROM n QUALIFY row_number() OVER (PARTITION BY week_start ORDER BY k DESC, r) = 1)
        SELECT f.id AS row_id, usd_uyu_rate AS recorded, CASE WHEN usd_uyu_rate > 0 AND NOT isnan(usd_uyu_rate) THEN r END AS rate,
               CASE WHEN usd_uyu_rate IS NULL OR isnan(usd_uyu_rate) OR usd_uyu_rate <= 0 THEN NULL WHEN abs(ln(usd_uyu_rate / r)) < 0.5 THEN 'uyu_per_usd'
                    WHEN abs(ln(usd_uyu_rate * r)) < 0.5 THEN 'usd_per_uyu' WHEN abs(ln(usd_uyu_rate / (100 * r))) < 0.5 THEN 'uyu_per_100_usd' END AS unit_code
        FROM feature_snapshots f LEFT JOIN m USING (week_start)
    """,
}
