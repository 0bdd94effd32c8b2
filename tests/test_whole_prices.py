"""Queries over prices read every price: their SQL without its limits on price_usd, made here, gives the same."""

import pytest
from test_queries import DATA, canonical, duck  # noqa: F401

import __spark_entry__ as entry

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", ["weekly_features", "market_summary", "sku_stats", "price_describe", "daily_volume", "source_pivot", "training_frame"])
def test_every_price_counts(spark, duck, name):  # noqa: F811
    whole = entry.oracle_sql()[name].replace("price_usd BETWEEN 1 AND 20000", "price_usd IS NOT NULL AND NOT isnan(price_usd)")
    assert canonical(entry.queries()[name](spark, str(DATA)).toPandas()) == canonical(duck.execute(whole).df())


def test_extremes_are_those_of_the_table(spark, duck):  # noqa: F811
    least, most, n = duck.execute("SELECT min(price_usd), max(price_usd), count(*) FROM price_snapshots WHERE NOT isnan(price_usd)").fetchone()
    got = entry.queries()["price_describe"](spark, str(DATA)).first()
    assert (got["least"], got["most"], got["n"]) == (least, most, n)


def test_all_features_are_replaced(spark):
    rows = lambda name: {(r["week_start"], r["canonical_product_id"]): r["mediana_movil"] for r in entry.queries()[name](spark, str(DATA)).select("week_start", "canonical_product_id", "mediana_movil").collect()}
    new, got = rows("weekly_features"), rows("replace_features")
    assert {k: got[k] for k in new} == new and None in new.values()
    stored = {(r[0], r[1]) for r in spark.read.parquet(str(DATA / "feature_snapshots.parquet")).select("week_start", "canonical_product_id").collect()}
    assert set(got) == set(new) | stored
