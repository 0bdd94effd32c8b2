"""All registered queries over the smallest tables, against their SQL where they have any."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    clean = lambda v: "~" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(clean(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not any(math.isnan(len(k)) for k in entry.queries())


def test_streaming(spark, tmp_path):
    from quilate.streaming import prices

    src = spark.read.parquet(str(DATA / "price_snapshots.parquet"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = prices.latest_prices(stream).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = prices.latest_prices(src)
    assert spark.table("latest").exceptAll(batch).count() == 0 and batch.count() == spark.table("latest").count()
    q = prices.weekly_windows(stream, "3650 days").writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("weeks").groupBy().sum("readings").first()[0] == src.where("price_usd > 0 AND NOT isnan(price_usd)").count()
    raw = spark.read.parquet(str(DATA / "raw_listings.parquet"))
    raw.repartition(1).sortWithinPartitions("id").write.parquet(str(tmp_path / "raw"))
    rs = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "raw"))
    q = rs.writeStream.foreachBatch(prices.upsert_batches(str(tmp_path / "t"), ["id"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t/v1")).count() == raw.select("listing_key").distinct().count()
