import datetime as dt

import pytest
from pyspark.sql import functions as F

from quilate import schemas
from quilate.functions import listing
from quilate.operators import upsert
from quilate.sources import config, html, pages


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_urls():
    base = "https://shop.example/item/1"
    assert listing.canonical_url(base + "/?utm_source=g&utm_medium=c") == listing.canonical_url(base + "/")[: len(base)] + "/"
    assert listing.canonical_url("HTTPS://Shop.example/Item/1#x") == base
    assert listing.canonical_url("https://shop.example/?b=2&a=1&b=3&empty=") == "https://shop.example/?b=2&b=3&a=1"
    assert listing.canonical_url(None) is None


def test_keys(spark):
    df = spark.createDataFrame([("thot", None, "https://a.example/x/"), ("thot", "", "https://a.example/x#f"), ("banifox", None, "https://a.example/x"), ("thot", "M1", "https://b.example")], "source string, item_id string, url string")
    keys = [r[0] for r in df.select(listing.listing_key(F.col("source"), F.col("item_id"), F.col("url"))).collect()]
    assert keys[0] == keys[1] != keys[2] and len(set(keys)) == 3


def test_to_usd(spark):
    f = lambda p, c, r: value(spark, listing.to_usd(F.lit(p).cast("double"), F.lit(c), F.lit(r).cast("double")))
    assert f(40000, "UYU", 40) == 1000 and f(100, "USD", None) == 100 and f(40000, "UYU", None) is None and f(1, "UYU", 0) is None
    with pytest.raises(Exception, match="currency not supported"):
        f(100, "EUR", 1)


def test_weeks_and_signals(spark):
    sunday = F.lit(dt.datetime(2026, 4, 12, 23, 59)).cast("timestamp")
    assert value(spark, listing.week_text(sunday)) == "2026-04-06"
    s = lambda c, m: value(spark, listing.price_signal(F.lit(float(c)), F.lit(float(m))))
    assert [s(90, 100), s(110, 100), s(100, 100), s(5, 0)] == ["deal", "expensive", "fair", "fair"]
    assert value(spark, listing.percent_difference(F.lit(5.0), F.lit(0.0))) == 0
    assert value(spark, listing.safe_float(F.lit("x"))) is None and value(spark, listing.safe_float(F.lit(float("nan")))) is None


def rows(spark, data):
    return spark.createDataFrame([(k, p, c, a, dt.datetime(2026, 1, a), dt.datetime(2026, 1, a)) for k, p, c, a in data], "listing_key string, price double, currency string, arrival int, created_at timestamp, updated_at timestamp")


def test_upsert_fold(spark):
    data = [("a", 750.0, "USD", 1), ("a", 750.0, "UYU", 2), ("a", 699.0, "USD", 3), ("b", 5.0, "USD", 4), ("a", 750.0, "USD", 5)]
    folded = upsert.fold_outcomes(rows(spark, data), order=["arrival"])
    assert [r["outcome"] for r in folded.orderBy("arrival").collect()] == ["inserted", "unchanged", "updated", "inserted", "updated"]
    out = {r["listing_key"]: r for r in upsert.upsert_listings(rows(spark, data), order=["arrival"]).collect()}
    assert (out["a"]["price"], out["a"]["currency"], out["a"]["arrival"], out["a"]["updated_at"].day) == (750.0, "USD", 1, 5)


def test_upsert_into_existing(spark):
    old = rows(spark, [("a", 5.0, "USD", 1), ("z", 1.0, "USD", 1)])
    new = rows(spark, [("a", 5.0, "UYU", 2), ("c", 3.0, "USD", 3)])
    outcomes = {(r["listing_key"]): r["outcome"] for r in upsert.fold_outcomes(new, old, order=["arrival"]).collect()}
    assert outcomes == {"a": "unchanged", "c": "inserted"}
    out = {r["listing_key"]: r for r in upsert.upsert_listings(new, old, order=["arrival"]).collect()}
    assert set(out) == {"a", "c", "z"} and out["a"]["currency"] == "USD" and out["a"]["updated_at"].day == 1
    assert upsert.upsert_listings(new.limit(0), old, order=["arrival"]).count() == 2


def test_replace_and_alerts(spark):
    old = spark.createDataFrame([("w1", "a", 1.0), ("w1", "b", 2.0)], "w string, k string, v double")
    new = spark.createDataFrame([("w1", "a", 9.0)], "w string, k string, v double")
    assert sorted(tuple(r) for r in upsert.replace_rows(old, new, ["w", "k"]).collect()) == [("w1", "a", 9.0), ("w1", "b", 2.0)]
    expected = spark.createDataFrame([("x",), ("y",)], "source string")
    assert [r["source"] for r in upsert.missing_sources(expected, spark.createDataFrame([("x",)], "source string")).collect()] == ["y"]


def test_unseen(spark):
    a = spark.createDataFrame([("s", None, 1), ("s", "x", 1), ("s", "x", 1)], "source string, listing_id string, timestamp int")
    assert upsert.unseen_snapshots(a, a.limit(0)).count() == 2 and upsert.unseen_snapshots(a, a.where("listing_id IS NULL")).count() == 1


def test_append(spark, tmp_path):
    df = spark.createDataFrame([("a", 5.0, None)], "canonical_product_id string, price double, price_usd double")
    upsert.append_snapshots(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).first()["price_usd"] == 5.0
    with pytest.raises(Exception, match="canonical_product_id is NULL"):
        upsert.append_snapshots(spark.createDataFrame([(None, 5.0, None)], df.schema), str(tmp_path / "s"))


def test_validation(spark):
    base = dict(source="thot", title=" x ", currency="USD", condition="new", price=1.0, base_price=None)
    bad = [{}, {"title": "  "}, {"source": "q"}, {"currency": "EUR"}, {"condition": "odd"}, {"price": 0.0}, {"price": float("nan")}, {"base_price": -1.0}, {"condition": None}]
    df = spark.createDataFrame([tuple({**base, **b}.values()) for b in bad], "source string, title string, currency string, condition string, price double, base_price double")
    assert [r["reject_reason"] for r in schemas.validate_listings(df).collect()] == [None, "title", "source", "currency", "condition", "price", "price", "base_price", None]


CARD = {
    "thot": '<li class="product"><a class="product-loop-title" href="/p/1"> RTX &amp; co </a><span class="price">{}</span></li>',
    "banifox": '<div class="cont-producto"><a title="T" href="/p/1">x</a><div class="precio"><b>USD 9</b> {} </div></div>',
    "pccompu": '<div id="resultado_productos"><div class="prod_cont"><div class="accont"><h2><a href="/p/1">i</a></h2></div><span itemprop="name">T</span><span class="pmoneda">{}</span><span class="pprecio">10.5</span></div></div>',
}


@pytest.mark.parametrize("site,text,price,currency", [("thot", "US$ 1,299", 1299.0, "USD"), ("thot", "$ 51.990,50", 51990.5, "UYU"), ("banifox", "usd 1.299,00", 1299.0, "USD"), ("pccompu", "USD", 10.5, "USD"), ("pccompu", "$", 10.5, "UYU")])
def test_cards(spark, site, text, price, currency):
    page = spark.createDataFrame([(1, CARD[site].format(text) * 2 + '<li class="product">broken</li>'), (2, None)], "id int, html string")
    got = html.listings_from_cards(html.raw_cards(page, site, "https://s.example"), site).collect()
    assert len(got) == (1 if site == "pccompu" else 2)  # only the first box of results is read
    assert (got[0]["price"], got[0]["currency"], got[0]["url"]) == (price, currency, "https://s.example/p/1")


def test_pagination(spark):
    data = [("u", 1, 200, ["a", "b"]), ("u", 2, 200, ["b", "c"]), ("u", 3, 200, ["a", "c"]), ("u", 4, 200, ["d"]), ("v", 1, 404, ["a"]), ("w", 1, 200, [])]
    df = spark.createDataFrame(data, "base_url string, page_no int, status int, urls array<string>")
    assert sorted((r["base_url"], r["page_no"]) for r in html.readable_pages(df).collect()) == [("u", 1), ("u", 2)]


def test_page_urls(spark):
    df = spark.createDataFrame([("https://s.example/c/?x=1&x=2",)], "b string")
    f = lambda site, p: df.select(listing.page_url(site, F.col("b"), F.lit(p)).alias("u")).first()["u"]
    assert f("pccompu", 2) == "https://s.example/c/?x=1&pagina=2"
    assert f("thot", 1).endswith("x=2/") and f("thot", 2).endswith("/page/2/") and f("banifox", 3).endswith("/pag/3/")


def test_catalog_and_jobs(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("canonical_products:\n  - sku: A 1\n    category: GPU\n  - sku: B 2\n")
    assert [r["pos"] for r in config.load_catalog(spark, str(path)).orderBy("pos").collect()] == [1, 2]
    for bad, error in (({}, KeyError), ({"canonical_products": {}}, TypeError), ({"canonical_products": [{}]}, ValueError), ({"canonical_products": [{"sku": "a"}, {"sku": "a"}]}, ValueError)):
        with pytest.raises(error):
            config.catalog_rows(bad)
    with pytest.raises(FileNotFoundError):
        config.read_yaml(str(tmp_path / "none"))
    jobs = config.load_jobs({"global": {"timeout": 10, "request_delay": 1.0}, "s": {"defaults": {"timeout": 30}, "jobs": [{"name": "j", "urls": ["u", "v"], "request_delay": 2.0}]}, "off": {"enabled": False, "jobs": []}})
    assert (jobs[0].timeout, jobs[0].request_delay, jobs[0].max_pages) == (30, 2.0, 20)
    assert config.job_table(spark, jobs).count() == 2
    assert value(spark, config.rate_from_json(F.lit('{"usd":{"uyu":39.5}}'))) == 39.5 and value(spark, config.rate_from_json(F.lit("x"))) is None


def test_fetch_retries():
    import urllib.error

    calls = []

    def opener(codes):
        it = iter(codes)

        def run(url, timeout):
            calls.append(url)
            raise urllib.error.HTTPError(url, next(it), "", None, None)

        return run

    assert pages.fetch("u", 1, opener=opener([500, 503, 500]), sleep=lambda s: None) == (500, "") and len(calls) == 3
    calls.clear()
    assert pages.fetch("u", 1, opener=opener([404]), sleep=lambda s: None) == (404, "") and len(calls) == 1


def test_paged_lists_end_where_they_should():
    card = '<li class="product"><a class="product-loop-title" href="/p/{0}">t{0}</a><span class="price">US$ 5</span></li>'
    site = {1: [1, 2], 2: [2, 3], 3: [3, 1], 4: [9]}
    asked = []

    def get(url):
        asked.append(url)
        n = int(url.rstrip("/").rsplit("/", 1)[1]) if "/page/" in url else 1
        return (200, "".join(card.format(k) for k in site[n])) if n in site else (404, "")

    got = list(pages.paged("thot", "https://s.example/c", get))
    assert [(r[1], r[5]) for r in got] == [(1, 2), (2, 1)] and len(asked) == 3  # the third page has nothing new
    assert [r[1] for r in pages.paged("thot", "https://s.example/c", get, max_pages=1)] == [1]
    assert [r[1] for r in pages.paged("thot", "https://s.example/c", get, start_page=4)] == [4]
    assert list(pages.paged("thot", "https://s.example/c", lambda u: (404, ""))) == list(pages.paged("thot", "https://s.example/c", lambda u: (200, "<p>"))) == []
    with pytest.raises(OSError, match="503"):
        list(pages.paged("thot", "https://s.example/c", lambda u: (503, "")))


def test_page_addresses_are_those_of_the_column(spark):
    df = spark.createDataFrame([("https://s.example/c/?x=1",), ("https://s.example/c/",)], "b string")
    for site in ("thot", "banifox", "pccompu"):
        for p in (1, 2, 7):
            assert [r["u"] for r in df.select(listing.page_url(site, F.col("b"), F.lit(p)).alias("u")).collect()] == [listing.page_address(site, r["b"], p) for r in df.collect()]


def test_paged_source(spark):
    import http.server
    import threading

    class Shop(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            n = int(self.path.rstrip("/").rsplit("/", 1)[1]) if "/page/" in self.path else 1
            body = f'<li class="product"><a class="product-loop-title" href="/p/{n}">t</a><span class="price">US$ {n}</span></li>'.encode()
            self.send_response(200 if n <= 3 else 404)
            self.end_headers()
            self.wfile.write(body if n <= 3 else b"")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Shop)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(pages.PagedSource)
        base = f"http://127.0.0.1:{server.server_port}"
        read = spark.read.format("paged").option("site", "thot").option("urls", f"{base}/a,{base}/b").option("delay", "0").load()
        rows = html.listings_from_cards(html.raw_cards(read.select("base_url", "page_no", "url", "html"), "thot", base), "thot").collect()
        assert sorted((r["page_base_url"][-1], r["page_page_no"], r["price"]) for r in rows) == [(u, n, float(n)) for u in "ab" for n in (1, 2, 3)]
    finally:
        server.shutdown()


def test_rebuilt_listings(spark):
    from quilate import schemas

    df = spark.createDataFrame([(0.0, ""), (5.0, "new"), (None, None), (-1.0, "used")], "base_price double, condition string")
    assert [tuple(r) for r in schemas.rebuilt_listings(df).collect()] == [(None, None), (5.0, "new"), (None, None), (-1.0, "used")]


def test_rates_are_fetched_once_a_week(spark):
    import http.server
    import threading

    asked = []

    class Rates(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            known = {"/2026-05-04.json": b'{"usd":{"uyu":39.5}}', "/2026-05-11.json": b"broken"}
            self.send_response(200 if self.path in known else 404)
            self.end_headers()
            self.wfile.write(known.get(self.path, b""))

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Rates)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(pages.PageSource)
        address = f"http://127.0.0.1:{server.server_port}/{{date}}.json"
        got = {r["week_start"]: r["usd_uyu_rate"] for r in config.rates_of_weeks(spark, ["2026-05-04", "2026-05-11", "2026-05-04", "2026-05-18"], address).collect()}
        assert got == {"2026-05-04": 39.5, "2026-05-11": None, "2026-05-18": None} and len(asked) == 3
        assert config.rates_of_weeks(spark, [], address).count() == 0
    finally:
        server.shutdown()
