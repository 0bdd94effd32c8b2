import re
import time

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quilate.functions import fixed_values as V
from quilate.functions import match, text

CATALOG = ["RTX 4070", "RTX 4070 Ti", "RTX 3050", "RTX 5090", "RX 9070 XT", "RX 9070", "RX 9060 XT", "RX 7600", "Arc B580", "DDR5 16GB 6000", "DDR4 8GB 3200", "DDR4 16GB 3200", "DDR5 32GB 5600", "Kingston NV3 1TB", "Kingston NV2 500GB", "Kingston A400 480GB", "SSD 1TB"]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([(i, s, None, "GPU", None, None) for i, s in enumerate(CATALOG, 1)], "pos int, sku string, brand_family string, category string, release_year int, notes string")


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "title,part",
    [("  RTX 4070  ", "rtx 4070"), ("Gráficos", "graficos"), ("RTX4070Ti", "rtx 4070 ti"), ("RADEON R9070XT", "rx 9070 xt"), ("ArcB580", "arc b580"), ("Kingston Fury Beast 16GB DDR5 6000MHz", "ddr5 16gb 6000mhz"), ("DDR5 32GB PC5-48000", "48000mhz"), ("SSD Kingston NV3 1TB NVMe PCIe 4.0", "kingston nv3 1tb"), ("M.2 Corsair MP600 1TB", "corsair mp600 1tb")],
)
def test_normalize_title(spark, title, part):
    assert part in one(spark, title, text.normalize_title)


def test_normalize_title_edges(spark):
    assert one(spark, "", text.normalize_title) == ""
    assert one(spark, None, text.normalize_title) is None
    assert "m2" not in one(spark, "M.2 Corsair MP600 1TB", text.normalize_title)


def test_brand_and_variant(spark):
    rows = [("ASUS TUF RTX 4070", "ASUS", "Tuf"), ("MSI Gaming X Trio", "MSI", "Gaming X Trio"), ("AORUS Master", "Gigabyte", "Aorus"), ("Palit StormX", "Palit", "Stormx"), ("nothing", None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string").withColumn("b", text.extract_brand(F.col("t"))).withColumn("v", text.extract_variant(F.col("t"), F.col("b")))
    assert [(r["t"], r["b"], r["v"]) for r in df.collect()] == rows


EXACT = [("GPU MSI GeForce RTX 3050 Ventus OC", "RTX 3050"), ("Pasta Termica Deep Cool Z3", None), ("ASUS TUF RTX 4070 Ti OC 12GB", "RTX 4070 Ti"), ("MSI RTX 4070 Gaming X Trio", "RTX 4070"), ("GIGABYTE AMD RADEON R9070XT GV-R907XGAMINGOCICE-16GD", "RX 9070 XT"), ("Tarjeta de Video ASRock Intel ARC B580 Challenger OC", "Arc B580"), ("Memoria Kingston DDR5 16GB 6000MHz", "DDR5 16GB 6000"), ("Kingston Fury 16GB DDR4 3200MHz", "DDR4 16GB 3200"), ("Generic 4GB RAM", None)]
PATTERN = [("GPU MSI GeForce RTX 3050 Ventus OC", "RTX 3050"), ("GIGABYTE AMD RADEON 7600 GAMING OC", "RX 7600"), ("RTX3050 Stormx 6GB", "RTX 3050"), ("ASRock Arc B580 Challenger OC 12GB", "Arc B580"), ("ASUS TUF RTX 4070 Ti OC 12GB", "RTX 4070 Ti"), ("Memoria DDR4 8GB 3200MHz Kingston", "DDR4 8GB 3200"), ("DDR4 16GB 9999MHz", None), ("16GB DDR5 6000 Kingston", "DDR5 16GB 6000"), ("Disco SSD Kingston NV3 1TB M2 NVMe PCIe", "Kingston NV3 1TB"), ("Kingston A400 480GB SSD", "Kingston A400 480GB"), ("SSD 1TB NVMe PCIe Gen4x4", "SSD 1TB"), ("AMD R57600GT AM4", None), ("Pasta Termica", None)]


def test_exact_match(spark, catalog):
    df = spark.createDataFrame([(t,) for t, _ in EXACT], "title string")
    got = {r["title"]: r["exact_sku"] for r in match.with_exact_match(df, "title", catalog).collect()}
    assert got == dict(EXACT)


def test_pattern_match(spark):
    df = spark.createDataFrame([(t,) for t, _ in PATTERN], "title string").withColumn("s", match.pattern_match(F.col("title"), CATALOG))
    assert {r["title"]: r["s"] for r in df.collect()} == dict(PATTERN)


def test_resolve_priority(spark, catalog):
    rows = ["GPU MSI GeForce RTX 3050 Ventus OC", "GIGABYTE RADEON 7600", "Riser Cable PCIe 4.0", "RTX 509O gaming", None]
    got = {r["title"]: (r["resolved_sku"], r["confidence"], r["matched_by"]) for r in match.resolve_titles(spark.createDataFrame([(t,) for t in rows], "title string"), catalog).collect()}
    assert got["GPU MSI GeForce RTX 3050 Ventus OC"] == ("RTX 3050", 1.0, "exact")
    assert got["GIGABYTE RADEON 7600"] == ("RX 7600", 0.9, "regex")
    assert got["Riser Cable PCIe 4.0"] == (None, 0.0, None)
    assert got["RTX 509O gaming"][0] == "RTX 5090" and got["RTX 509O gaming"][2] == "fuzzy"
    assert got[None] == (None, 0.0, None)


def test_partial_ratio_by_hand():
    assert match.partial_ratio("", "") == 1.0 and match.partial_ratio("", "a") == 0.0
    assert match.partial_ratio("abc", "xxabcxx") == 1.0
    assert match.partial_ratio("abcd", "xxabxdxx") == pytest.approx(0.75)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    assert match.lcs_length(a, b) == brute_lcs(a, b)


@given(st.text("abcd ", max_size=30))
@settings(max_examples=600, deadline=None)
@example("aaa b ca")
@example("aaa caa")
def test_fuzzy_index_is_exact(t):
    skus = ["abcd a", "bcda", "aab dc", "dd ab"]
    scores = [match.partial_ratio(match.plain_sku(s), t) for s in skus]
    best = max(scores)
    want = (skus[scores.index(best)], best) if best >= 0.8 else (None, 0.0)
    assert match.FuzzyIndex(skus).best(t, 0.8) == want


@pytest.mark.parametrize("apart,pairs", [(1, 3), (4, 1000), (2000, 200_000)])
@given(skus=st.lists(st.text("abc 1", max_size=40), min_size=1, max_size=8), texts=st.lists(st.text("abc 1", max_size=60), min_size=1, max_size=5), cuts=st.lists(st.integers(0, 8), min_size=5, max_size=5), threshold=st.sampled_from([0.6, 0.8, 0.9]))
@settings(max_examples=60, deadline=None)
def test_many_texts_at_once_are_exact(apart, pairs, skus, texts, cuts, threshold):
    """Entries of any length, texts that hold parts of them, node by node and level by level."""
    skus = list(dict.fromkeys(skus))
    texts = [t[:c] + match.plain_sku(skus[i % len(skus)])[c // 3 :] + t[c:] for i, (t, c) in enumerate(zip(texts, cuts))]
    want = []
    for t in texts:
        scores = [match.partial_ratio(match.plain_sku(s), t) for s in skus]
        want.append((skus[scores.index(max(scores))], max(scores)) if max(scores) >= threshold else (None, 0.0))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(match, "PLACES_APART", apart)
        m.setattr(match, "PAIRS_AT_ONCE", pairs)
        assert match.FuzzyIndex(skus).best_of_all(texts, threshold) == want


@given(skus=st.lists(st.text("ab 012", max_size=40), min_size=1, max_size=8), texts=st.lists(st.text("ab 012", max_size=60), min_size=1, max_size=5), cuts=st.lists(st.integers(0, 8), min_size=5, max_size=5), threshold=st.sampled_from([0.4, 0.6, 0.8, 0.95]))
@settings(max_examples=150, deadline=None)
def test_any_entry_and_the_best_one_are_exact(skus, texts, cuts, threshold):
    """Entries that differ by their digits, at the beginning, inside and at the end of texts, from both sides."""
    skus = list(dict.fromkeys(skus))
    texts = [t[: 3 * (c % 3)] + match.plain_sku(skus[i % len(skus)])[c // 3 : 40 - c] + t[3 * (c % 3) : 20 * (c % 2)] for i, (t, c) in enumerate(zip(texts, cuts))]
    scores = [[match.partial_ratio(match.plain_sku(s), t) for s in skus] for t in texts]
    index = match.FuzzyIndex(skus)
    assert index.any_of_all(texts, threshold) == [max(x) >= threshold for x in scores]
    assert index.best_of_all(texts, threshold) == [(skus[x.index(max(x))], max(x)) if max(x) >= threshold else (None, 0.0) for x in scores]


def test_a_title_is_done_with_the_first_entry_it_resembles():
    """Whether any entry is near: what is found from the front is not searched from the back, what no entry resembles not by its numbers."""
    skus = [f"{maker} {i // 5 + 1000} {('', 'ti', 'xt', 'plus', 'max')[i % 5]}".strip() for maker in ("ignivar", "morvane", "jadrix 9") for i in range(250)]
    texts = [f"placa grafica {maker} {1000 + i % 50}ti zorzal {i} caja hasta cuotas" for i, maker in enumerate(["ignvar", "morbane", "riser", "jadrix 9"] * 100)]
    index, searched, table = match.FuzzyIndex(skus), [], match._Tree.table
    with pytest.MonkeyPatch.context() as m:
        m.setattr(match._Tree, "table", lambda tree, some: searched.append((tree, len(some))) or table(tree, some))
        assert index.any_of_all(texts, 0.8) == [i % 4 != 2 for i in range(400)]
    assert searched == [(index.first, 400), (index.rough, 100)]


def test_shares_count_every_row(spark):
    """NULL groups, NULL and empty titles and repeated ones; the same as from the entries themselves."""
    catalog = spark.createDataFrame([(1, "Ignivar 4000"), (2, "RTX 4070"), (3, None)], "pos int, sku string")
    rows = [("a", "placa ignivar 4000"), ("a", "placa ignivar 4000"), ("a", "otra cosa"), ("b", "GEFORCE 4070 x"), ("b", None), ("b", ""), ("b", "ignvar 4000 oc"), (None, "ignívar 4000"), (None, None), ("c", "riser")]
    df = spark.createDataFrame(rows, "source string, title string")
    want = {r[0]: r[1] for r in match.resolve_titles(df, catalog).groupBy("source").agg(match.F.avg(match.F.col("resolved_sku").isNotNull().cast("double"))).collect()}
    assert {r["source"]: r["match_rate"] for r in match.matched_shares(df, "source", catalog).collect()} == want == {"a": 2 / 3, "b": 0.5, None: 0.5, "c": 0.0}


def test_many_titles_and_a_long_catalogue(spark):
    """2,000 titles against 4,000 entries: some 20 ms a title when each title met all entries, now less than 1."""
    skus = [f"{maker} {i // 5 + 1000} {('', 'ti', 'xt', 'plus', 'max')[i % 5]}".strip() for maker in ("ignivar", "morvane", "jadrix 9", "cornepnus") for i in range(1000)]
    texts = [f"placa grafica {maker} {1000 + i % 200}ti zorzal {i} caja hasta cuotas" for i, maker in enumerate(["ignvar", "morbane", "jadrix", "riser"] * 500)]
    index, began = match.FuzzyIndex(skus), time.process_time()
    found = index.best_of_all(texts, 0.8)
    assert time.process_time() - began < 10
    assert found[0] == (skus[0], pytest.approx(11 / 12)) and found[3] == (None, 0.0)


def test_places_end_early():
    """Most places end at the first letters of an entry: so many steps are weighed for 300 titles and 1,000 entries."""
    skus = [f"{maker} {i // 5 + 1000} {('', 'ti', 'xt', 'plus', 'max')[i % 5]}".strip() for maker in ("ignivar", "morvane", "jadrix 9", "cornepnus") for i in range(250)]
    texts = [f"placa grafica {maker} {1000 + i % 50}ti zorzal {i} caja hasta cuotas" for i, maker in enumerate(["ignvar", "morbane", "jadrix"] * 100)]
    weighed, count = [], match.np.bitwise_count
    with pytest.MonkeyPatch.context() as m:
        m.setattr(match, "PLACES_APART", 1)
        m.setattr(match.np, "bitwise_count", lambda v: weighed.append(len(v)) or count(v))
        match.FuzzyIndex(skus).best_of_all(texts, 0.8)
    assert sum(weighed) < 340_000  # 361,190 when each step was weighed before its first letter


@given(st.lists(st.sampled_from(["rtx", "RX", "r", "Arc", "gtx", "g", "GT", "pc", "PC3", "pcie", "gen", "M", ".", "2", "gb", "TB", "ddr4", "radeon", "GeForce", "GV-R", "ryzen", "athlon", "Intel Core i", "i", "kingston", "nv2", "A400", "ssd", "4070", "906", "12", "7", "x", "0", "3200", "xt", "ti", " ", "  ", "-", "/", "ñ"]), max_size=9))
@settings(max_examples=1500, deadline=None)
def test_titles_that_skip_rewrites_and_patterns_have_none(parts):
    title, found = "".join(parts), lambda p: re.search("(?i)" + p.removeprefix("(?i)"), title, re.ASCII)
    for lo, hi, need in V.REWRITES_NEED:
        assert found(need) or not any(found(p) for p, _ in V.TOKEN_REWRITES[lo:hi])
    assert found(V.MODELS_NEED) or not any(map(found, V.MODEL_PATTERNS))
    assert [i for lo, hi, _ in V.REWRITES_NEED for i in range(lo, hi)] == list(range(len(V.TOKEN_REWRITES)))


def test_entries_of_one_maker_are_looked_up():
    """2,000 titles of a maker with 20,000 entries: some 2 s when each entry was tried, now a look-up by length."""
    skus = [f"ignivar {i}{s}" for i in range(10_000) for s in ("", " ti")]
    search, began = match._searcher(skus), time.process_time()
    assert [search(f"caja ignivar ignivar {i} ti x") for i in range(2000)] == [f"ignivar {i} ti" for i in range(2000)]
    assert search("ignivar9") is None and search("caja") is None and search(None) is None
    assert time.process_time() - began < 0.5


def test_texts_close_to_an_entry_are_not_searched_widely():
    """A text with an entry of a ratio of 0.9 or more is done: the wider search weighs only the others. Entries of a lower ratio and ties stay as they are."""
    skus = [f"{maker} {i // 5 + 1000} {('', 'ti', 'xt', 'plus', 'max')[i % 5]}".strip() for maker in ("ignivar", "morvane", "jadrix 9") for i in range(250)]
    near = [f"placa grafica ignivar {1000 + i % 50}ti zorzal {i} caja hasta cuotas" for i in range(200)]
    index, weighed, count = match.FuzzyIndex(skus), [], match.np.bitwise_count
    with pytest.MonkeyPatch.context() as m:
        m.setattr(match.np, "bitwise_count", lambda v: weighed.append(len(v)) or count(v))
        found = index.best_of_all(near, 0.8)
        close = sum(weighed)
        weighed.clear()
        m.setattr(match, "NEAR", 0.8)
        assert index.best_of_all(near, 0.8) == found and min(f[1] for f in found) >= 0.9
    assert close < sum(weighed) / 2
    assert match.FuzzyIndex(["", "1", "11"]).best("11", 0.6) == ("1", 1.0)
