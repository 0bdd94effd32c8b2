import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quilate.llm import reference_map as R
from quilate.llm import titles as T

ENTRIES = ["Ignivar 4000", "Ignivar 4000 Ti", "Jadrix 9 1300", "Jadrix 9 1300X", "Fluvion EX10 240GB", "Fluvion EX10 1TB", "Cornepnus DDR4 16GB 3200", "Cornepnus DDR4 16GB 3600", "Krynex 6320 Max"]
CASES = [
    ("VGA Gondwin Ignivar4000TI OC", "Ignivar 4000 Ti"), ("4000 Igniavr | Kolibri", "Ignivar 4000"), ("Ignivar 4005 Ti", None), ("Ignivar 4000 Ultra", None), ("JADRIX 9/1300 X 65W", "Jadrix 9 1300X"),
    ("Jadrix 9 1300 s/ cooler", "Jadrix 9 1300"), ("Jadrix 9 1300KS", None), ("Fluion ex-10 0.24TB NVMe", "Fluvion EX10 240GB"), ("Fluvion EX10 1024 GB lectura 3500MB/s", "Fluvion EX10 1TB"), ("Fluvion EX10 3TB", None), ("Fluvion HX10 240GB", None),
    ("Memoria 16 Gigas DDR-4 Cornepnus PC4-25600", "Cornepnus DDR4 16GB 3200"), ("cornepnus | ddr4 | 16384MB | 3600 | 6701 Zorzal", "Cornepnus DDR4 16GB 3600"), ("Cornepnus DDR4 16GB 5333", None), ("Cornepnus DDR4 16GB", None),
    ("6320 Max Krynex Arrecife 3057", "Krynex 6320 Max"), ("Cooler Gondwin Duna 1568", None), ("CornepnusDDR416GB3200", "Cornepnus DDR4 16GB 3200"), ("ignivar_4000_ti", "Ignivar 4000 Ti"), ("Ígnivar 4000", "Ignivar 4000"), ("", None), ("   ", None), (None, None), ("x" * 100_000, None), ("sin clasificar", None),
]


def damerau(a, b):
    """Brute force: breadth-first over single edits and swaps, by the textbook recurrence with any transposition."""
    d = {(-1, -1): len(a) + len(b)}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = len(a) + len(b), i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = len(a) + len(b), j
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
            for k in range(1, i):
                for m in range(1, j):
                    if a[k - 1] == b[j - 1] and b[m - 1] == a[i - 1]:
                        best = min(best, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
            d[i, j] = best
    return d[len(a), len(b)]


@given(st.text("ab", max_size=6), st.text("abc", max_size=6), st.text("ac", max_size=6))
@settings(max_examples=150, deadline=None)
def test_metric(a, b, c):
    assert R.edit_distance(a, b) == damerau(a, b) == R.edit_distance(b, a)
    assert R.edit_distance(a, c) <= R.edit_distance(a, b) + R.edit_distance(b, c)


def weighted(a, b):
    """Brute force with digits at their cost, by the recurrence over all transpositions."""
    w = lambda c: R.DIGIT_COST if c.isdigit() else 1
    d = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                ways = []
                if i:
                    ways.append(d[i - 1, j] + w(a[i - 1]))
                if j:
                    ways.append(d[i, j - 1] + w(b[j - 1]))
                if i and j:
                    ways.append(d[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else max(w(a[i - 1]), w(b[j - 1]))))
                for k in range(1, i):
                    for m in range(1, j):
                        if a[k - 1] == b[j - 1] and b[m - 1] == a[i - 1]:
                            ways.append(d[k - 1, m - 1] + sum(map(w, a[k : i - 1])) + max(w(a[i - 1]), w(b[j - 1])) + sum(map(w, b[m : j - 1])))
                d[i, j] = min(ways)
    return d[len(a), len(b)]


@given(st.text("a1b", max_size=6), st.text("ab12", max_size=6), st.text("b21", max_size=6))
@settings(max_examples=300, deadline=None)
def test_digits_cost_more_in_the_same_metric(a, b, c):
    assert R.edit_distance(a, b) == weighted(a, b) == R.edit_distance(b, a)
    assert R.edit_distance(a, c) <= R.edit_distance(a, b) + R.edit_distance(b, c)


def test_tree_returns_every_entry_within_threshold():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcd", k=rng.randint(3, 7))) for _ in range(300)]
    tree = R.BKTree(words)
    for q in words[:40] + ["zzzz", ""]:
        for limit in (0, 1, 2):
            assert tree.within(q, limit) == sorted((R.edit_distance(q, w), w) for w in set(words) if R.edit_distance(q, w) <= limit)


def frames(spark):
    df = spark.createDataFrame([(i, t, "e", 1) for i, (t, _) in enumerate(CASES)], "id int, t string, sku string, pos int")
    return df, spark.createDataFrame([(s,) for s in ENTRIES] + [(None,), (ENTRIES[0],)], "sku string")


def test_cases_and_shards(spark):
    df, ref = frames(spark)
    for size in (200_000, 4):
        got = {r["id"]: r["entry"] for r in R.map_to_reference(df, "t", ref, "sku", ["id"], shard_entries=size).collect()}
        assert got == {i: e for i, (_, e) in enumerate(CASES)}


def test_empty_reference_and_table_and_ties(spark):
    df, ref = frames(spark)
    assert {r["entry"] for r in R.map_to_reference(df, "t", ref.limit(0), "sku", ["id"]).collect()} == {None}
    assert R.map_to_reference(df.limit(0), "t", ref, "sku", ["id"]).count() == 0
    assert R.ReferenceMatcher([(0, "Abcdef 1000"), (1, "Abcdeg 1000")]).match("abcdeh 1000") == (None, None)
    assert R.ReferenceMatcher([(0, "Abcdef 1000"), (1, "Abcdeg 1000")]).match("abcdef 1000") == ("Abcdef 1000", 0)


def test_shards_decide_as_one_tree(spark):
    ref = spark.createDataFrame([(e,) for e in ("Abcdef 1000", "Abcdeg 1000", "Abcdeh 1000", "Abcdei 2000", "Ignivar 4000", "Ignivarx 5000", "abcdeg1000 x", "Zorzal Duna", "Zor-zal Duna")], "sku string")
    df = spark.createDataFrame([(v,) for v in ("abcdez 1000", "abcdef 1000", "Abcdeg 1000", "abcdei 1000", "abcdez 2000", "ignivar 5000", "ignivarx 4000", "ignivar 6000", "zorzalduna", "abcdeg1000x", None)], "v string")
    got = [{r["value"]: (r["entry"], r["distance"]) for r in R.map_to_reference(df, "v", ref, "sku", shard_entries=size).collect()} for size in (200_000, 4, 2, 1)]
    assert got[0]["abcdez 1000"] == (None, None) and got[0]["abcdef 1000"] == ("Abcdef 1000", 0)
    assert got[1:] == got[:1] * 3


def test_short_names_long_values_and_equal_squeezed_forms():
    m = R.ReferenceMatcher([(0, "Ryx 4000"), (1, "Ignivar 4000 Ti"), (2, "Kolibri" * 12 + " 4000")])
    assert m.match("VGA Ryx 4000 OC") == ("Ryx 4000", 0) and m.match("VGA Ryz 4000 OC") == (None, None)
    assert m.match("_".join("ignivar4000ti") + "_" * 60) == ("Ignivar 4000 Ti", 0)
    assert m.match("kolibri" * 12 + "4000")[0] == "Kolibri" * 12 + " 4000"
    assert R.ReferenceMatcher([(0, "Zorzal Duna"), (1, "Zor-zal Duna")]).match("zorzalduna") == (None, None)


#: Entries of other shapes than those of the test tables, and titles as shops write them.
SHOP_ENTRIES = ["RTX 4060", "RTX 4060 Ti", "RX 7800 XT", "RX 7800", "Arc A750", "DDR5 32GB 5200", "DDR4 8GB 2666", "Kingston NV2 500GB", "SSD 500GB", "Ryzen 5 5600G", "Intel Core i5 12400", "Athlon 3000G"]
SHOP_CASES = [
    ("Placa MSI GeForce RTX 4060 Ventus 2X OC 8GB", "RTX 4060"), ("Zotac RTX 4060 Ti Twin Edge", "RTX 4060 Ti"), ("RTX4060 StormX", "RTX 4060"), ("RTX4060Ti Dual", "RTX 4060 Ti"), ("Sapphire RX 7800 XT Pulse", "RX 7800 XT"),
    ("XFX RX7800XT Speedster", "RX 7800 XT"), ("Placa de video ASRock Intel ARC A750 Challenger", "Arc A750"), ("ArcA750 OC", "Arc A750"), ("Memoria Kingston Fury DDR5 32GB 5200MHz", "DDR5 32GB 5200"), ("Kingston 8GB DDR4 2666 MHz", "DDR4 8GB 2666"),
    ("Disco Kingston NV2 500GB M.2 NVMe", "Kingston NV2 500GB"), ("SSD 500GB PCIe", "SSD 500GB"), ("Micro AMD Ryzen 5 5600G AM4", "Ryzen 5 5600G"), ("AMD Athlon 3000G", "Athlon 3000G"), ("Intel Core i5 12400 LGA1700", "Intel Core i5 12400"),
    ("Pasta térmica 3 g", None), ("Riser PCIE4-RTX40", None), ("RX 7900 XT", None), ("DDR4 8GB 9999MHz", None), ("Memoria 4GB RAM", None), ("RTX 4060 Super", None), ("Arc A770", None), ("Kingston NV2 2TB", None),
]


def test_entries_of_any_shape(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SHOP_CASES)], "id int, t string")
    ref = spark.createDataFrame([(e,) for e in SHOP_ENTRIES], "sku string")
    for size in (200_000, 5, 1):
        got = {r["id"]: r["entry"] for r in R.map_to_reference(df, "t", ref, "sku", ["id"], shard_entries=size).collect()}
        assert {SHOP_CASES[i][0]: e for i, e in got.items()} == dict(SHOP_CASES)


@given(st.lists(st.sampled_from(SHOP_ENTRIES + ENTRIES + ["Zorzal Duna", "Zor-zal Duna", "Abcdef 1000", "Abcdeg 1000", "Nvx 3 500"]), min_size=1, max_size=9, unique=True), st.integers(1, 4), st.data())
@settings(max_examples=60, deadline=None)
def test_any_shards_decide_as_one_tree(entries, size, data):
    """The merge of map_to_reference over the shards' candidates, for values near entries."""
    listed = list(enumerate(sorted(entries)))
    word = data.draw(st.sampled_from(entries)).lower()
    at = data.draw(st.integers(0, len(word)))
    value = data.draw(st.sampled_from(["", "vga ", "ssd 500gb "])) + word[:at] + data.draw(st.sampled_from(["", "x", " ", "-"])) + word[at + data.draw(st.integers(0, 1)) :]
    shards = [listed[k : k + size] for k in range(0, len(listed), size)]
    ranked = []
    for shard, known in zip(shards, R.known_rests(listed, shards)):
        kind, length, nearest = R.ReferenceMatcher(shard, 1, known).candidates(value)
        ranked += [((kind, -length, d), e) for d, _, e in nearest] or ([((kind, 0, -1), None)] if kind == R.NO_ENTRY else [])
    best = [e for rank, e in ranked if rank == min(r for r, _ in ranked)]
    assert (best[0] if len(best) == 1 else None) == R.ReferenceMatcher(listed).match(value)[0]


def test_entries_read_to_themselves():
    keys = [T.read_entry(e) for e in ENTRIES]
    assert None not in keys and len(set(keys)) == len(ENTRIES)
    m = R.ReferenceMatcher(list(enumerate(ENTRIES)))
    for e, (case, tail) in itertools.product(ENTRIES, (("upper", " OFERTA"), ("lower", "  nuevo"))):
        assert m.match(getattr(e, case)() + tail)[0] == e
