import itertools
import math
import random

import pytest

from pyspark.sql import functions as F

from quilate.llm import listings as L
from quilate.llm.reference_map import ReferenceMatcher

ENTRIES = ["Ignivar 4000", "Ignivar 4000 Ti", "Jadrix 9 1300", "Cornepnus DDR4 16GB 3200"]
ROWS = [
    (1, "VGA Gondwin Ignivar 4000 Caracola 6479 8GB", "s1"), (2, "CARACOLA-6479 IGNIVAR4000 GONDWIN oferta", "s2"), (3, "Placa de Video Gondwin Ignivar 4000 Ti Caracola 6479", "s3"),
    (4, "Gondwin Ignivar 4000 Caracola", "s4"), (5, "Gondwin Ignivar 4000 Zorzal 6479", "s5"), (6, "Cooler Gondwin Caracola 6479", "s1"), (7, "Gondwin Cooler Edición Caracola 6479 RGB", "s2"),
    (8, "Ram p/ PC 16G DDR4 Cornepnus PC4-25600 Luminar Duna 1111", "s1"), (9, "Luminar Cornepnus DDR4 16GB 3200MHz Duna 1111 CL16", "s1"), (10, "Luminar Cornepnus 16384MB DDR-4 3200 Duna 1111", "s9"),
    (11, None, "s1"), (12, "", "s2"), (13, "VGA Gondwin Ignivar 4000 Caracola 6479 8GB", "s1"), (14, "Gondwin Ignivar 4000 6479", "s6"), (15, "Ñandú 12 " + "largo " * 3000, None),
]


def frames(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "id long, title string, seller string, hard string, group_id string")
    return df, spark.createDataFrame([(e,) for e in ENTRIES], "sku string")


def test_groups_and_pairs(spark):
    df, ref = frames(spark)
    groups = L.group_listings(df, ref)
    got = {r["id"]: r["group_id"] for r in groups.collect()}
    assert len(got) == len(ROWS) and got[11] is got[12] is None
    assert got[1] == got[2] == got[4] == got[13] and got[3] != got[1] != got[5] and got[6] == got[7] != got[1] and got[8] == got[9] == got[10]
    assert got[14] not in (got[1], got[5])  # two editions have that number: it identifies neither
    pairs = {tuple(r) for r in L.same_item_pairs(groups).collect()}
    sellers = {r[0]: r[2] for r in ROWS}
    want = {(a, b) for a, b in itertools.combinations(sorted(got), 2) if got[a] and got[a] == got[b] and sellers[a] != sellers[b] and sellers[a] and sellers[b]}
    assert pairs == want and (1, 2) in pairs and (1, 13) not in pairs


def test_empty(spark):
    df, ref = frames(spark)
    assert L.same_item_pairs(L.group_listings(df.limit(0), ref)).count() == 0
    assert L.group_listings(df, ref.limit(0)).count() == len(ROWS)


def test_spelling(spark):
    words = spark.createDataFrame([("caracola",)] * 30 + [("caracoal",), ("carcola",), ("corocola",), ("gondwin",)], "word string")
    assert {r["word"]: r["better"] for r in L.spelling_corrections(words).collect()} == {"caracoal": "caracola", "carcola": "caracola"}


def test_containment_join_against_brute_force(spark):
    import random

    rng = random.Random(5)
    sets = {(rng.choice("xy"), tuple(sorted(rng.sample("abcdef", rng.randint(1, 4))))) for _ in range(60)}
    rows = [(h + "|" + "|".join(s), h, list(s)) for h, s in sets]
    got = {r["class_key"]: r["centre"] for r in L.containment_stars(spark.createDataFrame(rows, "class_key string, hard string, soft array<string>")).collect()}
    for key, h, s in rows:
        above = [k for k, h2, s2 in rows if h2 == h and len(s2) > len(s) and set(s) <= set(s2)]
        top = [k for k in above if not any(h2 == h and k2 != k and set(k.split("|")[1:]) < set(s2) for k2, h2, s2 in rows)]
        assert got[key] == (top[0] if len(top) == 1 else key)


@pytest.mark.parametrize("containment", [0.5, 0.7, 0.8, 0.9, 1.0])
def test_links_against_brute_force(spark, containment):
    rng = random.Random(int(containment * 10))
    sets = sorted({("xy"[rng.random() < 0.3], tuple(sorted(rng.sample("abcdefghij", rng.randint(1, 7))))) for _ in range(90)})
    rows = [(h + "|" + "|".join(s), h, list(s)) for h, s in sets]
    got = {tuple(r) for r in L.containment_links(spark.createDataFrame(rows, "class_key string, hard string, soft array<string>"), containment).collect()}
    n = {h: sum(x == h for _, x, _ in rows) for h in "xy"}
    w = {(h, t): math.log(1 + n[h] / sum(x == h and t in s for _, x, s in rows)) + 0.1 for _, h, s in rows for t in s}
    mass = lambda h, s: sum(w[h, t] for t in sorted(s))
    want = set()
    for ka, h, a in rows:
        for kb, hb, b in rows:
            if h == hb and ka != kb:
                ma, mb = mass(h, a), mass(h, b)
                if (mb > ma + 1e-7 or (abs(mb - ma) <= 1e-7 and kb > ka)) and mass(h, set(a) & set(b)) >= containment * ma - 1e-9:
                    want.add((ka, kb))
    close = {(a, b) for a, b in got ^ want if abs(mass(a[0], a.split("|")[1:]) - mass(b[0], b.split("|")[1:])) <= 1e-7}
    assert got - close == want - close and len(want) > 20


def test_a_shared_weight_of_four_fifths_is_linked_at_seven_tenths(spark):
    rows = [("one", "m", ["a", "b", "c", "d", "e"]), ("two", "m", ["b", "c", "d", "e", "f"]), ("far", "m", ["x", "y"])]
    got = {tuple(r) for r in L.containment_links(spark.createDataFrame(rows, "class_key string, hard string, soft array<string>"), 0.7).collect()}
    assert got == {("one", "two")}


def test_pairs_of_a_large_group_come_whole(spark):
    df = spark.range(700).select("id", F.lit("g").alias("group_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("seller"))
    assert L.same_item_pairs(df).count() == sum(1 for a, b in itertools.combinations(range(700), 2) if a % 3 != b % 3)


def test_normalise_details():
    m = ReferenceMatcher(list(enumerate(ENTRIES)))
    a = L.normalise("Micro Jadrix 9-1300 Tarvok Duna-1568 s/ cooler 65W 3.6 GHz Socket LX5", m)
    assert a == L.normalise("JADRIX 9 1300 | TARVOK | EDICIÓN DUNA 1568 | 12 Threads", m) == ("jadrix 9 1300", ["1568", "duna", "tarvok"])
