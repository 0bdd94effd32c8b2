"""The literal titles say something: what each of them is read as, stated here."""

import __spark_entry__ as entry
from quilate.plans.title_cases import TITLES


def rows(spark, name):
    return {TITLES[r["id"] - 1]: r for r in entry.queries()[name](spark, "").collect()}


def test_readings(spark):
    got = rows(spark, "title_cases")
    want = {
        "Placa MSI GeForce RTX 4060 Ventus 2X OC 8GB GDDR6": ("msi geforce rtx 4060 ventus 2x oc 8gb", "MSI", "Ventus", "RTX 4060", "RTX 4060"),
        "ZOTAC Gaming RTX4060Ti Twin Edge OC": ("zotac rtx 4060 ti twin edge oc", "Zotac", "Twin Edge Oc", "RTX 4060 Ti", "RTX 4060 Ti"),
        "Tarjeta de video Gigabyte GeForce 3060 Windforce": ("gigabyte geforce 3060 windforce", "Gigabyte", "Windforce", None, "RTX 3060"),
        "GIGABYTE GV-R906XGAMING OC-16GD": ("gigabyte gv r906xgaming oc 16gd", "Gigabyte", "Gaming Oc", None, "RX 9060 XT"),
        "Disco Kingston NV2 500GB M.2 NVMe PCIe 4.0": ("kingston nv2 500gb", None, None, "Kingston NV2 500GB", "Kingston NV2 500GB"),
        "Disco Sólido SSD 500GB": ("500gb", None, None, None, "SSD 500GB"),
        "16GB kit: 8 GB DDR4 2666 MHz": ("16gb kit ddr4 8gb 2666mhz", None, None, "DDR4 8GB 2666", None),
        "Gráficos RTX-3060/OC (nuevo)": ("graficos rtx 3060 oc nuevo", None, None, "RTX 3060", None),
        "Zotac AMP Extreme RTX 4080 Super": ("zotac amp extreme rtx 4080 super", "Zotac", "Amp Extreme", "RTX 4080 Super", "RTX 4080 Super"),
        "Pasta térmica": ("pasta termica", None, None, None, None),
        "   ": ("", None, None, None, None),
        None: (None, None, None, None, None),
    }
    assert {t: tuple(got[t][c] for c in ("normalized", "brand", "variant", "exact_sku", "pattern_sku")) for t in want} == want
    assert sum(r["pattern_sku"] is not None for r in got.values()) >= 18 and len({r["brand"] for r in got.values()}) >= 9


def test_resolver(spark):
    got = rows(spark, "resolver_cases")
    want = {
        "Sapphire Radeon RX7800XT Nitro+": ("RX 7800 XT", 1.0, "exact"), "XFX Speedster Radeon 7600": ("RX 7600", 0.9, "regex"), "Disco Sólido SSD 500GB": ("SSD 500GB", 0.9, "regex"), "SSD 1 TB Gen 4x4": ("SSD 1TB", 1.0, "fuzzy"),
        "RTX 4O60 Ti": ("RTX 4060 Ti", 0.909091, "fuzzy"), "Riser PCIE4-RTX40": (None, 0.0, None), "Pasta térmica": (None, 0.0, None), None: (None, 0.0, None), "": (None, 0.0, None),
    }
    assert {t: tuple(got[t][c] for c in ("resolved_sku", "confidence", "matched_by")) for t in want} == want
    assert len(got) == len(TITLES)
