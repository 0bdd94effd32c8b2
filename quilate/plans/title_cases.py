"""Titles as shops write them, with entries of the shapes that the model patterns read.

The makers and models of the test tables are invented, so hardly a pattern, maker or product line
occurs there. These titles make the queries over them say something.
"""

from __future__ import annotations

ENTRIES = (
    "RTX 3060", "RTX 4060", "RTX 4060 Ti", "RTX 4080 Super", "RX 7600", "RX 7800 XT", "RX 9060 XT", "Arc A750", "GTX 1650", "GT 730", "Ryzen 5 5600G", "Ryzen 7 7700", "AMD Athlon 3000G", "Intel Core i5 12400",
    "Intel Core i7 13700", "DDR4 8GB 2666", "DDR5 32GB 5200", "Kingston NV2 500GB", "Kingston A400 240GB", "SSD 500GB", "SSD 1TB",
)
TITLES = (
    "Placa MSI GeForce RTX 4060 Ventus 2X OC 8GB GDDR6", "ZOTAC Gaming RTX4060Ti Twin Edge OC", "Tarjeta de video Gigabyte GeForce 3060 Windforce", "ASUS TUF Gaming RTX 4080 Super 16GB", "Sapphire Radeon RX7800XT Nitro+", "XFX Speedster Radeon 7600",
    "Gigabyte R7600 Gaming OC", "GIGABYTE GV-R906XGAMING OC-16GD", "ASRock ArcA750 Challenger", "Palit GTX1650 StormX", "MSI G730 2GB", "PowerColor Hellhound RX 7800 XT", "Procesador AMD Ryzen 5 5600G AM4", "Micro R55600G tray", "AMD Athlon 3000G AM4",
    "Intel Core i5-12400 LGA1700", "CPU i7 13700 box", "Memoria DDR5 32GB 5200MHz Kingston", "16GB kit: 8 GB DDR4 2666 MHz", "Disco Kingston NV2 500GB M.2 NVMe PCIe 4.0", "KINGSTON A400 240GB SATA", "Disco Sólido SSD 500GB", "SSD 1 TB Gen 4x4", "RTX 4060 Tii",
    "Gráficos RTX-3060/OC (nuevo)", "RTX 4O60 Ti", "Ryzen 77700 en caja", "Intel Core i5 124O0", "Pasta térmica", "Riser PCIE4-RTX40", "DDR4 8GB 9999", "   ", "", "Placa ROG Strix RTX 3060", "Dual RTX 3060 Asus", "Zotac AMP Extreme RTX 4080 Super", "RX 7900 XT", None,
)


def frames(spark):
    """(titles, catalogue) as data frames."""
    return spark.createDataFrame(list(enumerate(TITLES, 1)), "id int, title string"), spark.createDataFrame(list(enumerate(ENTRIES)), "pos int, sku string")


def sql_literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


#: The same tables as common table expressions under the names of the whole ones.
SQL_TABLES = f"""
    raw_listings AS (SELECT * FROM (VALUES {', '.join(f'({i}, {sql_literal(t)})' for i, t in enumerate(TITLES, 1))}) v(id, title)),
    canonical_catalog AS (SELECT * FROM (VALUES {', '.join(f'({i}, {sql_literal(e)})' for i, e in enumerate(ENTRIES))}) v(pos, sku))
"""
