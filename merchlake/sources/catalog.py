"""Catalog tables. The reference tables here have TPC-H-like columns; catalog columns are derived from them.

The expressions are plain SQL that Spark and DuckDB both read, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _pick(values: list[str], seed: str = "p_partkey", nulls: int = 0) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    picked = f"(CASE CAST({seed} AS BIGINT) % {len(values)} {cases} END)"
    return f"(CASE WHEN p_partkey % {nulls} = 0 THEN NULL ELSE {picked} END)" if nulls else picked


def _number(expression: str, nulls: int, kind: str = "INT") -> str:
    return f"CAST(CASE WHEN p_partkey % {nulls} = 0 THEN NULL ELSE {expression} END AS {kind})"


_BRANDS = ["Samsung", "Apple", "Xiaomi", "Google", "OnePlus", "Realme", "Vivo", "Oppo", "Symphony"]
_MODELS = ["Ultra S25", "iPhone 16 Pro", "Note 13 Pro 5G", "Pixel 9", "Z Flip 6", "Z Fold 5 (12GB)", "A54 8GB/256GB", "Lite 4G", "GT 128GB with warranty", "Max | official"]
_CHIPS = [
    "Qualcomm Snapdragon 8 Gen 3 (4 nm)", "Apple A18 Pro", "Snapdragon 7s Gen 2", "MediaTek Dimensity 9300", "Google Tensor G4", "MediaTek Helio G99",
    "Snapdragon 8 Gen 1", "MediaTek Dimensity 8200", "Snapdragon 695", "Apple A17", "Unisoc T606", "Snapdragon 6 Gen 1", "Snapdragon 8 Elite",
]
_PANELS = ["Dynamic AMOLED 2X HDR10+", "LTPO OLED", "IPS LCD", "Super AMOLED", "OLED HDR", "flexible LTPO AMOLED"]
_GLASS = ["Gorilla Glass Victus 2", "Ceramic Shield", "", "water resistant", "microSD slot"]
_LENSES = ["OIS, telephoto 5x, 8K video ProRes", "periscope, OIS, HDR, Leica", "4K video", "f/1.8 large sensor, 4K60, sensor-shift", "", "Zeiss telephoto, RAW, HDR video log, NFC"]
_OS = ["Android 15, One UI 7, 7 years of updates, Galaxy AI", "iOS 18 Apple Intelligence", "Android 14 OxygenOS", "stock Android, Pixel, Gemini", "ColorOS clean", "HyperOS"]
_BODY = ["IP68 titanium frame", "IP67", "plastic", "IP69K armor aluminum", "rugged, waterproof"]
_NETWORKS = ["GSM / HSPA / LTE / 5G", "GSM / LTE-A", "GSM / LTE", "5G NFC eSIM", ""]

PHONE_COLUMNS = {
    "id": "p_partkey",
    "name": f"concat({_pick(_BRANDS, 'p_partkey * 7')}, ' ', p_name, ' ', {_pick(_MODELS, 'p_partkey * 3')})",
    "brand": _pick(_BRANDS, "p_partkey * 7"),
    "category": "CASE WHEN p_partkey % 10 IN (4, 8) THEN concat(p_type, ' / Foldable') ELSE concat(p_type, ', Phones > ', p_brand) END",
    "price_min": "CAST(CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE floor(p_retailprice * (5 + p_partkey * 13 % 160)) END AS DOUBLE)",
    "price_max": "CAST(floor(p_retailprice * (5 + p_partkey * 13 % 160)) + p_partkey % 5 * 500 AS DOUBLE)",
    "ram_gb": f"CAST({_pick(['4', '6', '8', '12', '16'], 'p_partkey * 11', 7)} AS INT)",
    "storage_gb": f"CAST({_pick(['64', '128', '256', '512'], 'p_partkey * 3', 11)} AS INT)",
    "battery_mah": _number("3000 + p_partkey * 37 % 4000", 9),
    "charging_w": _number("10 + p_partkey * 7 % 120", 8),
    "display_inches": _number("CAST(55 + p_partkey % 16 AS DOUBLE) / 10", 13, "DOUBLE"),
    "display_text": f"concat(5 + p_partkey % 2, '.', 10 + p_partkey * 3 % 80, ' inch ', {_pick(_PANELS, 'p_partkey * 5')}, ' ', 60 + p_partkey % 4 * 28, 'Hz ', 400 + p_partkey * 31 % 2800, ' nits peak, ', 300 + p_partkey % 300, ' nits typical, ', {_pick(_GLASS)})",
    "camera_text": f"concat(12 + p_partkey * 13 % 190, ' MP wide + ', 8 + p_partkey % 50, ' MP ultrawide, ', {_pick(_LENSES)})",
    "processor_text": _pick(_CHIPS, "p_partkey * 5", 23),
    "battery_text": f"concat(3000 + p_partkey * 37 % 4000, ' mAh, ', 10 + p_partkey * 7 % 120, '.5W fast charging', {_pick(['', ', wireless charging', ', no wireless', ', Qi charging'])})",
    "os": _pick(_OS, "p_partkey", 19),
    "body_text": _pick(_BODY, "p_partkey", 29),
    "network": _pick(_NETWORKS, "p_partkey", 31),
}
PHONES_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in PHONE_COLUMNS.items()) + " FROM part"

LISTING_COLUMNS = {
    "phone_id": "l_partkey",
    "store_id": "l_suppkey",
    "order_id": "l_orderkey",
    "line": "l_linenumber",
    "original_price": "CAST(floor(l_extendedprice / l_quantity * 10) AS DOUBLE)",
    "price": "CAST(CASE WHEN l_tax = 0.08 THEN NULL ELSE floor(l_extendedprice / l_quantity * 10 * (1 - l_discount)) END AS DOUBLE)",
    "in_stock": "l_returnflag <> 'R'",
    "scraped_at": "l_shipdate",
}
LISTINGS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in LISTING_COLUMNS.items()) + " FROM lineitem"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog, a row a product, with prices, parsed numbers and free texts."""
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {c}" for c, e in PHONE_COLUMNS.items()])


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stores ask for products, a row for each time a page was read."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in LISTING_COLUMNS.items()])


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS store_id", "s_name AS store_name")
