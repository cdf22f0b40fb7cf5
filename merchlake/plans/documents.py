"""Queries on rendered documents and what is read back from them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.operators import documents as D
from merchlake.operators import ingest as I
from merchlake.plans.ingest import _BUCKETS, _WHOLE, bucketed
from merchlake.plans.scores import _has
from merchlake.sources.catalog import LISTINGS_SQL, PHONES_SQL, listings, phones, stores

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


_B = f"WITH phones AS ({PHONES_SQL}), listings AS ({LISTINGS_SQL}), {_BUCKETS}"
_SPECS = {"display": "display_text", "processor": "processor_text", "ram": "ram_gb", "storage": "storage_gb", "rear_camera": "camera_text", "battery": "battery_text", "charging": "charging_w", "operating_system": "os", "connectivity": "network", "durability": "body_text"}
_S = {k: _WHOLE(f"{x}::VARCHAR") for k, x in _SPECS.items()}
_q = lambda t: "'" + t.replace("'", "''") + "'"
_low = lambda x: f"lower(coalesce({_WHOLE(x)}, ''))"
_BLOB = f"lower(concat_ws(' ', {', '.join(_S.values())}, {_low('name')}, {_low('brand')}))"
_RESALE = f"(contains({_low('brand')}, 'apple') OR contains({_low('name')}, 'iphone') OR contains({_low('brand')}, 'samsung'))"
_EXP = "concat_ws(' ', " + ", ".join(f"CASE WHEN {_has('blob', words) if words else _RESALE} THEN {_q(yes)} ELSE {_q(no)} END" for words, yes, no in D.ASPECTS) + ")"
_kept = lambda items: f"list_filter([{items}], lambda x: x IS NOT NULL)"
_LINES = "array_to_string(" + _kept(", ".join(f"{_q(D.SPEC_LABELS[k] + ': ')} || {_S[k]}" for k in D.SPEC_LABELS if k in _S)) + ", '; ')"
_num = lambda x: f"format('{{:,}}', {x})"
_names = lambda x: f"CASE WHEN len({x}) > 0 THEN array_to_string({x}, ', ') ELSE 'none reported' END"
_n = lambda x: f"coalesce(len({x}), 0)"
_PRICES = f"CASE WHEN lowest IS NOT NULL THEN 'Lowest price: ' || {_num('lowest')} || ' BDT. Highest price: ' || {_num('highest')} || ' BDT. ' || CASE WHEN lowest = highest THEN 'It is priced uniformly at ' || {_num('lowest')} || ' BDT.' ELSE 'Prices range from ' || {_num('lowest')} || ' BDT to ' || {_num('highest')} || ' BDT.' END ELSE 'Lowest price: not reported. Highest price: not reported. No live price is currently reported by any store.' END"
_PARAGRAPH = f"concat_ws(' ', {_PRICES}, " + ", ".join(f"'{label} (' || {_n(x)} || '): ' || {_names(x)} || '.'" for label, x in (("Available stores", "available"), ("In-stock stores", "in_stock"), ("Out-of-stock stores", "out_of_stock"))) + ")"
_MEM = f"{_S['ram']} || ' GB of RAM with ' || {_S['storage']} || ' GB of storage'"
_FEAT = f"regexp_replace(concat_ws('; ', {_S['display']}, {_S['battery']}, {_S['rear_camera']}, {_MEM}), '[.;]+$', '')"
_CORE = f"'To sum up, the ' || b || ' ' || n || ' is a ' || lower(cat) || CASE WHEN {_FEAT} <> '' THEN ' with ' || {_FEAT} ELSE '' END"
_SUM = f"CASE WHEN lowest = highest THEN {_CORE} || '. Every store asks ' || {_num('lowest')} || ' BDT.' WHEN lowest IS NOT NULL THEN {_CORE} || '. It costs ' || {_num('lowest')} || ' to ' || {_num('highest')} || ' BDT in ' || {_n('available')} || ' stores, with ' || {_n('in_stock')} || ' that have it now.' WHEN {_FEAT} <> '' THEN {_CORE} ELSE {_CORE} || '.' END"
_OPEN = "'Phone name: ' || n || '. Brand: ' || b || '. Category: ' || cat || '. The ' || b || ' ' || n || ' is a ' || lower(cat) || '. What follows was put together from the pages of all stores that have it.'"
_ROWS = f"rec AS (SELECT phones.*, lowest, highest, available, in_stock, out_of_stock, coalesce({_WHOLE('name')}, 'Unnamed phone') AS n, coalesce({_WHOLE('brand')}, 'Unknown brand') AS b, coalesce({_WHOLE('category')}, 'Mobile Phone') AS cat, {_BLOB} AS blob FROM phones LEFT JOIN buckets ON phone_id = id)"
_DOC = f"concat_ws(chr(10) || chr(10), {_OPEN}, 'Key specifications — ' || nullif({_LINES}, '') || '.', {_PARAGRAPH}, {_EXP}, {_SUM})"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phones(spark, sf_dir).join(bucketed(spark, sf_dir).withColumnRenamed("phone_id", "id"), "id", "left")


@query(f"{_B}, {_ROWS} SELECT id, {_DOC} AS text FROM rec")
def doc_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("id", D.render().alias("text"))


@query(f"WITH phones AS ({PHONES_SQL}) SELECT id, {_EXP} AS text FROM (SELECT *, {_BLOB} AS blob FROM phones)")
def doc_experiential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phones(spark, sf_dir).select("id", D.experience(D.catalog_specs()).alias("text"))


@query(f"{_B}, {_ROWS} SELECT id, name, brand, regexp_extract(category, '^([^ .]+)', 1) AS category, lowest AS price_min, highest AS price_max, {_n('in_stock')} AS in_stock_count, {_n('available')} AS store_count FROM rec")
def doc_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _records(spark, sf_dir).select("id", D.render().alias("text"))
    return docs.select("id", *[e.alias(n) for n, e in D.parse(c("text")).items()])


_SHORT = {"processor": "processor_text", "ram": "ram_gb::VARCHAR", "storage": "storage_gb::VARCHAR", "display": "display_text", "camera": "camera_text", "battery": "battery_text", "os": "os", "network": "network", "body": "body_text"}
_SAID = [f"'It features {k}: ' || nullif(trim({_SHORT[k]}), '') || '.'" for k in D.SHORT_ORDER if k in _SHORT] + [f"CASE WHEN length(trim({_SHORT[k]})) < 200 THEN 'It has {k}: ' || nullif(trim({_SHORT[k]}), '') || '.' END" for k in sorted(_SHORT) if k not in D.SHORT_ORDER]
_ABOUT = r"trim(regexp_replace(regexp_replace('<p>' || repeat(name || '  <b>', 1 + id % 12) || '</p>', '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH phones AS ({PHONES_SQL}), listings AS ({LISTINGS_SQL}), e AS (SELECT phone_id, string_agg(s_name || ' (' || CASE WHEN price <> 0 THEN price::BIGINT || ' BDT, ' ELSE '' END || CASE WHEN in_stock THEN 'In Stock' ELSE 'Out' END || ')', ', ' ORDER BY order_id, line, store_id, price NULLS FIRST) AS shops FROM listings JOIN supplier ON store_id = s_suppkey GROUP BY phone_id)
SELECT id, concat_ws(' ', 'The ' || brand || ' ' || name || ' is a ' || lower(category) || '.', {', '.join(_SAID)}, 'It is available at the following stores: ' || shops || '.', CASE WHEN length({_ABOUT}) > 300 THEN {_ABOUT}[:297] || '...' ELSE nullif({_ABOUT}, '') END) AS text FROM phones LEFT JOIN e ON phone_id = id""")  # fmt: skip
def doc_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).join(stores(spark, sf_dir), "store_id")
    entry = F.struct("order_id", "line", "store_id", "price", c("store_name").alias("name"), F.when(c("in_stock"), F.lit(None)).otherwise("Out").alias("stock_status"))
    own = rows.groupBy(c("phone_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    columns = {"processor": "processor_text", "ram": "ram_gb", "storage": "storage_gb", "display": "display_text", "camera": "camera_text", "battery": "battery_text", "os": "os", "network": "network", "body": "body_text"}
    specs = {k: c(n).cast("string") for k, n in columns.items()}
    about = F.concat(F.lit("<p>"), F.repeat(F.concat("name", F.lit("  <b>")), (1 + c("id") % 12).cast("int")), F.lit("</p>"))
    return phones(spark, sf_dir).join(own, "id", "left").select("id", D.short(specs, c("entries"), about).alias("text"))


@query(f"{_B}, {_ROWS} SELECT 'phone_' || sha1('u' || id)[:24] AS id, sha256({_DOC}) AS doc_hash, name, brand, lowest AS price_min FROM rec")
def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index keeps of each document: its id by url, hash, and the metadata that its text tells."""
    docs = _records(spark, sf_dir).select(F.concat(F.lit("phone_"), F.substring(F.sha1(F.concat(F.lit("u"), "id").cast("binary")), 1, 24)).alias("id"), D.render().alias("text"))
    meta = D.parse(c("text"))
    return docs.select("id", I.doc_hash(c("text")).alias("doc_hash"), *[meta[n].alias(n) for n in ("name", "brand", "price_min")])
