"""Queries on ingest: projections and rejects, merging, child rows, dimensions, vectors by hash; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.operators import ingest as I
from merchlake.plans.catalogue import _SLUG
from merchlake.sources.catalog import LISTINGS_SQL, PHONES_SQL, listings, phones, stores, table
from merchlake.sources.texts import filled, rows, rows_sql

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Scraped products as the tables here can stand for them: a row for each listing. Spark and DuckDB both read the expressions.
PRODUCT = {
    "ord": "(order_id * 10 + line) * 10000 + store_id",
    "store": "CASE WHEN line % 5 = 0 THEN NULL ELSE store_name END",
    "source": "CASE WHEN order_id % 3 = 0 THEN '' ELSE concat('Feed ', line) END",
    "store_url": "concat('https://', lower(store_name))",
    "name": "CASE WHEN order_id % 53 = 0 THEN NULL ELSE name END",
    "brand": "CASE WHEN order_id % 31 = 0 THEN '' ELSE brand END",
    "category": "category",
    "image_url": "concat('img/', id)",
    "release_year": "2018 + id % 7",
    "ram": "CASE WHEN ram_gb IS NULL THEN NULL ELSE concat(ram_gb, ' GB') END",
    "storage": "CAST(storage_gb AS STRING)",
    "chipset": "processor_text",
    "price": "price",
    "original_price": "original_price",
    "in_stock": "CASE WHEN order_id % 4 = 0 THEN NULL ELSE in_stock END",
    "stock_status": "CASE order_id % 5 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'n/a' WHEN 2 THEN 'out' ELSE NULL END",
    "product_url": "CASE WHEN order_id % 41 = 0 THEN '' ELSE concat('https://shop/', id, '/', store_id % 3) END",
    "url": "CASE WHEN order_id % 2 = 0 THEN concat('https://alt/', id) ELSE NULL END",
    "scraped_file": "concat('f', line)",
    "scraped_at": "scraped_at",
}
_PR = f"WITH phones AS ({PHONES_SQL}), listings AS ({LISTINGS_SQL}), products AS (SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {n}" for n, e in PRODUCT.items()) + " FROM (SELECT p.*, l.*, s_name AS store_name FROM listings l JOIN phones p ON id = phone_id JOIN supplier ON store_id = s_suppkey))"
_BLANK = lambda x: f"nullif(trim({x}), '')"


def _products(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Scraped products, and columns of phones and listings that are asked for; phones come last, so no shuffle moves their texts with listings."""
    both = listings(spark, sf_dir).join(stores(spark, sf_dir), "store_id").join(phones(spark, sf_dir), c("phone_id") == c("id"))
    return both.selectExpr(*[f"{e} AS {n}" for n, e in PRODUCT.items()], *more)


_GOOD = "coalesce(name, '') <> '' AND price IS NOT NULL AND coalesce(product_url, '') <> ''"
_KEY = "concat_ws('_', " + ", ".join(f"coalesce(nullif({_SLUG(x)}, ''), 'na')" for x in ("brand", "name", "'official'", "ram", "storage")) + ")"
_GOODS = f"{_PR}, good AS (SELECT * REPLACE (coalesce(nullif(trim(brand), ''), 'Unknown') AS brand) FROM products WHERE {_GOOD}), keyed AS (SELECT *, {_KEY} AS variant_key FROM good)"
_TAGS = "list_filter(list_transform(regexp_split_to_array(category, '[,/>]'), lambda t: trim(t)), lambda t: t <> '')"


@query(f"{_GOODS} SELECT DISTINCT store AS name, store_url AS url FROM good")
def project_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.projected(_products(spark, sf_dir))["store"]


@query(f"{_GOODS} SELECT brand, name AS model_name, array_to_string({_TAGS.replace('category', 'arg_min(category, product_url)')}, '|') AS tags, arg_min(image_url, product_url) AS image_url, arg_min(release_year, product_url) AS release_year FROM good GROUP BY ALL")
def project_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.projected(_products(spark, sf_dir))["model"].withColumn("tags", F.array_join("category_tags", "|")).drop("category_tags")


@query(f"{_GOODS} SELECT variant_key, arg_min(brand, product_url) AS brand, count(DISTINCT product_url) AS urls FROM keyed GROUP BY ALL")
def project_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = I.projected(_products(spark, sf_dir))
    return parts["variant"].select("variant_key", "brand").join(parts["listing"].groupBy("variant_key").agg(F.count_distinct("product_url").alias("urls")), "variant_key")


@query(f"{_GOODS} SELECT variant_key, price, original_price, coalesce(in_stock, false) AS in_stock, product_url FROM keyed")
def project_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.projected(_products(spark, sf_dir))["listing"].select("variant_key", "price", "original_price", "in_stock", "product_url")


@query(f"{_PR} SELECT product_url, '{I.REJECTED}' AS reason FROM products WHERE NOT ({_GOOD})")
def project_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.projected(_products(spark, sf_dir))["invalid"]


_FIELDS = ["name", "brand", "category", "image_url", "ram", "storage", "chipset"]
_SCORE = " + ".join(f"(coalesce({x}, '') <> '')::INT" for x in _FIELDS)


@query(f"""{_PR}, r AS (SELECT *, coalesce({_BLANK('product_url')}, {_BLANK('url')}) AS key, {_SCORE} AS score, coalesce({_BLANK('store')}, {_BLANK('source')}, 'Unknown') AS e_name FROM products), k AS (SELECT * FROM r WHERE key IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY key, e_name ORDER BY score DESC, ord) AS nth FROM k)
SELECT key AS product_url, {', '.join(f"arg_max(struct_pack(v := {x}), (score, -ord)).v AS {x}" for x in _FIELDS)}, string_agg(e_name, ',' ORDER BY score DESC, ord) FILTER (WHERE nth = 1) AS stores, min(price) FILTER (WHERE nth = 1) AS lowest, bool_or(coalesce(in_stock, true)) FILTER (WHERE nth = 1) AS any_stock, count(*) AS listings FROM f GROUP BY key""")  # fmt: skip
def merge_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.by_url(_products(spark, sf_dir, "phone_id"), _FIELDS, "ord", near="phone_id").withColumn("stores", F.array_join(F.transform("stores", lambda s: s["name"]), ","))


@query(f"""{_PR}, k AS (SELECT coalesce({_BLANK('product_url')}, {_BLANK('url')}) AS key, coalesce(source, '') AS source FROM products), f AS (SELECT source, count(*) AS kept FROM (SELECT key, min(source) AS source FROM k WHERE key IS NOT NULL GROUP BY key) GROUP BY source)
SELECT source, count(*) AS rows, count(*) - count(key) AS without_key, count(key) - coalesce(any_value(kept), 0) AS merged, coalesce(any_value(kept), 0) AS kept FROM k LEFT JOIN f USING (source) GROUP BY source""")  # fmt: skip
def merge_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the rows of each source when products are merged by url."""
    key = F.coalesce(F.nullif(F.trim("product_url"), F.lit("")), F.nullif(F.trim("url"), F.lit("")))
    return I.merge_report(_products(spark, sf_dir), key, "source")


_WEAK = r"concat(lower(trim(coalesce(brand, ''))), '|', regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(name, ''))), '\s+', ' ', 'g'), '\(\d+gb\)', '', 'g'), '\(\d+gb/\d+gb\)', '', 'g'))"
_SPEC_NAMES = ["RAM", "Internal Storage", "Chipset", "Rear Camera setup", "selfie", "Display size", "OS", "5G connectivity", "Weight", "in", "Notch", "face ID unlock", "GPU", "", "Fingerprint Sensor", "SIM", "{type}", "{name}"]
_SPEC_NAME = {"id": "p_partkey", "raw": f"concat({filled(_SPEC_NAMES)}, {filled(['', '', ' {size}', ' type'], 18)})"}
_WIDE = lambda x: f"CASE WHEN {x} = '' THEN {x} " + " ".join("WHEN " + " OR ".join(f"contains(lower(trim({x})), '{v}') OR contains('{v}', lower(trim({x})))" for v in vs) + f" THEN '{n}'" for n, vs in I.WIDE_SPEC_NAMES.items()) + f" ELSE {x} END"
_ENTRIES = "SELECT ord, {key} AS key, unnest(['RAM', 'internal storage', 'Chip', 'weight']) AS spec, unnest([ram, storage, chipset, CASE WHEN ord % 2 = 0 THEN '' ELSE release_year::VARCHAR END]) AS value FROM products"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("spec"), x.alias("value")) for n, x in (("RAM", c("ram")), ("internal storage", c("storage")), ("Chip", c("chipset")), ("weight", F.when(c("ord") % 2 == 0, "").otherwise(c("release_year").cast("string"))))])
    return _products(spark, sf_dir).select("ord", I.weak_key(c("brand"), c("name")).alias("key"), F.explode(pairs).alias("p")).select("ord", "key", "p.*")


@query(f"SELECT id, raw, {_WIDE('raw')} AS name FROM ({rows_sql(_SPEC_NAME)})")
def normalize_spec_names_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _SPEC_NAME).select("id", "raw", I.wide_spec_name(c("raw")).alias("name"))


@query(f"{_PR}, e AS ({_ENTRIES.format(key=_WEAK)}) SELECT key, name, arg_max(value, ord) AS value FROM (SELECT *, {_WIDE('spec')} AS name FROM e) WHERE value <> '' GROUP BY ALL")
def merge_last_value_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.last_values(_entries(spark, sf_dir).withColumnRenamed("spec", "name"), "key", "name", "value", "ord", I.wide_spec_name)


@query(f"{_PR} SELECT key, count(*) AS members, arg_min(struct_pack(v := product_url), ord).v AS first_url, array_to_string(list_sort(list_distinct(list(coalesce({_BLANK('source')}, 'Unknown')))), ',') AS sources FROM (SELECT *, {_WEAK} AS key FROM products) GROUP BY key")
def merge_weak_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _products(spark, sf_dir).withColumns({"key": I.weak_key(c("brand"), c("name")), "from": F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("Unknown"))})
    return rows.groupBy("key").agg(F.count("*").alias("members"), F.min_by("product_url", "ord").alias("first_url"), F.array_join(F.array_sort(F.collect_set("from")), ",").alias("sources"))


_WHOLE = lambda x: f"(CASE WHEN trim({x}) <> '' AND lower(trim({x})) NOT IN ('n/a', 'na', 'none', 'null', '-', '—') THEN trim({x}) END)"
_ORDERED = lambda cond: f"(SELECT coalesce(string_agg(name, ',' ORDER BY n), '') FROM (SELECT name, min(n) AS n FROM st x WHERE x.phone_id = st.phone_id AND {cond} GROUP BY name))"
_BUCKETS = f"""st AS (SELECT phone_id, {_WHOLE('s_name')} AS name, CASE WHEN price > 0 THEN floor(price)::BIGINT END AS whole_price, coalesce(CASE WHEN order_id % 4 = 0 THEN NULL ELSE in_stock END, false) OR coalesce(lower({_WHOLE(PRODUCT['stock_status'])}) = 'in stock', false) AS stocked, row_number() OVER (PARTITION BY phone_id ORDER BY order_id, line, store_id, price) AS n FROM listings JOIN supplier ON store_id = s_suppkey),
names AS (SELECT phone_id, name, min(n) FILTER (WHERE whole_price IS NOT NULL) AS a, min(n) FILTER (WHERE stocked) AS i, min(n) FILTER (WHERE NOT stocked) AS o FROM st GROUP BY ALL),
buckets AS (SELECT phone_id, (SELECT min(whole_price) FROM st x WHERE x.phone_id = n.phone_id) AS lowest, (SELECT max(whole_price) FROM st x WHERE x.phone_id = n.phone_id) AS highest, {', '.join(f"list(name ORDER BY {k}) FILTER (WHERE {k} IS NOT NULL) AS {b}" for k, b in (('a', 'available'), ('i', 'in_stock'), ('o', 'out_of_stock')))} FROM names n GROUP BY phone_id)"""  # fmt: skip


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).join(stores(spark, sf_dir), "store_id").selectExpr("phone_id", "order_id", "line", "store_id", "store_name AS name", "price", f"{PRODUCT['in_stock']} AS in_stock", f"{PRODUCT['stock_status']} AS stock_status")
    return I.store_buckets(rows, "phone_id", [c("order_id"), c("line"), c("store_id"), c("price").asc_nulls_last()])


@query(f"WITH listings AS ({LISTINGS_SQL}), {_BUCKETS} SELECT phone_id, lowest, highest, {', '.join(f'''coalesce(array_to_string({b}, ','), '') AS {b}''' for b in ('available', 'in_stock', 'out_of_stock'))} FROM buckets")
def store_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(spark, sf_dir).select("phone_id", "lowest", "highest", *[F.array_join(b, ",").alias(b) for b in ("available", "in_stock", "out_of_stock")])


_CHILD = "SELECT phone_id, store_id, order_id, line, price FROM listings WHERE"


@query(f"WITH listings AS ({LISTINGS_SQL}), old AS ({_CHILD} order_id % 3 <> 0), new AS ({_CHILD} order_id % 3 = 0 AND phone_id % 4 = 0) SELECT * FROM old WHERE phone_id NOT IN (SELECT phone_id FROM new) UNION ALL (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY phone_id, store_id ORDER BY order_id, line, price NULLS FIRST) = 1)")
def listings_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("phone_id", "store_id", "order_id", "line", "price")
    return I.replace_children(rows.where("order_id % 3 != 0"), rows.where("order_id % 3 = 0 and phone_id % 4 = 0"), "phone_id", ["store_id"], [c("order_id"), c("line"), c("price").asc_nulls_first()])


@query(f"WITH phones AS ({PHONES_SQL}), listings AS ({LISTINGS_SQL}) SELECT 'phones' AS tab, id, count(*) AS rows FROM phones WHERE id % 5 <> 0 GROUP BY ALL UNION ALL SELECT 'listings', phone_id, count(*) FROM listings WHERE phone_id % 5 <> 0 GROUP BY ALL")
def prune_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = phones(spark, sf_dir).select("id", F.concat(F.lit("u"), "id").alias("url"))
    kept, children = I.prune(parents, listings(spark, sf_dir).select(c("phone_id").alias("id"), "price"), parents.where("id % 5 = 0").select("url"), "url", "id")
    count = lambda df, name: df.groupBy("id").agg(F.count("*").alias("rows")).select(F.lit(name).alias("tab"), "id", "rows")
    return count(kept, "phones").unionAll(count(children, "listings"))


@query(f"""WITH phones AS ({PHONES_SQL}), old AS (SELECT brand, name, row_number() OVER (ORDER BY brand, name) AS model_id FROM (SELECT DISTINCT brand, name FROM phones WHERE id % 3 = 0)), new AS (SELECT DISTINCT brand, name FROM phones EXCEPT SELECT brand, name FROM old)
SELECT * FROM old UNION ALL SELECT brand, name, (SELECT max(model_id) FROM old) + row_number() OVER (ORDER BY brand, name) FROM new""")  # fmt: skip
def models_found_or_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phones(spark, sf_dir).select("brand", "name")
    none = spark.createDataFrame([], "brand string, name string, model_id int")
    old = I.numbered(none, phones(spark, sf_dir).where("id % 3 = 0"), ["brand", "name"], "model_id")
    return I.numbered(old, rows, ["brand", "name"], "model_id")


_STORED = "stored AS (SELECT doc_id AS id, sha2 AS doc_hash FROM (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS sha2 FROM documents WHERE doc_id % 5 <> 0) UNION ALL SELECT -1, 'x')"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(c("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(c("text"))
    old = table(spark, sf_dir, "documents").where("doc_id % 5 != 0").select(c("doc_id").alias("id"), I.doc_hash(text).alias("doc_hash"))
    return old.unionByName(spark.createDataFrame([(-1, "x")], "id long, doc_hash string"))


@query(f"WITH {_STORED} SELECT doc_id AS id, sha256(text) AS doc_hash, 'embed' AS what FROM documents d WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.id = d.doc_id AND s.doc_hash = sha256(d.text)) UNION ALL SELECT id, NULL, 'delete' FROM stored WHERE id NOT IN (SELECT doc_id FROM documents)")
def embed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), "text")
    changed, gone = I.to_embed(docs, _stored(spark, sf_dir))
    return changed.select("id", "doc_hash", F.lit("embed").alias("what")).unionAll(gone.select("id", F.lit(None).cast("string").alias("doc_hash"), F.lit("delete").alias("what")))


_COLLECTION = "base AS (SELECT vec_id AS id, 'l' || label AS label, embedding[1] AS e1 FROM embeddings WHERE vec_id % 3 <> 0), batch AS (SELECT vec_id AS id, 'b' || label AS label, embedding[2] AS e1 FROM embeddings WHERE vec_id % 2 = 0)"


@query(f"WITH {_COLLECTION}, u AS (SELECT * FROM base WHERE id NOT IN (SELECT id FROM batch) UNION ALL SELECT * FROM batch), ch AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'changed' ELSE '' END AS label FROM u WHERE id % 8 IN (0, 2)) SELECT u.id, coalesce(nullif(ch.label, ''), u.label) AS label, round(e1, 6) AS e1 FROM u LEFT JOIN ch USING (id) WHERE NOT (u.id % 10 = 4 AND coalesce(nullif(ch.label, ''), u.label) <> 'b3')")
def vectors_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection after an upsert with a check of dimensions, a partial update, and a delete by ids and a condition."""
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    base = v.where("id % 3 != 0").select("id", F.concat(F.lit("l"), "label").alias("label"), "embedding", c("embedding")[0].alias("e1"))
    batch = v.where("id % 2 = 0").select("id", F.concat(F.lit("b"), "label").alias("label"), "embedding", c("embedding")[1].alias("e1"))
    all_ = I.upsert_vectors(base, batch, "id", 64)
    all_ = I.update_vectors(all_, all_.where("id % 8 in (0, 2)").select("id", F.when(c("id") % 4 == 0, "changed").otherwise("").alias("label")), "id", ["label"])
    return I.delete_vectors(all_, all_.where("id % 10 = 4"), c("label") != "b3").select("id", "label", F.round("e1", 6).alias("e1"))


@query("SELECT doc_id AS id, concat_ws(',', 'lang=' || lang, 'n_chars=' || n_chars, 'source=' || source) AS metadata, round(embedding[1]::DOUBLE, 6) AS e1 FROM documents JOIN embeddings ON vec_id = doc_id")
def vectors_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    found = I.assembled(docs, table(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), "embedding"))
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("id", F.array_join(pairs, ",").alias("metadata"), F.round(c("embedding")[0].cast("double"), 6).alias("e1"))


@query(f"WITH phones AS ({PHONES_SQL}) SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN ram_gb || ' GB' END, ram_gb || '') AS ram, battery_text AS battery, processor_text AS processor, os, network, NULL AS charging FROM phones")
def specs_hoisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), x.cast("string").alias("v")) for k, x in (("ram", c("ram_gb")), ("battery", c("battery_text")), ("processor", c("processor_text")), ("os", c("os")), ("network", c("network")))])
    specs = F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))
    df = phones(spark, sf_dir).select("id", F.when(c("id") % 2 == 0, F.concat(c("ram_gb").cast("string"), F.lit(" GB"))).alias("ram"), specs.alias("merged_specs"))
    return I.hoisted(df).select("id", "ram", "battery", "processor", "os", "network", "charging")


_SIZES = {"id": "p_partkey", "v": filled(["{m}", "1.5", "{gb}.0", "{k} TB", "big", None, "0", "5{size}.0", "TB {size}"]), "r": filled(["", "{k}6GB {gb}GB RAM", "{gb}GB RAM", "6{size} GB"], 2)}
_TIMES = {"id": "p_partkey", "t": filled(["{year}-05-06T07:08:{k}Z", "{year}-05-06T07:08:09+06:00", "{year}-11-{k} 07:08:09", "yesterday {id}", "", None, "{year}-0{size}-06T07:08:09-03:30"])}
_SAID = {"id": "p_partkey", "t": filled(["n/a", " N/A ", "None", "—", "-", " {name} ", "", None, "null", "nullable {id}", "{brand}", "na"])}
_size = "try_cast(v AS DOUBLE)"


@query(f"SELECT id, coalesce(CASE WHEN {_size} > 0 AND contains(v, '.') AND {_size} < 16 THEN trunc({_size} * 1024)::INT WHEN {_size} > 0 THEN trunc({_size})::INT END, nullif(regexp_extract(v, '(?i)([0-9]+)[ ]*TB', 1), '')::INT * 1024, nullif(regexp_extract(r, '(?i)([0-9]{{2,4}})[ ]*GB', 1), '')::INT) AS gb FROM ({rows_sql(_SIZES)})")
def storage_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _SIZES).select("id", I.storage_gb(c("v"), c("r")).alias("gb"))


@query(f"SELECT id, strftime(try_cast(t AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS moment FROM ({rows_sql(_TIMES)})")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _TIMES).select("id", F.date_format(I.moment(c("t")), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query(f"SELECT id, {_WHOLE('t')} AS said FROM ({rows_sql(_SAID)})")
def placeholders_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _SAID).select("id", I.whole(c("t")).alias("said"))


@query(f"WITH phones AS ({PHONES_SQL}), listings AS ({LISTINGS_SQL}) SELECT id, name, count(phone_id) AS listings, string_agg(store_id || ':' || coalesce(price::BIGINT::VARCHAR, '-'), ',' ORDER BY order_id, line, store_id, price NULLS FIRST) AS stores FROM phones LEFT JOIN listings ON phone_id = id GROUP BY id, name")
def phones_with_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = listings(spark, sf_dir).groupBy(c("phone_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("order_id", "line", "store_id", "price"))).alias("l"))
    shown = F.transform("l", lambda x: F.concat(x["store_id"].cast("string"), F.lit(":"), F.coalesce(x["price"].cast("long").cast("string"), F.lit("-"))))
    return phones(spark, sf_dir).select("id", "name").join(own, "id", "left").select("id", "name", F.coalesce(F.size("l"), F.lit(0)).alias("listings"), F.array_join(shown, ",").alias("stores"))
