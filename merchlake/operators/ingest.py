"""From scraped products to catalog rows: projections, rejects, merging by several keys, child listings, vectors by hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.operators.entities import upsert
from merchlake.sources.scratch import kept

c = F.col
# Specifications that a record has at its top level too, in this order
TOP_LEVEL = ["ram", "storage", "battery", "display", "rear_camera", "front_camera", "processor", "operating_system", "os", "network", "charging"]
# Standard names by any variant that is part of a name, or that the name is part of; the first match wins
WIDE_SPEC_NAMES = {
    "ram": ["ram", "memory", "memory size", "ram size", "system memory"],
    "processor": ["processor", "chipset", "cpu", "soc", "system on chip", "chip"],
    "battery": ["battery", "battery capacity", "battery size", "power", "battery type"],
    "rear_camera": ["rear camera", "main camera", "back camera", "primary camera", "rear camera setup"],
    "front_camera": ["front camera", "selfie camera", "front facing camera", "selfie"],
    "storage": ["storage", "rom", "internal storage", "memory storage", "storage capacity"],
    "display": ["display", "screen", "display size", "screen size", "panel", "display type"],
    "os": ["os", "operating system", "android version", "ios version", "software"],
    "network": ["network", "network type", "connectivity", "network support", "generation"],
    "weight": ["weight", "device weight"],
    "dimensions": ["dimensions", "size", "body dimensions"],
    "sim": ["sim", "sim type", "sim slot"],
    "gpu": ["gpu", "graphics", "graphics processor"],
    "nfc": ["nfc", "near field communication"],
    "fingerprint": ["fingerprint", "fingerprint sensor", "fingerprint scanner"],
    "face_unlock": ["face unlock", "face recognition", "face id"],
}
REJECTED = "missing name/price/url"


def whole(text: Column) -> Column:
    """Null for null, blank and placeholder texts, else the trimmed text."""
    t = F.trim(text)
    return F.when((t != "") & ~F.lower(t).isin("n/a", "na", "none", "null", "-", "—"), t)


def wide_spec_name(raw: Column) -> Column:
    """The standard name of a specification by parts in both directions; the name itself if none fits."""
    low = F.lower(F.trim(raw))
    fits = lambda vs: F.exists(F.array(*[F.lit(v) for v in vs]), lambda v: F.contains(low, v) | F.contains(v, low))
    return F.when(raw == "", raw).otherwise(T.ladder([(fits(vs), n) for n, vs in WIDE_SPEC_NAMES.items()], raw))


def weak_key(brand: Column, name: Column) -> Column:
    """A product key that takes out no more than sizes in brackets."""
    n = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+", " ")
    n = F.regexp_replace(F.regexp_replace(n, r"\(\d+gb\)", ""), r"\(\d+gb/\d+gb\)", "")
    return F.concat(F.lower(F.trim(F.coalesce(brand, F.lit("")))), F.lit("|"), n)


def last_values(entries: DataFrame, key: str, name: str, value: str, order: str, standard: Callable[[Column], Column] | None = None) -> DataFrame:
    """Of each key and name, the last value that is not empty; names are made `standard` once for each key and name, not for each entry."""
    last = entries.where((c(value) != "") & c(value).isNotNull()).groupBy(key, name).agg(F.max(F.struct(order, value)).alias("last"))
    if standard is not None:
        last = last.withColumn(name, standard(c(name))).groupBy(key, name).agg(F.max("last").alias("last"))
    return last.select(key, name, c(f"last.{value}").alias(value))


def projected(products: DataFrame, default_brand: str = "Unknown") -> dict[str, DataFrame]:
    """A scrape's products as store, model, variant and listing rows, and the `invalid` ones that lack name, price or url.

    `products` has store, store_url, name, brand, category, image_url, release_year, ram, storage, chipset, price,
    original_price, in_stock, product_url, scraped_at. Names and urls count as missing when empty.
    """
    brand = F.coalesce(T.blank_to_null(c("brand")), F.lit(default_brand))
    good = (F.coalesce(c("name"), F.lit("")) != "") & c("price").isNotNull() & (F.coalesce(c("product_url"), F.lit("")) != "")
    p = products.where(good).withColumns({"brand": brand, "market_version": F.lit("official"), "category_tags": category_tags(c("category"))})
    p = p.withColumn("variant_key", variant_key(c("brand"), c("name"), c("market_version"), c("ram"), c("storage")))
    return {
        "store": p.select(c("store").alias("name"), c("store_url").alias("url")).distinct(),
        "model": p.groupBy("brand", c("name").alias("model_name")).agg(F.min_by(F.struct("category_tags", "image_url", "release_year"), "product_url").alias("m")).select("brand", "model_name", "m.*"),
        "variant": p.groupBy("variant_key").agg(F.min_by(F.struct("brand", c("name").alias("model_name"), "market_version", "ram", "storage", "chipset"), "product_url").alias("v")).select("variant_key", "v.*"),
        "listing": p.select("variant_key", "store", "price", "original_price", F.coalesce("in_stock", F.lit(False)).alias("in_stock"), "product_url", "scraped_at"),
        "invalid": products.where(~good).select("product_url", F.lit(REJECTED).alias("reason")),
    }


def variant_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[F.coalesce(T.blank_to_null(T.slugify(p.cast("string"))), F.lit("na")) for p in parts])


def category_tags(category: Column) -> Column:
    return F.filter(F.transform(F.split(category, "[,/>]"), lambda t: F.trim(t)), lambda t: t != "")


def store_entry(products: DataFrame) -> Column:
    """One store's view of a product as a struct, with the fallbacks of its fields."""
    first = lambda *names: F.coalesce(*[T.blank_to_null(c(n)) for n in names])
    return F.struct(
        F.coalesce(first("store", "source"), F.lit("Unknown")).alias("name"), first("product_url", "url").alias("url"), c("price"), c("original_price"),
        F.coalesce("in_stock", F.lit(True)).alias("in_stock"), c("stock_status"), c("scraped_file"),
    )


def completeness(columns: list[str]) -> Column:
    """How many of the columns hold something."""
    out = F.lit(0)
    for n in columns:
        out = out + F.when(c(n).cast("string").isNotNull() & (c(n).cast("string") != ""), 1).otherwise(0)
    return out


def by_url(products: DataFrame, fields: list[str], order: str, near: str | None = None) -> DataFrame:
    """One record a product url: the fullest row's fields, all different store entries, the lowest price, any stock.

    Rows without a url are dropped. `order` breaks ties and settles the order of entries, of which the first of each name
    and url stays. A record's fields are those of its first entry, so only first rows go on. Where rows are dealt by a
    column `near` already, with most rows of a url in one part, the first ones are found there, and only they are dealt by url.
    """
    rows = products.withColumns({"key": F.coalesce(T.blank_to_null(c("product_url")), T.blank_to_null(c("url"))), "entry": store_entry(products), "score": completeness(fields)}).where("key is not null")
    rank = F.struct("score", -c(order))
    one = [*([near] if near else []), "key", c("entry.name").alias("_name"), c("entry.url").alias("_url")]
    first = rows.groupBy(*one).agg(F.max(rank).alias("rank"), F.max_by(F.struct(F.struct(*fields).alias("base"), "entry", c(order).alias("o")), rank).alias("first"), F.count("*").alias("n"))
    # dealt by url once, for both groupings
    first = first.repartition("key").groupBy("key", "_name", "_url").agg(F.max("rank").alias("rank"), F.max_by("first", "rank").alias("first"), F.sum("n").alias("n"))
    entry = F.struct((-c("rank.score")).alias("s"), c("first.o").isNull().alias("last"), c("first.o").alias("o"), c("first.entry").alias("e"))
    g = first.groupBy("key").agg(F.max_by("first.base", "rank").alias("base"), F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("stores"), F.sum("n").alias("listings"))
    return g.select(c("key").alias("product_url"), "base.*", "stores", F.array_min(F.transform("stores", lambda s: s["price"])).alias("lowest"), F.exists("stores", lambda s: s["in_stock"]).alias("any_stock"), "listings")


def merge_report(products: DataFrame, key: Column, source: str) -> DataFrame:
    """(source, rows, without_key, merged, kept): of each source how many rows came, had no key, went into a record of another, and made one.

    The record of a key counts for the first source by name. The sources' numbers add up to those of the whole.
    """
    rows = products.select(key.alias("key"), F.coalesce(source, F.lit("")).alias("source"))
    firsts = rows.where("key is not null").groupBy("key").agg(F.min("source").alias("source")).groupBy("source").agg(F.count("*").alias("kept"))
    counted = rows.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(c("key").isNull()).alias("without_key"))
    made = F.coalesce("kept", F.lit(0))
    return counted.join(firsts, "source", "left").select("source", "rows", "without_key", (c("rows") - c("without_key") - made).alias("merged"), made.alias("kept"))


def hoisted(records: DataFrame, specs: str = "merged_specs") -> DataFrame:
    """The known specifications as columns of their own where they are missing, from the map."""
    return records.withColumns({n: F.coalesce(c(n), F.element_at(specs, n)) if n in records.columns else F.element_at(specs, F.lit(n)) for n in TOP_LEVEL})


def store_buckets(listings: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """(key, lowest, highest, available, in_stock, out_of_stock): names of stores by first appearance, each once a list.

    `listings` has key, name, price, in_stock, stock_status. A store has the product if it gives a price above 0; it has it
    in stock if it says so, or where it only has a status, if that is "in stock". A store may be in both lists.
    """
    rows = listings.withColumn("name", whole(c("name"))).where("name is not null")
    stock = F.coalesce(c("in_stock"), F.lit(False)) | F.coalesce(F.lower(whole(c("stock_status"))) == "in stock", F.lit(False))
    rows = rows.withColumns({"whole_price": F.when(c("price") > 0, F.floor("price")), "stocked": stock, "n": F.row_number().over(Window.partitionBy(key).orderBy(*order))})
    of = lambda condition: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("n", "name")))), lambda x: x["name"]))
    return rows.groupBy(key).agg(F.min("whole_price").alias("lowest"), F.max("whole_price").alias("highest"), of(c("whole_price").isNotNull()).alias("available"), of(c("stocked")).alias("in_stock"), of(~c("stocked")).alias("out_of_stock"))


def replace_children(old: DataFrame, new: DataFrame, key: str, unique: list[str], order: list[Column]) -> DataFrame:
    """Child rows after an import: those of the keys in `new` are replaced, the first of each `unique` stays; others are kept."""
    first = Window.partitionBy(key, *unique).orderBy(*order)
    fresh = new.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(fresh)


def prune(parents: DataFrame, children: DataFrame, removed: DataFrame, url: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents without the removed urls, and children without the rows of those parents."""
    gone = parents.join(removed.select(url).distinct(), url, "left_semi").select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def numbered(old: DataFrame, wanted: DataFrame, unique: list[str], key: str) -> DataFrame:
    """A dimension with the wanted rows found or created; new ones are numbered after the greatest old number, by their names.

    New rows are written in ranges of their names, which are counted; a row's number is its place in its range after
    those of the ranges before. So no task has them all.
    """
    new = wanted.select(*unique).distinct().join(old, unique, "left_anti")
    ranged = kept(new.repartitionByRange(*unique).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*unique))
    added = ranged.withColumn("place", place).join(starts, "range").join(top).select(*unique, (c("top") + c("start") + c("place")).alias(key))
    return old.select(*unique, key).unionByName(added)


def doc_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def to_embed(docs: DataFrame, stored: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Documents (key, text) whose hash differs from the stored one, or that are new; and the stored keys that are gone."""
    hashed = docs.withColumn("doc_hash", doc_hash(c("text")))
    changed = hashed.join(stored.select(key, "doc_hash"), [key, "doc_hash"], "left_anti")
    return changed, stored.select(key).join(docs.select(key), key, "left_anti")


def checked_vectors(vectors: DataFrame, dimension: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Vectors, with an error at run time for one without an id or of another dimension."""
    ok = F.assert_true(c(key).isNotNull() & (F.size(vector) == dimension), F.format_string("vector of id %s has %d components, not %d", c(key).cast("string"), F.size(vector), F.lit(dimension)))
    return vectors.where(ok.isNull())


def upsert_vectors(stored: DataFrame, batch: DataFrame, key: str = "id", dimension: int | None = None) -> DataFrame:
    """The collection with a batch in place of, or beside, its rows; the dimension is checked if given."""
    return upsert(stored, checked_vectors(batch, dimension, key) if dimension else batch, key)


def update_vectors(stored: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the given columns changed where the change is not null or empty; an unknown id is an error."""
    missing = changes.join(stored.select(key), key, "left_anti").select(key).take(1)
    if missing:
        raise LookupError(f"no such id: {missing[0][0]}")
    new = changes.select(key, *[c(n).alias(f"new_{n}") for n in columns])
    given = lambda n: F.when(c(f"new_{n}").isNotNull() & (F.coalesce(c(f"new_{n}").cast("string"), F.lit("")) != ""), c(f"new_{n}")).otherwise(c(n))
    return stored.join(new, key, "left").select(*[given(n).alias(n) if n in columns else c(n) for n in stored.columns])


def delete_vectors(stored: DataFrame, ids: DataFrame | None = None, where: Column | None = None, key: str = "id") -> DataFrame:
    """The collection without the given ids, or the rows that a condition holds for, or both at once where both are given."""
    if ids is None and where is None:
        raise ValueError("nothing says what to delete")
    marked = stored if ids is None else stored.join(ids.select(key).distinct(), key, "left_semi")
    marked = marked if where is None else marked.where(where)
    return stored.join(marked.select(key).distinct(), key, "left_anti")


def assembled(docs: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Documents with their vectors and the metadata as strings; documents without a vector are left out."""
    meta = [n for n in docs.columns if n not in (key, "text")]
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), c(n).cast("string").alias("v")) for n in meta])
    kept = F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))
    return docs.select(key, "text", kept.alias("metadata")).join(vectors, key)


def storage_gb(value: Column, ram_text: Column) -> Column:
    """Storage in GB: a number (below 16 with a fraction: TB), digits, TB in the text, or the first size of the memory text."""
    n = value.try_cast("double")
    fraction = F.contains(value, F.lit("."))
    return F.coalesce(
        F.when((n > 0) & fraction & (n < 16), n * 1024).when(n > 0, n).cast("int"),
        (T.first_match(value, r"(?i)(\d+)\s*TB").cast("int") * 1024).cast("int"),
        T.first_match(ram_text, r"(?i)(\d{2,4})\s*GB").cast("int"),
    )


def moment(text: Column) -> Column:
    """An ISO time, with Z or an offset or neither (which means UTC), as a timestamp; null if it is none."""
    return F.to_utc_timestamp(F.try_to_timestamp(text), F.lit("UTC"))
