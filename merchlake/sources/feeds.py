"""Readers of scrape results, documents, catalogs and tables; whatever the shape of the JSON, rows of products come out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchlake.functions.text import squeeze
from merchlake.operators.entities import source_of_file

c = F.col


def scrape_files(spark: SparkSession, *folders: str) -> DataFrame:
    """(file, path, content) of the JSON files in the folders; a file name counts once, from the first folder that has it.

    Error reports are passed over. Empty files stay, so that they can be counted.
    """
    found = None
    for rank, folder in enumerate(folders):
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
        files = files.select(c("_metadata.file_name").alias("file"), c("_metadata.file_path").alias("path"), c("value").alias("content"), F.lit(rank).alias("rank"))
        found = files if found is None else found.unionAll(files)
    once = Window.partitionBy("file").orderBy("rank", "path")
    return found.where(~F.contains(F.lower("file"), F.lit("errors"))).withColumn("n", F.row_number().over(once)).where("n = 1").select("file", "path", "content")


def product_rows(files: DataFrame) -> DataFrame:
    """(file, source, pos, product): a row a product, as a variant.

    The root is a list, or an object whose products, items or data is one, or whose first list of objects is. Files
    that are empty or not JSON give no rows; `load_report` counts them.
    """
    root = F.try_parse_json("content")
    as_list = lambda path: F.try_variant_get("v", path, "array<variant>")
    fields = F.map_values(F.try_variant_get("v", "$", "map<string,variant>"))
    lists = F.filter(F.transform(fields, lambda x: F.try_variant_get(x, "$", "array<variant>")), lambda x: F.size(x) > 0)
    objects = lambda x: F.filter(x, lambda p: F.startswith(F.schema_of_variant(p), F.lit("OBJECT")))
    rows = F.coalesce(as_list("$"), as_list("$.products"), as_list("$.items"), as_list("$.data"), F.get(F.filter(lists, lambda x: F.size(objects(x)) > 0), F.lit(0)))
    parsed = files.withColumn("v", root).where("v is not null").select("file", F.posexplode(objects(rows)).alias("pos", "product"))
    return parsed.select("file", source_of_file(c("file")).alias("source"), "pos", "product")


def load_report(files: DataFrame) -> DataFrame:
    """(state, files): loaded, empty and invalid files."""
    state = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty").when(F.try_parse_json("content").isNull(), "invalid").otherwise("loaded")
    return files.groupBy(state.alias("state")).agg(F.count("*").alias("files"))


#: Fields of a canonical product and their types.
FIELDS = {"productUrl": "string", "name": "string", "brand": "string", "category": "string", "price": "double", "originalPrice": "double", "inStock": "boolean", "shortDescription": "string"}


def canonical(products: DataFrame) -> DataFrame:
    """Products with typed columns, a flat map of specifications, and url in place of a missing productUrl."""
    get = lambda name, kind: F.try_variant_get("product", f"$.{name}", kind)
    columns = [get(n, k).alias(n) for n, k in FIELDS.items() if n != "productUrl"]
    return products.select("file", "source", "pos", F.coalesce(get("productUrl", "string"), get("url", "string")).alias("productUrl"), *columns, flat_specs(F.try_variant_get("product", "$.specs", "map<string,variant>")).alias("specs"))


def flat_specs(specs: Column) -> Column:
    """A map of names to texts; entries of nested objects are lifted, as deep as sections go (one level)."""
    entries = F.map_entries(specs)
    inner = lambda e: F.try_variant_get(e["value"], "$", "map<string,string>")
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    lifted = F.transform(entries, lambda e: F.coalesce(F.transform(F.map_entries(inner(e)), lambda x: pair(x["key"], x["value"])), F.array(pair(e["key"], F.try_variant_get(e["value"], "$", "string")))))
    flat = F.flatten(lifted)
    names = F.array_distinct(F.transform(flat, lambda e: e["key"]))
    # the last value of a repeated name stays
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(flat, lambda e: e["key"] == n), -1)["value"]))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) rows of a JSON-lines file; a line that is not JSON is an error."""
    return spark.read.schema("id string, text string").option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of lines that are neither blank nor a JSON object; lines are numbered from 1.

    All files are gone through line by line; only those that have such a line are read whole, to number their lines.
    """
    bad = lambda x: (F.trim(x) != "") & ~F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(x)), F.lit("OBJECT")), F.lit(False))
    wrong = spark.read.text(path).where(bad(c("value"))).select(c("_metadata.file_path").alias("file")).distinct()
    whole = spark.read.text(path, wholetext=True).select(c("_metadata.file_path").alias("file"), "value").join(wrong, "file", "left_semi")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n"))).select("file", (c("pos") + 1).alias("line"), c("col").alias("text")).where(bad(c("text")))


def csv_catalog(spark: SparkSession, path: str, sections: list[str]) -> DataFrame:
    """A catalog from CSV with a header: brand, name, and a map of those sections that are filled."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    pairs = F.array(*[F.struct(F.lit(s).alias("key"), squeeze(c(f"`{s}`")).alias("value")) for s in sections])
    return raw.select("brand", "name", F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")).alias("sections"))


def variant_rollup(variants: Column) -> Column:
    """Of an array of variants (price, compare_at, available): least positive price, highest reference price above it, whether any is there."""
    least = F.array_min(F.filter(F.transform(variants, lambda v: v["price"]), lambda p: p > 0))
    most = F.array_max(F.filter(F.transform(variants, lambda v: v["compare_at"]), lambda p: p > 0))
    return F.struct(least.alias("price"), F.when(most > least, most).alias("original_price"), F.exists(variants, lambda v: v["available"]).alias("in_stock"))


def price_range(text: Column) -> Column:
    """Low and high of a price text such as 12,000 - 15,500; one price is low alone."""
    numbers = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[\d,]*\d"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("long")), lambda n: n.isNotNull())
    low, high = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    return F.struct(low.alias("price"), F.when(high > low, high).alias("original_price"))


def catalog_brands(spark: SparkSession, path: str) -> DataFrame:
    """(brand, first_row, phones) of a CSV catalog: each brand by its first row, with its count of rows."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = raw.select(squeeze(c("brand")).alias("brand"), F.monotonically_increasing_id().alias("row")).where("brand != ''")
    return rows.groupBy("brand").agg(F.min("row").alias("first_row"), F.count("*").alias("phones"))


def stable(record: DataFrame, volatile: list[str], nested: str = "stores") -> DataFrame:
    """Records without the volatile fields, at the top and in the structs of the nested array."""
    out = record.drop(*volatile)
    inside = [f.name for f in record.schema[nested].dataType.elementType.fields if f.name in volatile]
    return out.withColumn(nested, F.transform(nested, lambda s: s.dropFields(*inside))) if inside else out


def flattened_rows(records: DataFrame, key: str, json: str, joint: str = "_") -> DataFrame:
    """(key, name, value): the entries of JSON objects nested to any depth, as one level.

    Names of inner entries stand behind those of the outer ones. A recursive query opens one level a step until there are
    no more objects; empty objects and nulls are left out, lists are texts. Of entries that come to the same name the
    last by its value stays.
    """
    records.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # else a million rows end it with an error
    variant = F.try_variant_get(F.try_parse_json(c(json)), "$", "map<string,variant>")
    entries = records.select(c(key).alias("key"), F.explode(variant).alias("name", "value"))
    view = f"entries_{uuid.uuid4().hex}"
    entries.createOrReplaceTempView(view)
    try:
        found = records.sparkSession.sql(f"""
            WITH RECURSIVE opened(key, name, value) MAX RECURSION LEVEL 10000 AS (
              SELECT key, name, value FROM {view}
              UNION ALL
              SELECT key, concat(name, '{joint}', inner_name), inner_value
              FROM opened, LATERAL explode(try_variant_get(value, '$', 'map<string,variant>')) AS e(inner_name, inner_value)
            )
            SELECT key, name, max(try_variant_get(value, '$', 'string')) AS value FROM opened
            WHERE schema_of_variant(value) NOT LIKE 'OBJECT%' AND schema_of_variant(value) <> 'VOID' GROUP BY key, name
        """)
    finally:
        records.sparkSession.catalog.dropTempView(view)
    return found.select(c("key").alias(key), "name", "value")
