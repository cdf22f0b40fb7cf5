"""Answers as Markdown, templates, and the order in which specifications are shown."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.operators.requests import display_label

c = F.col
# Sections of a specification table in the order in which they are shown; others follow by name
SECTIONS = ["Network", "Launch", "Body", "Display", "Platform", "Memory", "Main Camera", "Selfie camera", "Sound", "Comms", "Features", "Battery", "Misc", "Our Tests", "EU LABEL"]


def lines(rows: DataFrame, key: str, order: list[str], line: Column) -> DataFrame:
    """(key, text): the lines of each key in order."""
    item = F.struct(*order, line.alias("line"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("text"))


def money(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit("৳"), F.format_number(F.floor(x), 0)), F.lit("—"))


def spec_table(described: DataFrame, phones: DataFrame) -> DataFrame:
    """(id, markdown) of the fields of `specs.described`, in their order."""
    from merchlake.operators.specs import LABELS

    order = F.array_position(F.array(*[F.lit(k) for k in LABELS]), c("field"))
    value = F.concat("display", F.when(c("summary") != "", " _(see source)_").otherwise(""))
    body = lines(described.withColumn("ord", order), "id", ["ord"], F.concat(F.lit("| **"), "label", F.lit("** | "), value, F.lit(" |")))
    head = F.concat(F.lit("# "), display_label(c("brand"), c("name")), F.lit(" — specifications\n\n| Field | Value |\n|---|---|\n"))
    return phones.select("id", "brand", "name").join(body, "id").select("id", F.concat(head, "text", F.lit("\n")).alias("markdown"))


def price_table(ranked_offers: DataFrame, phones: DataFrame) -> DataFrame:
    """(id, markdown) of the ranked offers (`pricing.by_rank`) of each product: headline numbers and a row a store."""
    o = ranked_offers.withColumn("id", c("phone_id"))
    pct = F.when(c("original_price") > 0, F.floor(c("discount_amount") / c("original_price") * 100 + 0.5))
    cut = F.coalesce(F.concat(money(c("discount_amount")), F.when(pct > 0, F.concat(F.lit(" ("), pct.cast("string"), F.lit("%)"))).otherwise("")), F.lit("—"))
    row = F.concat(F.lit("| "), "store_name", F.lit(" | "), money(c("price")), F.lit(" | "), money(c("original_price")), F.lit(" | "), cut, F.lit(" | "), F.when(c("in_stock"), "In stock").otherwise("Out of stock"), F.lit(" |"))
    body = lines(o, "id", ["offer_rank"], row)
    priced = F.when(c("price").isNotNull(), F.struct("price", "offer_rank"))
    far = F.when(c("price").isNotNull(), F.struct(c("price"), -c("offer_rank")))
    s = o.groupBy("id").agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.bround(F.avg("price"), 2).alias("mean"), F.min_by("store_name", priced).alias("cheap"), F.max_by("store_name", far).alias("dear"), F.count_if("in_stock").alias("n_in"), F.count_if(~c("in_stock")).alias("n_out"))
    spread = F.when(c("hi") > 0, F.bround((c("hi") - c("lo")) / c("hi") * 100, 2))
    head = F.concat_ws(
        " · ",
        F.when(c("lo").isNotNull(), F.concat(F.lit("**Cheapest:** "), "cheap", F.lit(" — "), money(c("lo")))),
        F.when(c("hi") > c("lo"), F.concat(F.lit("**Highest:** "), "dear", F.lit(" — "), money(c("hi")))),
        F.when(c("mean") != 0, F.concat(F.lit("**Average:** "), money(c("mean")))),
        F.concat(F.lit("**Stock:** "), c("n_in").cast("string"), F.lit(" in, "), c("n_out").cast("string"), F.lit(" out")),
        F.when(spread != 0, F.concat(F.lit("**Spread:** "), F.format_string("%.1f", F.bround(spread, 1)), F.lit("%"))),
    )
    title = F.concat(F.lit("# "), display_label(c("brand"), c("name")), F.lit(" — pricing\n\n"))
    table = F.concat(F.lit("\n\n| Store | Price | Original | Discount | Stock |\n|---|---|---|---|---|\n"), "text", F.lit("\n"))
    return phones.select("id", "brand", "name").join(s, "id").join(body, "id").select("id", F.concat(title, head, table).alias("markdown"))


def compare_table(long: DataFrame, phones: DataFrame) -> DataFrame:
    """(dimension, row): the rows of a table of scores (`comparison.dimensions`), the winner's in bold, products by id."""
    w = Window.partitionBy("dimension")
    hi, lo = F.max("score").over(w), F.min("score").over(w)
    best = F.row_number().over(w.orderBy(F.desc("score"), "id")) == 1
    cell = F.format_string("%.2f", "score")
    rows = long.withColumn("cell", F.when(best & (hi - lo >= 0.02), F.concat(F.lit("**"), cell, F.lit("**"))).otherwise(cell))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "cell"))), lambda x: x["cell"]), " | ")
    return rows.groupBy("dimension", "ord").agg(joined.alias("cells")).select("dimension", F.concat(F.lit("| "), "dimension", F.lit(" | "), "cells", F.lit(" |")).alias("row"))


def placeholders(template: str) -> list[str]:
    """The names between double braces, each once, in their order."""
    return list(dict.fromkeys(re.findall(r"\{\{\s*(\w+)\s*\}\}", template)))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with columns in place of its {{names}}; a name without a column is an error, a null value is empty."""
    missing = [n for n in placeholders(template) if n not in values]
    if missing:
        raise KeyError(f"no values for {missing}")
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def section_order(section: Column) -> list[Column]:
    """What to sort by so that known sections come in their order and others by name behind them."""
    at = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), section)
    return [at == 0, at, section]


def scalars(metadata: list[str], types: dict[str, str]) -> list[Column]:
    """Metadata columns as a store takes them: numbers, booleans and texts as they are, anything else as text."""
    plain = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double")
    return [c(n) if types[n] in plain else (F.to_json(n) if types[n].startswith(("array", "struct", "map")) else c(n).cast("string")).alias(n) for n in metadata]
