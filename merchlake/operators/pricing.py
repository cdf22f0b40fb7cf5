"""Offers of stores: sorting, summaries, and what a buyer is told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.operators.names import resolve

c = F.col


def offers(listings: DataFrame, stores: DataFrame, in_stock: bool = False, on_sale: bool = False) -> DataFrame:
    """Listings with store names and discounts; optionally only those in stock, or reduced."""
    df = listings.join(stores, "store_id").withColumn("discount_amount", F.when(c("original_price") > c("price"), c("original_price") - c("price")))
    df = df.where("in_stock") if in_stock else df
    return df.where(c("discount_amount") > 0) if on_sale else df


def by_rank(df: DataFrame) -> DataFrame:
    """Offers of each product numbered: in stock first, then cheapest, then by store; ties by order and line."""
    order = Window.partitionBy("phone_id").orderBy(F.desc("in_stock"), c("price").asc_nulls_last(), "store_name", "order_id", "line")
    return df.withColumn("offer_rank", F.row_number().over(order))


def summary(df: DataFrame) -> DataFrame:
    """A row a product: lowest and highest price, spread and its share, mean, and offers in and out of stock."""
    s = df.groupBy("phone_id").agg(F.min("price").alias("lowest"), F.max("price").alias("highest"), F.avg("price").alias("mean"), F.count("*").alias("offers"), F.count_if("in_stock").alias("in_stock"), F.count_if(~c("in_stock")).alias("out_of_stock"))
    return s.withColumns({"spread": c("highest") - c("lowest"), "spread_pct": F.when(c("highest") > 0, F.bround((c("highest") - c("lowest")) / c("highest") * 100, 2)), "mean": F.bround("mean", 2)})


def extremes(df: DataFrame) -> DataFrame:
    """The stores with the lowest and the highest price of each product; the first by rank on ties."""
    priced = by_rank(df).where(c("price").isNotNull())
    return priced.groupBy("phone_id").agg(F.min_by("store_name", F.struct("price", "offer_rank")).alias("cheapest"), F.max_by("store_name", F.struct(c("price"), -c("offer_rank"))).alias("dearest"), F.min("price").alias("lowest"), F.max("price").alias("highest"))


def advice(lowest: Column, highest: Column, store: Column, offers_count: Column) -> Column:
    """What a buyer is told about a product's offers."""
    money = lambda x: F.format_number(x, 0)
    saved = F.concat(F.lit(" and saves BDT "), money(highest - lowest), F.lit(" against the dearest"))
    return F.when(lowest.isNull(), F.lit("No store gives a price.")).otherwise(F.concat(store, F.lit(" is the cheapest of "), offers_count.cast("string"), F.lit(" offers at BDT "), money(lowest), F.when(highest > lowest, saved).otherwise(F.lit("")), F.lit(".")))


def check(names: DataFrame, phones: DataFrame, listings: DataFrame, stores: DataFrame) -> DataFrame:
    """(query_id, id, lowest, highest, offers, advice) for names (name_id, name): the product of each name, its prices, and what to do.

    Names that no product matches have an advice that says so.
    """
    found = resolve(names, phones).select("name_id", "id")
    chosen = found.select(c("id").alias("phone_id")).distinct()
    own = by_rank(offers(listings.join(chosen, "phone_id", "left_semi"), stores))
    s = own.groupBy(c("phone_id").alias("id")).agg(F.min("price").alias("lowest"), F.max("price").alias("highest"), F.count("*").alias("offers"), F.min_by("store_name", F.when(c("price").isNotNull(), F.struct("price", "offer_rank"))).alias("cheapest"))
    df = names.join(found, "name_id", "left").join(phones.select("id", "brand", c("name").alias("p_name")), "id", "left").join(s, "id", "left")
    label, money = F.concat_ws(" ", "brand", "p_name"), lambda x: F.concat(F.lit("৳"), F.format_number(x, 0))
    spread = F.format_string("%.1f", F.bround(F.bround((c("highest") - c("lowest")) / c("highest") * 100, 2), 1))
    advice = (
        F.when(c("id").isNull(), F.concat(F.lit("No phone matched: "), "name"))
        .when(c("offers").isNull(), F.concat(F.lit("No store listings found for "), label, F.lit(".")))
        .when(c("lowest").isNull(), F.concat(F.lit("Listings exist for "), label, F.lit(" but no price has been published yet.")))
        .when(c("highest") > c("lowest"), F.concat(F.lit("Cheapest: "), "cheapest", F.lit(" at "), money(c("lowest")), F.lit(". Buying from there saves ~"), spread, F.lit("% versus the highest priced store.")))
        .otherwise(F.concat(F.lit("Only one store has a price for "), label, F.lit(": "), "cheapest", F.lit(" at "), money(c("lowest")), F.lit(".")))
    )
    return df.select(c("name_id").alias("query_id"), "id", "lowest", "highest", F.coalesce("offers", F.lit(0)).alias("offers"), advice.alias("advice"))
