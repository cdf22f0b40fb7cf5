"""The cheapest matches of many requests at once: products in price bands, requests walk them from the cheapest band on.

A request asks for a span of prices and, or not, for a brand, foldables and 5G. Products are dealt to the classes that such
wishes make, up to eight each, and to bands of the logarithm of their price. Of each class and band, and of each class and
price, only as many as a request can use are kept; these heaps are all that requests meet, by equi-joins on class and
band. The band that a request's lowest price cuts is read by price, those above it as wholes, some at a time, until
the request is full or its highest price is passed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.sources.scratch import kept

c = F.col
#: Products in a band, about, and how many bands a request reads in its rounds; from the last number on, as many in each.
BAND, ROUNDS = 4096, (8, 64, 512)


def _classes(brand: Column, foldable: Column, five_g: Column) -> Column:
    """The classes of a product, as structs: its brand or any, foldables or all, 5G or all."""
    either = lambda wish: F.when(wish, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    brands = F.when(brand.isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array(brand, F.lit(None).cast("string")))
    of = lambda b: F.transform(either(foldable), lambda f: F.transform(either(five_g), lambda g: _class(b, f, g)))
    return F.flatten(F.flatten(F.transform(brands, of)))


def _class(brand: Column, foldable: Column, five_g: Column) -> Column:
    return F.concat_ws("|", F.coalesce(F.concat(F.lit("="), brand), F.lit("")), foldable.cast("string"), five_g.cast("string"))


def cheapest(requests: DataFrame, products: DataFrame, most: int) -> DataFrame:
    """(query_id, id, price_min): of each request's matches the `most` cheapest, ties by id.

    `requests` has query_id, budget_min, budget_max, brand, foldable, five_g; nulls ask for nothing. `products` has id,
    price_min, brand, foldable, five_g; those without a price above 0 match nothing. Brands are equal whatever the case.
    Requests that ask for the same are answered once.
    """
    p = products.where(c("price_min") > 0).select("id", c("price_min").cast("double").alias("price"), F.explode(_classes(F.lower("brand"), F.coalesce("foldable", F.lit(False)), F.coalesce("five_g", F.lit(False)))).alias("class"))
    every = p.where(c("class") == _class(F.lit(None).cast("string"), F.lit(False), F.lit(False))).agg(F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi")).first()
    empty = requests.select("query_id").limit(0).withColumns({"id": F.lit(None).cast(products.schema["id"].dataType), "price_min": F.lit(None).cast("double")})
    if not every["n"]:
        return empty
    scale = max(1.0, every["n"] / BAND / max(math.log2(every["hi"] / every["lo"]), 1e-3))
    band = lambda price: F.floor(F.log2(price) * scale)
    by_id, by_price = Window.partitionBy("class", "price").orderBy("id"), Window.partitionBy("class", "band").orderBy("price", "id")
    near = kept(p.withColumn("r", F.row_number().over(by_id)).where(c("r") <= most).drop("r").withColumn("band", band(c("price"))))
    far = kept(near.withColumn("r", F.row_number().over(by_price)).where(c("r") <= most).drop("r"))
    first, last = far.agg(F.min("band"), F.max("band")).first()

    # what is asked for names the walk; no wish is below 0
    wishes = requests.select("query_id", F.when(c("budget_min") > 0, c("budget_min").cast("double")).alias("least"), c("budget_max").cast("double").alias("highest"), _class(F.lower("brand"), F.coalesce("foldable", F.lit(False)), F.coalesce("five_g", F.lit(False))).alias("class"))
    wishes = wishes.where("highest is null or highest > 0").withColumn("walk", F.struct("class", F.coalesce("least", F.lit(-1.0)).alias("least"), F.coalesce("highest", F.lit(-1.0)).alias("highest")))
    wishes = kept(wishes)
    until = F.when(c("highest") < every["hi"], band(c("highest"))).otherwise(F.lit(last))
    since = F.when(c("least") > every["lo"], band(c("least"))).otherwise(F.lit(first - 1))
    left = wishes.select("walk", "class", "least", "highest").distinct().withColumns({"until": until, "next": since + 1})
    fits = (c("least").isNull() | (c("price") >= c("least"))) & (c("highest").isNull() | (c("price") <= c("highest")))
    order = Window.partitionBy("walk").orderBy("price", "id")

    got = left.withColumn("band", c("next") - 1).join(near, ["class", "band"]).where(fits).select("walk", "id", "price")
    n = 0
    while True:
        end = F.least(c("until"), c("next") + (ROUNDS[min(n, len(ROUNDS) - 1)] - 1))
        met = left.where(c("next") <= c("until")).withColumn("band", F.explode(F.sequence("next", end))).join(far, ["class", "band"]).where(fits)
        got = kept(met.select("walk", "id", "price").unionByName(got).withColumn("r", F.row_number().over(order)).where(c("r") <= most).drop("r"))
        have = got.groupBy("walk").agg(F.count("*").alias("have"))
        left = left.withColumn("next", end + 1).join(have, "walk", "left").where((F.coalesce("have", F.lit(0)) < most) & (c("next") <= c("until"))).drop("have")
        n += 1
        if left.isEmpty():
            break
        left = kept(left)
    return wishes.select("query_id", "walk").join(got, "walk").select("query_id", "id", c("price").alias("price_min"))
