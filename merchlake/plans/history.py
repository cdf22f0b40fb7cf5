"""Queries on what changes with time: batches and their commits, changes as a stream, offers as of a moment; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.operators import commits
from merchlake.operators.asof import as_of
from merchlake.sources.catalog import LISTINGS_SQL, PHONES_SQL, listings, phones, table
from merchlake.sources.scratch import fresh_root, kept
from merchlake.streaming.changes import changes

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


_P = f"WITH phones AS ({PHONES_SQL})"


@query(f"{_P} SELECT id, name, CASE WHEN id % 7 = 0 THEN price_min + 100 ELSE price_min END AS price_min FROM phones WHERE id % 11 <> 0 AND (id % 5 <> 0 OR id % 7 = 0) UNION ALL SELECT -id, 'new ' || name, price_min FROM phones WHERE id % 13 = 0")
def batches_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after four batches, one of which comes twice: it is as if it had been built at once."""
    rows = phones(spark, sf_dir).select("id", "name", "price_min")
    t = commits.Tables(spark, fresh_root(spark, "tables"), buckets=16)
    dearer = rows.where("id % 7 = 0").withColumn("price_min", c("price_min") + 100)
    new = rows.where("id % 13 = 0").select((-c("id")).alias("id"), F.concat(F.lit("new "), c("name")).alias("name"), "price_min")
    gone = lambda condition: {"products": rows.where(condition).select("id")}
    t.commit("scrape", 0, {"products": (rows, "id")})
    for _ in range(2):
        t.commit("scrape", 1, {"products": (dearer, "id")})
    t.commit("scrape", 2, {"products": (new.where("id != 0"), "id")}, gone("id % 11 = 0"))
    t.commit("scrape", 3, {"products": (rows.limit(0), "id")}, gone("id % 5 = 0 and id % 7 != 0"))
    return t.read("products")


ORACLE_SQL["batches_in_buckets"] = ORACLE_SQL["batches_in_buckets"].replace("WHERE id % 13 = 0", "WHERE id % 13 = 0 AND id <> 0")

_SCRAPE = "concat('store ', store_id % 40)", "concat('brand ', phone_id % 25)", "concat('model ', phone_id % 400)", "concat('v', phone_id)"
_DB = f"""WITH l AS ({LISTINGS_SQL}), s AS (SELECT {_SCRAPE[0]} AS store, {_SCRAPE[1]} AS brand, {_SCRAPE[2]} AS model, {_SCRAPE[3]} AS variant_key, price, order_id % 3 AS batch FROM l),
first_store AS (SELECT store, min(batch) AS b FROM s GROUP BY store), store AS (SELECT store, row_number() OVER (ORDER BY b, store) AS store_id FROM first_store),
first_model AS (SELECT brand, model, min(batch) AS b FROM s GROUP BY ALL), model AS (SELECT brand, model, row_number() OVER (ORDER BY b, brand, model) AS model_id FROM first_model)"""


@query(f"{_DB} SELECT store_id, model_id, count(*) AS listings, count(price) AS priced, sum(price) AS total FROM s JOIN store USING (store) JOIN model USING (brand, model) GROUP BY ALL")
def listings_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings in three batches, each of which comes twice, in normalised tables: stores and models by number, and what they have."""
    rows = listings(spark, sf_dir).selectExpr(f"{_SCRAPE[0]} AS store", f"{_SCRAPE[1]} AS brand", f"{_SCRAPE[2]} AS model", f"{_SCRAPE[3]} AS variant_key", "price", "in_stock", "concat('u', order_id) AS product_url", "scraped_at", "order_id % 3 AS batch")
    t = commits.Tables(spark, fresh_root(spark, "tables"), buckets=8)
    for n in (0, 1, 2):
        for _ in range(2):
            commits.import_listings(t, "scrape", n, rows.where(c("batch") == n).drop("batch"))
    facts = t.read("listings").join(t.read("variants"), "variant_key")
    return facts.groupBy("store_id", "model_id").agg(F.count("*").alias("listings"), F.count("price").alias("priced"), F.sum("price").alias("total"))


GONE_DAYS = 200
_SEEN = f"s AS (SELECT phone_id, scraped_at, min(price) AS price, bool_or(in_stock) AS in_stock FROM ({LISTINGS_SQL}) GROUP BY ALL)"


@query(f"""WITH {_SEEN}, o AS (SELECT *, lag(scraped_at) OVER k AS before, lag(price) OVER k AS p, lag(in_stock) OVER k AS i, lead(scraped_at) OVER k AS next FROM s WINDOW k AS (PARTITION BY phone_id ORDER BY scraped_at)),
e AS (SELECT phone_id, scraped_at AS stamp, CASE WHEN before IS NULL OR scraped_at - before > INTERVAL {GONE_DAYS} DAY THEN 'added' WHEN price IS NOT DISTINCT FROM p AND in_stock = i THEN 'unchanged' ELSE 'updated' END AS status FROM o
UNION ALL SELECT phone_id, scraped_at + INTERVAL {GONE_DAYS} DAY, 'removed' FROM o WHERE coalesce(next, (SELECT max(scraped_at) FROM s)) - scraped_at > INTERVAL {GONE_DAYS} DAY)
SELECT phone_id, strftime(stamp, '%Y-%m-%d') AS day, status FROM e""")
def listing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of products as a stream of files, in order of time: what was added, changed, seen unchanged, and not seen again."""
    seen = listings(spark, sf_dir).groupBy("phone_id", "scraped_at").agg(F.min("price").alias("price"), F.bool_or("in_stock").alias("in_stock"))
    seen = kept(seen.withColumn("scraped_at", c("scraped_at").cast("timestamp")))
    source, root = fresh_root(spark, "sightings"), fresh_root(spark, "changes")
    seen.limit(0).write.parquet(source)
    stream = spark.readStream.schema(seen.schema).parquet(source)
    found = changes(stream, "phone_id", "scraped_at", ["price", "in_stock"], GONE_DAYS * 86_400)
    for first, last in ((0, 1997), (1998, 1999), (2000, 9999)):  # what has come since the last run is a batch, in as many files as it has
        seen.where(F.year("scraped_at").between(first, last)).write.mode("append").parquet(source)
        found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/out").select("phone_id", F.date_format("at", "yyyy-MM-dd").alias("day"), "status")


@query(f"""WITH h AS (SELECT phone_id, scraped_at, min(price) AS price, count(*) AS offers FROM ({LISTINGS_SQL}) GROUP BY ALL), r AS (SELECT o_orderkey AS request, o_orderkey % (SELECT max(p_partkey) + 2 FROM part) AS phone_id, o_orderdate AS stamp FROM orders)
SELECT request, r.phone_id, strftime(stamp, '%Y-%m-%d') AS day, strftime(scraped_at, '%Y-%m-%d') AS since, price, offers FROM r ASOF LEFT JOIN h ON r.phone_id = h.phone_id AND r.stamp >= h.scraped_at""")
def offers_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offer that was valid when a request was made."""
    history = listings(spark, sf_dir).groupBy("phone_id", "scraped_at").agg(F.min("price").alias("price"), F.count("*").alias("offers"))
    most = table(spark, sf_dir, "part").agg((F.max("p_partkey") + 2).alias("m"))
    asked = table(spark, sf_dir, "orders").join(F.broadcast(most)).select(c("o_orderkey").alias("request"), (c("o_orderkey") % c("m")).alias("phone_id"), c("o_orderdate").alias("at"))
    day = lambda t: F.date_format(t, "yyyy-MM-dd")
    return as_of(asked, history, ["phone_id"], "at", "scraped_at", ["price", "offers"]).select("request", "phone_id", day("at").alias("day"), day("scraped_at").alias("since"), "price", "offers")
