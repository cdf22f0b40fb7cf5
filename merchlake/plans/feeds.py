"""Queries on pages, events, scraped values and history, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.sources import feeds, scrapes
from merchlake.sources.catalog import LISTINGS_SQL, listings, table
from merchlake.sources.scratch import fresh_root, shared_root
from merchlake.sources.texts import filled, rows, rows_sql
from merchlake.streaming.listings import arrivals, each_once, run_available

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@query("SELECT page_id, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", T.first_match(c("html"), r"(?is)<title>(.*?)</title>").alias("title"))


@query("SELECT DISTINCT page_id, l[1] AS href, l[2] AS label FROM (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '(?is)<a\\s+href=\"([^\"]*)\"[^>]*>(.*?)</a>', 1), regexp_extract_all(html, '(?is)<a\\s+href=\"([^\"]*)\"[^>]*>(.*?)</a>', 2))) AS l FROM pages)")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = lambda g: F.regexp_extract_all("html", F.lit(r'(?is)<a\s+href="([^"]*)"[^>]*>(.*?)</a>'), F.lit(g))
    links = F.arrays_zip(every(1).alias("href"), every(2).alias("label"))
    return _pages(spark, sf_dir).select("page_id", F.explode(links).alias("l")).select("page_id", "l.href", "l.label").distinct()


_STRIP = "html"
for _p in (r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", r"(?i)</?(p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|nav|article|section)\b[^>]*>"):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', ' ', 'g')"
_STRIP = f"regexp_replace({_STRIP}, '(?s)<[^>]*>', '', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_a}', '{_b}')"


@query(rf"SELECT page_id, trim(regexp_replace({_STRIP}, '\s+', ' ', 'g')) AS text FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", T.strip_html(c("html")).alias("text"))


@query("SELECT event_type, (props->>'$.k')::INT % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_flatten_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = feeds.flat_specs(F.try_variant_get(F.try_parse_json("props"), "$", "map<string,variant>"))
    return table(spark, sf_dir, "events").select("event_type", (specs["k"].cast("int") % 10).alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


_TEXT = {"id": "p_partkey", "text": filled(["1{k},{mah} - 15,500", "BDT 9,9{k}", "1,200 through 1,1{k}", "call {brand}", "{size} / {gb} / 9", "{n}-{m} taka", ""])}


@query(rf"WITH t AS ({rows_sql(_TEXT)}), n AS (SELECT id, list_transform(regexp_extract_all(text, '[0-9,]*[0-9]'), lambda x: replace(x, ',', '')::BIGINT) AS n FROM t) SELECT id, n[1] AS price, CASE WHEN n[2] > n[1] THEN n[2] END AS original_price FROM n")
def price_range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _TEXT).select("id", feeds.price_range(c("text")).alias("p")).select("id", "p.*")


_L = f"WITH listings AS ({LISTINGS_SQL})"


@query(_L + ", r AS (SELECT order_id, min(price) FILTER (WHERE price > 0) AS price, max(original_price) FILTER (WHERE original_price > 0) AS most, bool_or(in_stock) AS in_stock FROM listings GROUP BY order_id) SELECT order_id, price, CASE WHEN most > price THEN most END AS original_price, in_stock FROM r")
def variant_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = listings(spark, sf_dir).groupBy("order_id").agg(F.collect_list(F.struct("price", c("original_price").alias("compare_at"), c("in_stock").alias("available"))).alias("v"))
    return variants.select("order_id", feeds.variant_rollup(c("v")).alias("r")).select("order_id", "r.*")


@query("SELECT p_partkey AS id, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'brand' WHEN regexp_matches(p_name, '(?i)\\b(ring|case)\\b') THEN 'name' WHEN p_type = 'PROMO' THEN 'category' END AS reason FROM part")
def phone_only_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a product is not taken for a phone: its brand, a word of its name, its category; null if it is one."""
    reason = T.ladder([(c("p_brand").isin("Brand#1", "Brand#2"), "brand"), (c("p_name").rlike(r"(?i)\b(ring|case)\b"), "name"), (c("p_type") == "PROMO", "category")], F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), reason.alias("reason"))


@query("SELECT l_orderkey AS id, l_shipmode AS key, arg_min(value, (pos, value)) AS value FROM (SELECT l_orderkey, l_linestatus || l_returnflag AS l_shipmode, l_linenumber AS pos, (l_quantity::INT)::VARCHAR AS value FROM lineitem) GROUP BY 1, 2")
def spec_rows_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), F.concat("l_linestatus", "l_returnflag").alias("key"), c("l_linenumber").alias("pos"), c("l_quantity").cast("int").cast("string").alias("value"))
    return rows.groupBy("id", "key").agg(F.min_by("value", F.struct("pos", "value")).alias("value"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(last)).where("n <= 3").select("conv_id", "turn", "role")


@query(_L + " SELECT phone_id, store_id, order_id, line, price FROM listings QUALIFY row_number() OVER (PARTITION BY phone_id, store_id ORDER BY scraped_at DESC, order_id DESC, line DESC) = 1")
def latest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the newest listing of each product and store."""
    newest = Window.partitionBy("phone_id", "store_id").orderBy(F.desc("scraped_at"), F.desc("order_id"), F.desc("line"))
    return listings(spark, sf_dir).withColumn("n", F.row_number().over(newest)).where("n = 1").select("phone_id", "store_id", "order_id", "line", "price")


@query(_L + " SELECT phone_id, store_id, order_id, line, price - lag(price) OVER (PARTITION BY phone_id, store_id ORDER BY scraped_at, order_id, line) AS change FROM listings")
def price_change_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: how a price changed since the listing before."""
    order = Window.partitionBy("phone_id", "store_id").orderBy("scraped_at", "order_id", "line")
    return listings(spark, sf_dir).select("phone_id", "store_id", "order_id", "line", (c("price") - F.lag("price").over(order)).alias("change"))


@query(_L + " SELECT scraped_at::DATE AS day, count(*) AS n, min(price) AS lowest, round(avg(price), 6) AS mean FROM listings GROUP BY 1")
def daily_price_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: prices in daily windows."""
    return listings(spark, sf_dir).groupBy(F.window(c("scraped_at").cast("timestamp"), "1 day")).agg(F.count("*").alias("n"), F.min("price").alias("lowest"), F.round(F.avg("price"), 6).alias("mean")).select(F.to_date("window.start").alias("day"), "n", "lowest", "mean")


@query("WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, session")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: events of a user with gaps under half an hour."""
    e = table(spark, sf_dir, "events").withColumn("ts", c("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select("user_id", "n", "total")


@query("SELECT event_id, event_type FROM events")
def stream_ingest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, twice over, as a stream of files: each comes out once."""
    base = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    events.unionAll(events).write.mode("overwrite").parquet(f"{base}/in")
    run_available(each_once(arrivals(spark, f"{base}/in", events.schema, "ts"), "event_id", "ts"), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type")


_NESTED = {"id": "p_partkey", "j": filled(['{"Display": {"Size": "{inch}", "Panel": {"Type": "OLED", "Hz": 1{k}}}, "RAM": "{gb} GB", "NFC": true}', '{"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"i": {"j": "{name}"}, "k": {size}}}}}}}}}}', "{}", '{"{brand}": {"{type}": {"x": null}}}'])}


@query(f"SELECT id, coalesce(string_agg(replace(replace(fullkey[3:], '\"', ''), '.', '_') || '=' || (atom->>'$'), '; ' ORDER BY replace(replace(fullkey[3:], '\"', ''), '.', '_')) FILTER (WHERE atom->>'$' IS NOT NULL), '') AS specs FROM ({rows_sql(_NESTED)}) LEFT JOIN LATERAL (SELECT fullkey, atom FROM json_tree(j) WHERE type <> 'OBJECT') ON true GROUP BY id")
def json_flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications of any depth as one level."""
    flat = feeds.flattened_rows(rows(spark, sf_dir, _NESTED), "id", "j")
    pair = F.struct("name", F.concat("name", F.lit("="), "value").alias("pair"))
    found = flat.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["pair"]), "; ").alias("specs"))
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id")).join(found, "id", "left").select("id", F.coalesce("specs", F.lit("")).alias("specs"))


@query("SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, CASE WHEN p_size % 2 = 0 THEN p_type END AS kind FROM part")
def scrapes_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products written as a scrape's files and read back by the data source of scrapes."""
    scrapes.register(spark)
    folder = fresh_root(spark, "scrapes")
    out = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_retailprice").alias("price"), F.when(c("p_size") % 2 == 0, c("p_type")).alias("kind"))
    out.repartition(3, "id").write.format("scrapes").mode("append").save(folder)
    rows = spark.read.format("scrapes").load(folder).where("error is null")
    return rows.select(F.from_json("product", "id long, name string, price double, kind string").alias("p")).select("p.*")
