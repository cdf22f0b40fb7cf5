"""Queries on the catalog, offers and entities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.functions.numbers import price_score, round_half_up
from merchlake.functions.vocabulary import SPEC_NAMES
from merchlake.operators import catalog as C
from merchlake.operators import directory as D
from merchlake.operators import entities as E
from merchlake.operators import names as N
from merchlake.operators import pricing as P
from merchlake.sources.catalog import LISTINGS_SQL, PHONES_SQL, listings, phones, stores, table
from merchlake.sources.scratch import fresh_root
from merchlake.sources.texts import filled, rows, rows_sql

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


_P = f"WITH phones AS ({PHONES_SQL})"
_L = f"WITH phones AS ({PHONES_SQL}), listings AS ({LISTINGS_SQL}), offers AS (SELECT l.*, s_name AS store_name, CASE WHEN original_price > price THEN original_price - price END AS discount_amount FROM listings l JOIN supplier ON store_id = s_suppkey)"
_SLUG = lambda x: f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(_P + """, t AS (SELECT * FROM phones WHERE price_min > 0 AND brand ILIKE 'samsung' AND price_min <= 90000 ORDER BY price_min, id LIMIT 100),
s AS (SELECT id, name, price_min, round(1 - greatest(0::DOUBLE, least(1::DOUBLE, (log10(greatest(price_min, 1000::DOUBLE)) - 3.5::DOUBLE) / 2::DOUBLE)), 9) AS score FROM t)
SELECT id, name, price_min, score, row_number() OVER (ORDER BY score DESC, price_min, id) AS rank FROM s QUALIFY rank <= 5""")  # fmt: skip
def flagship_best_value_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-value products of a brand under a budget: the 100 cheapest are scored, the best 5 are ranked."""
    cheapest = C.search(phones(spark, sf_dir), brand="samsung", budget_max=90000.0).orderBy("price_min", "id").limit(100)
    scored = cheapest.select("id", "name", "price_min", F.round(price_score(c("price_min")), 9).alias("score"))
    best = scored.orderBy(F.desc("score"), "price_min", "id").limit(5)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "price_min", "id")))


@query(_P + " SELECT id, name, price_min FROM phones WHERE price_min > 0 AND brand ILIKE 'SAMSUNG' AND price_min BETWEEN 10000 AND 140000 AND (ram_gb >= 6 OR ram_gb IS NULL) AND (category ILIKE '%fold%' OR category ILIKE '%flip%' OR name ILIKE '%fold%' OR name ILIKE '%flip%')")
def catalog_filter_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search(phones(spark, sf_dir), brand=" SAMSUNG ", budget_min=10000.0, budget_max=140000.0, ram=6, is_foldable=True).select("id", "name", "price_min")


@query(_P + " SELECT id, ram_gb, storage_gb, battery_mah, charging_w FROM phones WHERE price_min > 0 AND (ram_gb >= 8 OR ram_gb IS NULL) AND (storage_gb >= 256 OR storage_gb IS NULL) AND (battery_mah >= 5000 OR battery_mah IS NULL) AND (charging_w >= 60 OR charging_w IS NULL) AND display_inches >= 6.0 AND display_inches <= 6.8")
def catalog_null_tolerant_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search(phones(spark, sf_dir), ram=8, storage=256, battery=5000, charging=60, inches_min=6.0, inches_max=6.8).select("id", "ram_gb", "storage_gb", "battery_mah", "charging_w")


@query(_P + " SELECT id, processor_text, network FROM phones WHERE price_min > 0 AND processor_text ILIKE '%Gen 3%' AND (network ILIKE '%5g%' OR name ILIKE '%5g%')")
def catalog_filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search(phones(spark, sf_dir), processor="Gen 3", is_5g=True).select("id", "processor_text", "network")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phones(spark, sf_dir).withColumns({"slug": T.slugify(c("name"), "_"), "release_year": F.when(c("id") % 5 != 0, 2018 + c("id") % 8), "popularity": F.when(c("id") % 7 != 0, c("id") * 31 % 1000)})


_CAT = f"WITH phones AS ({PHONES_SQL}), cat AS (SELECT *, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, CASE WHEN id % 5 <> 0 THEN 2018 + id % 8 END AS release_year, CASE WHEN id % 7 <> 0 THEN id * 31 % 1000 END AS popularity FROM phones)"


@query(_CAT + ", hit AS (SELECT * FROM cat WHERE contains(lower(brand || ' ' || name), 'pro') AND (lower(brand) = 'apple' OR starts_with(slug, 'apple_')) AND coalesce(release_year, 0) >= 2019) SELECT id, name, release_year, popularity, (SELECT count(*) FROM hit) AS total, greatest(1, ceil((SELECT count(*) FROM hit) / 10.0))::BIGINT AS total_pages FROM hit ORDER BY coalesce(popularity, 0) DESC, id LIMIT 10 OFFSET 10")
def catalog_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = C.list_page(_catalog(spark, sf_dir), "Pro", "Apple", min_year=2019, page=2, size=10)
    return page.select("id", "name", "release_year", "popularity", "total", "total_pages")


_ORDER = "coalesce(popularity, 0) DESC, id"


@query(f"{_CAT}, n AS (SELECT count(*) AS total, greatest(1, ceil(count(*) / 10.0))::BIGINT AS total_pages FROM cat WHERE brand = 'Apple'), p AS (SELECT row_number() OVER (ORDER BY {_ORDER}) - 1 AS r, id, name, popularity FROM cat WHERE brand = 'Apple') SELECT r // 10 + 1 AS page, id, name, popularity, total, total_pages FROM p, n WHERE r // 10 + 1 IN (1, 3, total_pages)")
def catalog_deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, the third and the last page of a brand, from a list that was written in its order."""
    root, order = fresh_root(spark, "list"), [F.coalesce("popularity", F.lit(0)).desc(), c("id")]
    D.write(_catalog(spark, sf_dir).select("id", "name", "brand", "popularity"), root, order, ["brand"], size=256)
    page = lambda n: D.page(spark, root, order, n, 10, brand="Apple").withColumn("page", F.lit(n).cast("long"))
    last = page(1).first()["total_pages"]
    out = page(1)
    for n in sorted({3, last} - {1}):
        out = out.unionByName(page(n))
    return out.select("page", "id", "name", "popularity", "total", "total_pages")


@query(_CAT + " SELECT id, name FROM cat WHERE release_year = 2021 ORDER BY coalesce(release_year, 0), id LIMIT 100")
def catalog_list_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.list_page(_catalog(spark, sf_dir), year=2021, sort="oldest", page=0, size=500).select("id", "name")


@query(_CAT + " SELECT id, name FROM cat WHERE contains(lower(brand || ' ' || name), 'pixel') ORDER BY id LIMIT 8")
def catalog_typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.typeahead(_catalog(spark, sf_dir), " Pixel ").select("id", "name")


@query(_P + f" SELECT brand, count(*) AS phones, {_SLUG('brand')} AS slug FROM phones GROUP BY brand")
def catalog_brand_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.brand_counts(phones(spark, sf_dir))


@query(_P + " SELECT letter, count(*) AS brands, string_agg(brand, ', ' ORDER BY brand) AS names FROM (SELECT DISTINCT CASE WHEN regexp_matches(brand, '^[A-Za-z]') THEN upper(brand[1]) ELSE '#' END AS letter, brand FROM phones) GROUP BY letter")
def catalog_brand_letter_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.brands_by_letter(phones(spark, sf_dir))


@query(_P + " SELECT count(*) AS phones, count(DISTINCT brand) AS brands FROM phones")
def catalog_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phones(spark, sf_dir).agg(F.count("*").alias("phones"), F.count_distinct("brand").alias("brands"))


@query(_L + ", o AS (SELECT phone_id, min(price) FILTER (WHERE price > 0) AS lowest, bool_or(in_stock) AS available, count(*) AS listings, count(DISTINCT store_id) AS stores FROM offers GROUP BY phone_id) SELECT id, name, coalesce(format('{:,}', lowest::BIGINT), 'TBD') AS price_hint, coalesce(available, false) AS available, coalesce(listings, 0) AS listings, coalesce(stores, 0) AS stores FROM phones LEFT JOIN o ON id = phone_id")
def catalog_detail_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.details(phones(spark, sf_dir), listings(spark, sf_dir), stores(spark, sf_dir))


@query(_L + ", m AS (SELECT id, name FROM phones WHERE name ILIKE '%ultra%' ORDER BY id LIMIT 20) SELECT id, name, store_name, price FROM m LEFT JOIN offers ON id = phone_id")
def catalog_search_limit_before_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phones(spark, sf_dir).where(c("name").ilike("%ultra%")).orderBy("id").limit(20).select("id", "name")
    return found.join(P.offers(listings(spark, sf_dir), stores(spark, sf_dir)), c("id") == c("phone_id"), "left").select("id", "name", "store_name", "price")


_SLUGS = ["part-77", "part-5", "no-such", "part-301"]


@query(_P + f", a AS (SELECT unnest({_SLUGS}) AS slug, unnest([0, 1, 2, 3]) AS pos) SELECT pos, id, name FROM a JOIN phones ON slug = concat('part-', id)")
def catalog_compare_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.in_given_order(phones(spark, sf_dir).withColumn("slug", F.concat(F.lit("part-"), c("id"))), _SLUGS).select("pos", "id", "name")


@query(_P + ", n AS (SELECT *, list_filter(string_split(coalesce(network, ''), ' / '), lambda x: x <> '') AS networks FROM phones) SELECT id, network FROM n WHERE list_has_all(networks, ['LTE', '5G']) AND ram_gb BETWEEN 4 AND 8 AND brand = 'Samsung'")
def finder_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = phones(spark, sf_dir).withColumn("networks", F.filter(F.split(F.coalesce("network", F.lit("")), " / "), lambda x: x != ""))
    return C.finder(df, ["LTE", "5G"], {"ram_gb": (4, 8), "brand": "Samsung", "category": "Any"}).select("id", "network")


@query(_P + " SELECT p.id, p.name FROM phones p, (SELECT brand AS b, category AS g FROM phones WHERE id = 42) WHERE p.id <> 42 ORDER BY (brand = b) DESC, (category = g) DESC, id LIMIT 6")
def related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.related(phones(spark, sf_dir), 42).select("id", "name")


@query("SELECT id, page, array_to_string(list_filter(range(1, pages + 1), lambda i: i = 1 OR i = pages OR abs(i - page) <= 2), ' ') AS shown FROM (SELECT p_partkey AS id, p_size::BIGINT AS pages, p_partkey % p_size + 1 AS page FROM part)")
def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_size").cast("long").alias("pages"), (c("p_partkey") % c("p_size") + 1).alias("page"))
    return p.select("id", "page", F.array_join(F.transform(C.page_numbers(c("pages"), c("page")), lambda i: i.cast("string")), " ").alias("shown"))


# offers


def _offers(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return P.offers(listings(spark, sf_dir), stores(spark, sf_dir), **kw)


_RANK = "row_number() OVER (PARTITION BY phone_id ORDER BY in_stock DESC, price NULLS LAST, store_name, order_id, line)"


@query(_L + f" SELECT phone_id, store_name, price, in_stock, {_RANK} AS offer_rank FROM offers")
def offers_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.by_rank(_offers(spark, sf_dir)).select("phone_id", "store_name", "price", "in_stock", "offer_rank")


@query(_L + " SELECT phone_id, count(*) AS offers, min(price) AS lowest FROM offers WHERE in_stock GROUP BY phone_id")
def offers_in_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir, in_stock=True).groupBy("phone_id").agg(F.count("*").alias("offers"), F.min("price").alias("lowest"))


@query(_L + " SELECT phone_id, order_id, line, discount_amount FROM offers WHERE discount_amount > 0")
def offers_on_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offers(spark, sf_dir, on_sale=True).select("phone_id", "order_id", "line", "discount_amount")


@query(_L + " SELECT phone_id, min(price) AS lowest, max(price) AS highest, max(price) - min(price) AS spread, CASE WHEN max(price) > 0 THEN round_even((max(price) - min(price)) / max(price) * 100, 2) END AS spread_pct, round_even(avg(price), 2) AS mean, count(*) AS offers, count(*) FILTER (WHERE in_stock) AS in_stock, count(*) FILTER (WHERE NOT in_stock) AS out_of_stock FROM offers GROUP BY phone_id")
def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.summary(_offers(spark, sf_dir))


_EXTREMES = f"r AS (SELECT *, {_RANK} AS offer_rank FROM offers), x AS (SELECT phone_id, arg_min(store_name, (price, offer_rank)) AS cheapest, arg_max(store_name, (price, -offer_rank)) AS dearest, min(price) AS lowest, max(price) AS highest FROM r WHERE price IS NOT NULL GROUP BY phone_id)"


@query(_L + f", {_EXTREMES} SELECT * FROM x")
def price_cheapest_highest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extremes(_offers(spark, sf_dir))


@query(_L + f", {_EXTREMES}, n AS (SELECT phone_id, count(*) AS n FROM offers GROUP BY phone_id) SELECT n.phone_id, CASE WHEN lowest IS NULL THEN 'No store gives a price.' ELSE concat(cheapest, ' is the cheapest of ', n, ' offers at BDT ', format('{{:,}}', lowest::BIGINT), CASE WHEN highest > lowest THEN concat(' and saves BDT ', format('{{:,}}', (highest - lowest)::BIGINT), ' against the dearest') ELSE '' END, '.') END AS advice FROM n LEFT JOIN x USING (phone_id)")
def price_recommendation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _offers(spark, sf_dir)
    both = df.groupBy("phone_id").agg(F.count("*").alias("n")).join(P.extremes(df), "phone_id", "left")
    return both.select("phone_id", P.advice(c("lowest"), c("highest"), c("cheapest"), c("n")).alias("advice"))


# entities

_NAMES = [(1, "Samsung small ring iPhone 16 Pro"), (2, "ring pixel 9"), (3, "xiaomi widget note"), (4, "nothing like it"), (5, "Apple Z Flip 6 ring"), (6, "!!!"), (7, "google"), (8, "vivo zzz ring"), (9, " ")]


def resolved_sql(names: str, order: str) -> str:
    """CTEs that end in `met`: name_id, name, id, stage; from a CTE `names` (name_id, name) and `phones`."""
    tests = {"slug": "ps = ns", "brand": "lower(brand) = lower(n.name)", "name_part": "contains(lower(p_name), lower(n.name))", "slug_part": "contains(ps, ns)", "tokens": "(lower(brand) = head AND hits > 0)"}
    stage = " ".join(f"WHEN {tests[kind]} THEN {i + 1}" for i, kind in enumerate(N.STAGES[order]))
    tokens = N.STAGES[order].index("tokens") + 1
    return f"""ns AS (SELECT name_id, trim(name) AS name, {_SLUG('trim(name)')} AS ns, lower(split_part(trim(name), ' ', 1)) AS head, CASE WHEN contains(trim(name), ' ') THEN list_filter(string_split({_SLUG("regexp_replace(trim(name), '^[^ ]+ *', '')")}, '-'), lambda w: length(w) > 1) ELSE [] END AS words FROM {names}),
ps AS (SELECT id, brand, price_min, name AS p_name, {_SLUG('name')} AS ps FROM phones),
np AS (SELECT n.name_id, n.name, n.ns, n.head, ps.*, len(list_filter(words, lambda w: contains(ps, w))) AS hits FROM ns n, ps WHERE n.ns <> ''),
staged AS (SELECT *, CASE {stage} END AS stage FROM np n),
met AS (SELECT name_id, name, id, stage FROM staged WHERE stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name_id ORDER BY stage, CASE WHEN stage = {tokens} THEN hits ELSE 0 END DESC, price_min DESC NULLS LAST, id) = 1)"""  # fmt: skip


_N = f"{_P}, names AS (SELECT unnest([{', '.join(str(i) for i, _ in _NAMES)}]) AS name_id, unnest([{', '.join(repr(n) for _, n in _NAMES)}]) AS name)"


@query(f"{_N}, {resolved_sql('names', 'lookup')} SELECT * FROM met")
def resolve_name_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.resolve(spark.createDataFrame(_NAMES, "name_id int, name string"), phones(spark, sf_dir))


@query(f"{_N}, {resolved_sql('names', 'compare')} SELECT * FROM met")
def resolve_name_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.resolve(spark.createDataFrame(_NAMES, "name_id int, name string"), phones(spark, sf_dir), "compare")

@query(f"""{_P}, names AS (SELECT id AS name_id, CASE id % 4 WHEN 0 THEN name WHEN 1 THEN name[5:17] WHEN 2 THEN brand || ' ' || string_split(name, ' ')[3] || ' zzz' ELSE string_split(name, ' ')[4] END AS name FROM phones WHERE id % 10 = 0 OR id < 100), {resolved_sql('names', 'lookup')} SELECT * FROM met""")
def resolve_names_of_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made from a tenth of the products, looked up in a written index: whole ones, parts, words with the brand, single words."""
    return N.resolve(_catalog_names(phones(spark, sf_dir)), phones(spark, sf_dir), index=_name_index(spark, sf_dir))


@query(ORACLE_SQL["resolve_names_of_catalog"].replace(resolved_sql("names", "lookup"), resolved_sql("names", "compare")))
def resolve_names_of_catalog_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.resolve(_catalog_names(phones(spark, sf_dir)), phones(spark, sf_dir), "compare", _name_index(spark, sf_dir))


def _catalog_names(p: DataFrame) -> DataFrame:
    word = lambda i: F.split("name", " ")[i]
    text = F.when(c("id") % 4 == 0, c("name")).when(c("id") % 4 == 1, F.substring("name", 5, 13)).when(c("id") % 4 == 2, F.concat(c("brand"), F.lit(" "), word(2), F.lit(" zzz"))).otherwise(word(3))
    return p.where("id % 10 = 0 or id < 100").select(c("id").alias("name_id"), text.alias("name"))


def _name_index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    root = fresh_root(spark, "names")
    N.write_index(phones(spark, sf_dir), root)
    return N.load_index(spark, root)


_HELD = "SELECT id AS query_id, CASE id % 3 WHEN 0 THEN ' ' || upper(name[8:14]) WHEN 1 THEN name[9:10] ELSE string_split(name, ' ')[2] || ' ' END AS text FROM phones WHERE id % 20 = 0 OR id < 50 UNION ALL SELECT -1, '  '"


@query(_P + f", q AS ({_HELD}), t AS (SELECT id, lower(brand || ' ' || name) AS text FROM phones) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM q JOIN t ON contains(t.text, lower(trim(q.text))) QUALIFY rank <= 8")
def typeahead_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first matches of many look-ups at once."""
    p = phones(spark, sf_dir)
    text = F.when(c("id") % 3 == 0, F.concat(F.lit(" "), F.upper(F.substring("name", 8, 7)))).when(c("id") % 3 == 1, F.substring("name", 9, 2)).otherwise(F.concat(F.split("name", " ")[1], F.lit(" ")))
    asked = p.where("id % 20 = 0 or id < 50").select(c("id").alias("query_id"), text.alias("text")).unionByName(spark.range(1).select((c("id") - 1).alias("query_id"), F.lit("  ").alias("text")))
    return N.holding(p.select("id", F.concat_ws(" ", "brand", "name").alias("text")), asked)


def _clean_sql(x: str) -> str:
    x = f"CASE WHEN starts_with(lower(trim({x})), lower(trim(brand))) THEN trim(substr(lower(trim({x})), length(trim(brand)) + 1)) ELSE lower(trim({x})) END"
    for noise in E.NAME_NOISE:
        x = f"regexp_replace({x}, '{noise}', '', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


@query(_P + f" SELECT id, {_clean_sql('name')} AS cleaned, concat(lower(trim(brand)), '|', {_clean_sql('name')}) AS product_key FROM phones")
def clean_product_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phones(spark, sf_dir).select("id", E.clean_name(c("brand"), c("name")).alias("cleaned"), E.product_key(c("brand"), c("name")).alias("product_key"))


_FULL = "(CASE WHEN ram_gb IS NULL THEN 0 ELSE 1 END + CASE WHEN storage_gb IS NULL THEN 0 ELSE 1 END + CASE WHEN battery_mah IS NULL THEN 0 ELSE 1 END + CASE WHEN charging_w IS NULL THEN 0 ELSE 1 END + CASE WHEN os IS NULL THEN 0 ELSE 1 END)"


@query(_P + f", k AS (SELECT *, concat(lower(trim(brand)), '|', {_clean_sql('name')}) AS key, {_FULL} AS fullness FROM phones) SELECT key, arg_max(id, (fullness, -id)) AS id, max(fullness) AS fullness, count(*) AS members FROM k GROUP BY key")
def merge_group_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phones(spark, sf_dir).select(E.product_key(c("brand"), c("name")).alias("key"), "id", F.expr(_FULL).alias("fullness"))
    return E.base_record(rows, "key", "fullness", "id")



def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    q = c("l_quantity").cast("int")
    ord_ = c("l_orderkey") * 10 + c("l_linenumber")
    one = li.select(c("l_partkey").alias("phone_id"), ord_.alias("ord"), F.lit("Display Size").alias("raw"), F.repeat(F.lit("d"), q % 9).alias("value"))
    two = li.select(c("l_partkey").alias("phone_id"), ord_.alias("ord"), F.concat(F.lit("rear-camera "), (c("l_linenumber") % 2).cast("string")).alias("raw"), F.concat(F.lit("mp"), (q % 7).cast("string"), F.repeat(F.lit("x"), q % 5)).alias("value"))
    return one.unionAll(two).withColumn("spec", E.spec_name(c("raw")))


@query("""WITH e AS (SELECT l_partkey AS phone_id, l_orderkey * 10 + l_linenumber AS ord, 'display' AS spec, repeat('d', (l_quantity::INT % 9)::INT) AS value FROM lineitem
UNION ALL SELECT l_partkey, l_orderkey * 10 + l_linenumber, 'rear_camera', concat('mp', l_quantity::INT % 7, repeat('x', (l_quantity::INT % 5)::INT)) FROM lineitem)
SELECT phone_id, spec, arg_max(value, (length(value), -ord)) AS value FROM e WHERE trim(value) <> '' GROUP BY phone_id, spec""")  # fmt: skip
def merge_longest_value_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.longest_values(_entries(spark, sf_dir), "phone_id", "spec", "value", "ord")


@query(_L + " SELECT phone_id, least(min(price), any_value(price_min)) AS price_min, greatest(max(price), any_value(price_max)) AS price_max, bool_or(in_stock) AS any_in_stock, count(DISTINCT store_name) AS sources FROM offers JOIN phones ON id = phone_id GROUP BY phone_id")
def merge_price_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = phones(spark, sf_dir).select(c("id").alias("phone_id"), c("price_min").alias("own_min"), c("price_max").alias("own_max"))
    rolled = _offers(spark, sf_dir).groupBy("phone_id").agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.bool_or("in_stock").alias("any_in_stock"), F.count_distinct("store_name").alias("sources"))
    return rolled.join(own, "phone_id").select("phone_id", F.least("lo", "own_min").alias("price_min"), F.greatest("hi", "own_max").alias("price_max"), "any_in_stock", "sources")


@query(_L + " SELECT phone_id, store_id, order_id, line FROM listings QUALIFY row_number() OVER (PARTITION BY phone_id, store_id ORDER BY order_id, line) = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.keep_first(listings(spark, sf_dir), ["phone_id", "store_id"], [c("order_id"), c("line")]).select("phone_id", "store_id", "order_id", "line")


@query(_L + " SELECT phone_id, store_id, price FROM listings QUALIFY row_number() OVER (PARTITION BY phone_id, store_id ORDER BY price IS NULL, order_id, line) = 1")
def dedupe_prefer_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.keep_first(listings(spark, sf_dir), ["phone_id", "store_id"], [c("price").isNull(), c("order_id"), c("line")]).select("phone_id", "store_id", "price")


_SPECS = ["RAM", "System  Memory", "Front-Camera", "selfie", "Main Camera", "Internal_Storage", "ROM capacity", "memory type storage", "Chipset model", "Screen Protection", "Battery Info", "Wi-Fi", "back cover", "CPU speed", "Memory slot"]
_SPEC_STEPS = [(f"n IN ({', '.join(repr(v) for v in vs)})", k) for k, vs in SPEC_NAMES.items()] + [("contains(n, 'front') OR contains(n, 'selfie')", "front_camera"), ("contains(n, 'rear') OR contains(n, 'main') OR contains(n, 'primary') OR contains(n, 'back')", "rear_camera")]
_inside = lambda vs: "(" + " OR ".join(f"contains(n, '{v}')" for v in vs) + ")"
_SPEC_STEPS += [(f"{_inside(SPEC_NAMES['ram'])} AND {_inside(['storage', 'rom', 'internal', 'capacity'])}", "storage")] + [(_inside(vs), k) for k, vs in SPEC_NAMES.items()]


_SPEC = {"id": "p_partkey", "raw": f"concat({filled([*_SPECS, '{name}'])}, {filled(['', ' ', '', ' {size}', '-{type}'], 16)})"}


@query(rf"WITH r AS ({rows_sql(_SPEC)}), m AS (SELECT id, raw, trim(regexp_replace(lower(trim(raw)), '[\s_-]+', ' ', 'g')) AS n FROM r) SELECT id, raw, CASE " + " ".join(f"WHEN {w} THEN '{k}'" for w, k in _SPEC_STEPS) + " ELSE replace(n, ' ', '_') END AS spec FROM m")
def normalize_spec_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _SPEC).select("id", "raw", E.spec_name(c("raw")).alias("spec"))


_FILES = {"id": "p_partkey", "file": f"replace({filled(['star-tech-{year}-06-19T11-53-57-549Z.json', 'gadget-&-gear-{brand}-{year}-06-21T10-04-16-399Z.json', 'custom-mac-bd-{year}-06-28T19-13-20-124Z.json', 'plain-{name}.json', 'rio-{brand}-{year}-01-02.json', '{type}.json'])}, ' ', '-')"}


@query(rf"""WITH f AS ({rows_sql(_FILES)}), n AS (SELECT id, file, replace(coalesce(nullif(regexp_extract(file, '^(.+?)-\d{{4}}-\d{{2}}-\d{{2}}T', 1), ''), regexp_replace(replace(file, '.json', ''), '-\d{{4}}-\d{{2}}-\d{{2}}.*$', '')), '-', ' ') AS n FROM f)
SELECT id, file, regexp_replace(array_to_string(list_transform(string_split(n, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), '\bBd\b', 'BD') AS source FROM n""")  # fmt: skip
def source_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _FILES).select("id", "file", E.source_of_file(c("file")).alias("source"))


@query(_P + f" SELECT id, {_SLUG('name')} AS slug FROM phones")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phones(spark, sf_dir).select("id", T.slugify(c("name")).alias("slug"))


# listings as scraped


@query(_L + ", n AS (SELECT order_id, line, floor(price + 0.5)::BIGINT AS price, CASE WHEN original_price > price THEN floor(original_price + 0.5)::BIGINT END AS original FROM listings) SELECT order_id, line, price, original AS original_price, original - price AS discount_amount, floor((original - price) / original::DOUBLE * 100 + 0.5)::BIGINT AS discount_pct FROM n")
def listing_normalize_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = listings(spark, sf_dir).select("order_id", "line", round_half_up(c("price")).alias("price"), F.when(c("original_price") > c("price"), round_half_up(c("original_price"))).alias("original_price"))
    return df.withColumns({"discount_amount": c("original_price") - c("price"), "discount_pct": round_half_up((c("original_price") - c("price")) / c("original_price") * 100)})


@query(_L + " SELECT price IS NOT NULL AND in_stock AS valid, count(*) AS n FROM listings GROUP BY 1")
def listing_reject_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).groupBy((c("price").isNotNull() & c("in_stock")).alias("valid")).agg(F.count("*").alias("n"))


_VSLUG = lambda x: f"coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce({x}::VARCHAR, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'na')"


@query(_P + " SELECT id, concat_ws('_', " + ", ".join(_VSLUG(x) for x in ("brand", "name", "ram_gb", "storage_gb", "os")) + ") AS variant_key FROM phones")
def variant_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda x: F.coalesce(F.nullif(T.slugify(c(x).cast("string")), F.lit("")), F.lit("na"))
    return phones(spark, sf_dir).select("id", F.concat_ws("_", *[part(x) for x in ("brand", "name", "ram_gb", "storage_gb", "os")]).alias("variant_key"))


@query(_P + " SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(category, '[,/>]'), lambda t: trim(t)), lambda t: t <> ''), '|') AS tags FROM phones")
def category_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.filter(F.transform(F.split("category", "[,/>]"), lambda t: F.trim(t)), lambda t: t != "")
    return phones(spark, sf_dir).select("id", F.array_join(tags, "|").alias("tags"))


# snapshots


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = phones(spark, sf_dir).select("id", "name", "price_min")
    old = p.where("id % 7 != 0")
    new = p.where("id % 5 != 0").withColumn("price_min", F.when(c("id") % 3 == 0, c("price_min") + 100).otherwise(c("price_min")))
    return old, new


_SNAP = f"WITH phones AS ({PHONES_SQL}), o AS (SELECT id, name, price_min FROM phones WHERE id % 7 <> 0), n AS (SELECT id, name, CASE WHEN id % 3 = 0 THEN price_min + 100 ELSE price_min END AS price_min FROM phones WHERE id % 5 <> 0)"


@query(_SNAP + " SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.price_min IS NOT DISTINCT FROM n.price_min THEN 'unchanged' ELSE 'updated' END AS status FROM o FULL JOIN n ON o.id = n.id")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (d.withColumn("content_hash", E.content_hash("name", "price_min")).withColumn("doc_hash", E.content_hash("name")) for d in _snapshots(spark, sf_dir))
    return E.diff(old, new, "id", ["content_hash", "doc_hash"])


@query(_SNAP + " SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)")
def manifest_apply_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.upsert(*_snapshots(spark, sf_dir), "id")


@query(_SNAP + " SELECT o.* FROM o SEMI JOIN n USING (id)")
def manifest_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return old.join(new.select("id"), "id", "left_semi")


@query("SELECT p_partkey AS id, ('0x' || substr(sha1('0:' || p_name), 1, 8))::BIGINT AS hash32, ('0x' || substr(sha1('0:' || p_name), 1, 8))::BIGINT % 384 AS bucket, 'phone_' || substr(sha1(p_name), 1, 24) AS doc_id, sha256(p_name) AS doc_hash FROM part")
def stable_hash_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = T.token_hash(c("p_name"))
    raw = c("p_name").cast("binary")
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), h.alias("hash32"), (h % 384).alias("bucket"), F.concat(F.lit("phone_"), F.substring(F.sha1(raw), 1, 24)).alias("doc_id"), F.sha2(raw, 256).alias("doc_hash"))


#: Columns of the finder; Spark and DuckDB both read the expressions.
_FINDER = {
    "id": "id", "released": "2015 + id % 11", "depth_mm": "6 + id % 5", "weight_g": "150 + id % 100", "build": "CASE WHEN id % 3 = 0 THEN 'Glass' ELSE 'Plastic' END", "sim": "CASE WHEN id % 2 = 0 THEN 'Dual' ELSE 'Single' END",
    "display_type": "CASE WHEN display_text LIKE '%OLED%' THEN 'OLED' ELSE 'LCD' END", "inches": "display_inches", "refresh_hz": "60 + id % 4 * 28", "os": "CASE WHEN os LIKE 'iOS%' THEN 'iOS' ELSE 'Android' END", "chipset": "processor_text", "cpu_cores": "4 + id % 3 * 2",
    "ram_gb": "ram_gb", "storage_gb": "storage_gb", "card_slot": "id % 5 <> 0", "main_cam_mp": "12 + id * 13 % 190", "video_res": "CASE WHEN camera_text LIKE '%8K%' THEN '8K' ELSE '4K' END", "selfie_cam_mp": "8 + id % 30", "batt_mah": "battery_mah", "charging_w": "charging_w",
    "jack35": "id % 4 = 0", "form_factor": "CASE WHEN id % 10 = 4 THEN 'Fold' ELSE 'Bar' END", "price": "price_min",
}
_FIND = f"{_P}, f AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _FINDER.items())}, list_filter(string_split(coalesce(network, ''), ' / '), lambda x: x <> '') AS networks FROM phones)"
_WANTED = {
    "network": ["LTE"], "year": (2016, 2025), "dimension_max": 9, "weight_max": 240, "build": "Any", "sim": "Any", "display_type": "OLED", "size": (5.0, 7.0), "refresh_min": 60, "os": ["Android", "iOS"], "chipset": "a", "cpu_cores_min": 4, "ram_min": 4,
    "storage_min": 64, "card_slot": True, "main_cam_min": 20, "video_res": "Any", "selfie_cam_min": 8, "batt_min": 3000, "charging_min": 10, "jack": "no", "form_factor": "Bar", "price": (0.0, 900000.0),
}


@query(f"{_FIND} SELECT id FROM f WHERE list_contains(networks, 'LTE') AND released BETWEEN 2016 AND 2025 AND depth_mm <= 9 AND weight_g <= 240 AND display_type = 'OLED' AND inches BETWEEN 5.0 AND 7.0 AND refresh_hz >= 60 AND os IN ('Android', 'iOS') AND contains(lower(chipset), 'a') AND cpu_cores >= 4 AND ram_gb >= 4 AND storage_gb >= 64 AND card_slot AND main_cam_mp >= 20 AND selfie_cam_mp >= 8 AND batt_mah >= 3000 AND charging_w >= 10 AND NOT jack35 AND form_factor = 'Bar' AND price BETWEEN 0 AND 900000")
def finder_all_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phones(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in _FINDER.items()], "network")
    rows = rows.withColumn("networks", F.filter(F.split(F.coalesce("network", F.lit("")), " / "), lambda x: x != ""))
    return C.find(rows, _WANTED).select("id")


_SEARCHED = "k AS (SELECT id, brand, name, 'v_' || ram_gb || '_' || storage_gb AS variant_key FROM phones)"


@query(f"{_P}, {_SEARCHED} SELECT id FROM k WHERE contains(lower(brand), 'v_8') OR contains(lower(name), 'v_8') OR contains(lower(coalesce(variant_key, '')), 'v_8')")
def catalog_db_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phones(spark, sf_dir).select("id", "brand", "name", F.concat(F.lit("v_"), c("ram_gb").cast("string"), F.lit("_"), c("storage_gb").cast("string")).alias("variant_key"))
    return C.db_search(rows, " V_8").select("id")


@query(f"{_P}, b AS (SELECT * FROM (VALUES ('Samsung', 'samsung', NULL), ('VIVO', 'vivo', NULL), ('Apple', 'apple', 7), ('Unknown', 'unknown', NULL)) AS t(name, slug, phone_count)) SELECT b.name, slug, coalesce(phone_count, (SELECT count(*) FROM phones WHERE lower(brand) = lower(b.name)), 0) AS phones FROM b")
def catalog_brand_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("Samsung", "samsung", None), ("VIVO", "vivo", None), ("Apple", "apple", 7), ("Unknown", "unknown", None)], "name string, slug string, phone_count long")
    return C.brand_summaries(known, phones(spark, sf_dir))


_SORTED = f"{_P}, g AS (SELECT id, name, CASE WHEN id % 7 = 0 THEN NULL ELSE 2015 + id % 9 END AS release_year, id * 37 % 101 AS popularity FROM phones)"
_BY = {"popularity": "popularity DESC", "newest": "coalesce(release_year, 0) DESC", "oldest": "coalesce(release_year, 0)", "name": "name", "bogus": "popularity DESC"}


@query(_SORTED + " " + " UNION ALL ".join(f"(SELECT '{n}' AS sort, id, row_number() OVER (ORDER BY {o}, id) AS place FROM g QUALIFY place <= 10)" for n, o in _BY.items()))
def catalog_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of each order of the catalog list; an unknown one means popularity."""
    rows = phones(spark, sf_dir).select("id", "name", "brand", F.when(c("id") % 7 != 0, 2015 + c("id") % 9).alias("release_year"), (c("id") * 37 % 101).alias("popularity"), F.lit("").alias("slug"))
    out = None
    for sort in _BY:
        kind, name, direction = C.SORTS.get(sort, C.SORTS["popularity"])
        key = F.coalesce(c(name), F.lit(0)) if kind else c(name)
        page = C.list_page(rows, sort=sort, size=10).select(F.lit(sort).alias("sort"), "id", F.row_number().over(Window.orderBy(key.desc() if direction == "desc" else key.asc(), "id")).alias("place"))
        out = page if out is None else out.unionAll(page)
    return out
