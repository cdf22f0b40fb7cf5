"""Queries on catalog and store pages and on values scraped from them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.sources import pages as P
from merchlake.sources.catalog import PHONES_SQL, phones, table
from merchlake.sources.scratch import kept
from merchlake.sources.texts import filled, rows, rows_sql

QUERIES, ORACLE_SQL = {}, {}
c = F.col
BASE = "https://phones.example/catalog"
#: Pages as sites write them; what stands in braces comes from a product's row.
MAKERS = """<html><body><ul><li><a href="acme-phones-{id}.php">Acme {brand}</a></li><li><a href="zeta-phones-1{k}.php">Zeta &amp; {brand}</a></li></ul>
<table><tr><td><a href="acme-phones-{id}.php" class="x">Acme {brand}<br><span>1,1{k} devices</span></a></td><td><a href="/brands/nova-phones-3.php"> Nova <span>0 devices</span></a></td></tr></table><a href="news-4.php3">News</a></body></html>"""
MODELS = """<div class="makers"><ul><li><a href="acme_one-{id}.php"><img src="t/{id}.jpg" title="Acme {name} Android smartphone. Announced Sep {year}."><strong><span>{name}</span></strong></a></li>
<li><a href="acme_tab-14051.php"><img src="t/tab.jpg" title="Acme Tab  tablet. Announced 2024."><strong><span>Tab</span></strong></a></li><li><a href="acme_w-14052.php"><img title="A smartwatch" src="t/w.jpg">Wrist</a></li>
<li><a href="acme_two-14053.php"><img src="t/two.jpg" title="Acme {brand} phone.">{name}  Plus</a></li></ul></div><a class="prevnextbutton" title="Next page" href="acme-phones-f-{id}-0-p2.php">&gt;</a>"""
DEVICE = """<html><head><meta property="og:image" content="pic/first.jpg"><meta name="author" content="{brand}"><meta property="og:image" content="pic/one.jpg"><meta property="og:title" content=""></head><body>
<h1 class="t" data-spec="modelname">{brand} {name}</h1><span data-spec="released-hl">Released {year}, September</span><span data-spec="ramsize-hl">{gb}</span><span data-spec="batsize-hl"></span><span data-spec="camerapixels-hl">50</span><p>4,419,9{k} hits</p><img src="{id}.jpg"><img alt="x" src="b.jpg"><img src="{id}.jpg">
<table><tr><th rowspan=3>Network</th><td class="ttl"><a>Technology</a></td><td class="nfo">GSM / 5G</td></tr><tr><td class="ttl">&amp;Speed</td><td class="nfo">HSPA</td></tr><tr><td class="ttl"></td><td class="nfo">5G SA</td></tr></table>
<table><tr><th>Battery</th><td class="ttl">Type</td><td class="nfo">{mah} mAh</td></tr><tr><td class="ttl">Type</td><td class="nfo">silicon-carbon</td></tr><tr><td class="ttl">Empty</td><td class="nfo"> </td></tr></table>
<table><tr><th>Main Camera</th><td class="nfo">no label</td></tr><tr><td class="ttl">Triple</td><td class="nfo">50 MP</td></tr></table><table><tr><td class="ttl">none</td><td class="nfo">no section</td></tr></table></body></html>"""
SHOP = """<p>Great  {name}</p><table class="s"><tr><th>Display:</th><td>{inch} inch</td></tr><tr><td colspan=2>Section</td></tr><tr><td>RAM</td><td>8 GB</td></tr><tr><td>RAM</td><td>{gb} GB</td></tr></table><p>See <b>more</b>.</p><table><tr><td>x</td><td>y</td></tr></table>"""
PAGE = {"page_id": "p_partkey", "html": filled([MAKERS, MODELS, DEVICE, SHOP, ""])}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


_PG = f"WITH pages AS ({rows_sql(PAGE)})"
_e = lambda p: p.replace("'", "''")
_all = lambda x, p, g: f"regexp_extract_all({x}, '{_e(p)}', {g})"
_one = lambda x, p, g=1: f"nullif(regexp_extract({x}, '{_e(p)}', {g}), '')"
_text = lambda x: rf"trim(regexp_replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&amp;', '&'), '\s+', ' ', 'g'))"
_abs = lambda h: f"CASE WHEN regexp_matches({h}, '^[a-z]+://') THEN {h} WHEN starts_with({h}, '/') THEN 'https://phones.example' || {h} WHEN {h} <> '' THEN '{BASE}/' || {h} END"
_A = f"{_PG}, a AS (SELECT page_id, unnest(range(0, len({_all('html', P.ANCHOR, 1)}))) AS pos, unnest({_all('html', P.ANCHOR, 1)}) AS href, unnest({_all('html', P.ANCHOR, 2)}) AS inn FROM pages)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each product."""
    return rows(spark, sf_dir, PAGE)


_SPAN_TEXT = _text(_one("inn", P.SPAN))


@query(f"""{_A}, b AS (SELECT page_id, pos, regexp_extract(href, '-([0-9]+)[.]php', 1)::BIGINT AS brand_id, {_text(f"regexp_replace(inn, '{P.SPAN}', '', 'g')")} AS name, regexp_replace(href, '[.]php$', '') AS slug, {_abs('href')} AS url, nullif(replace({_one(_SPAN_TEXT, '([0-9,]+)')}, ',', '')::BIGINT, 0) AS devices FROM a WHERE regexp_matches(href, '-phones-[0-9]+[.]php$'))
SELECT page_id, brand_id, name, slug, url, devices FROM b WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY page_id, brand_id ORDER BY devices IS NULL, pos) = 1""")  # fmt: skip
def page_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.brands(_pages(spark, sf_dir), BASE)


_TITLE = f"coalesce({_one('inn', P.TITLE)}, '')"
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(lower({_TITLE}), '{p}') THEN '{k}'" for k, p in P.DEVICE_TYPES) + " ELSE 'other' END"
_MODELS_SQL = rf"""{_A} SELECT page_id, regexp_extract(href, '-([0-9]+)[.]php', 1)::BIGINT AS model_id, coalesce(nullif({_SPAN_TEXT}, ''), {_text('inn')}) AS name, regexp_replace(href, '[.]php$', '') AS slug, {_abs('href')} AS url, {_one('inn', P.SOURCE)} AS thumb, trim(regexp_replace({_TITLE}, '\s+', ' ', 'g')) AS summary, {_TYPE} AS device_type
FROM a WHERE regexp_matches(href, '-[0-9]+[.]php$') AND contains(inn, '<img')"""  # fmt: skip


@query(_MODELS_SQL)
def page_models_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.models(_pages(spark, sf_dir), BASE, phones_only=False)


@query(f"SELECT * FROM ({_MODELS_SQL}) WHERE device_type = 'phone'")
def page_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.models(_pages(spark, sf_dir), BASE)


@query(f"{_PG} SELECT page_id, {_abs(_one('html', P.NEXT))} AS next_url FROM pages")
def page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.next_page(_pages(spark, sf_dir), BASE)


#: List pages of brands: six in a row, some of which lead back to the second, or to a page that is not there.
_LINKED = {
    "page_id": "p_partkey", "url": f"concat('{BASE}/list-', p_partkey, '.php')",
    "html": f"concat('<a class=\"x\" title=\"Next page\" href=\"', CASE WHEN p_partkey % 6 < 5 THEN concat('list-', p_partkey + 1, '.php') WHEN p_partkey % 4 = 1 THEN concat('{BASE}/list-', p_partkey - 4, '.php') WHEN p_partkey % 4 = 3 THEN '/none.php' ELSE '' END, '\">next</a>')",
}


@query(f"""WITH RECURSIVE linked AS ({rows_sql(_LINKED)}), l AS (SELECT page_id, url, {_abs(_one('html', P.NEXT))} AS next_url FROM linked),
walk AS (SELECT url AS first_url, 0 AS step, url, next_url, [url] AS been FROM l WHERE page_id % 6 = 0 UNION ALL SELECT first_url, step + 1, l.url, l.next_url, list_append(been, l.url) FROM walk JOIN l ON l.url = walk.next_url WHERE NOT list_contains(been, l.url))
SELECT first_url, step, url FROM walk""")  # fmt: skip
def pages_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one comes to from the first page of each brand."""
    linked = rows(spark, sf_dir, _LINKED)
    return P.followed(linked, linked.where("page_id % 6 = 0"), BASE)


_SPEC = f"""{_PG}, tb AS (SELECT page_id, unnest(range(0, len({_all('html', P.TABLE, 0)}))) AS nth, unnest({_all('html', P.TABLE, 0)}) AS t FROM pages), sec AS (SELECT *, {_text(_one('t', P.HEAD))} AS section FROM tb),
rw AS (SELECT page_id, nth, section, unnest(range(0, len({_all('t', P.ROW, 0)}))) AS pos, unnest({_all('t', P.ROW, 0)}) AS r FROM sec WHERE section <> ''),
lv AS (SELECT page_id, nth, section, pos, nullif({_text(_one('r', P.LABEL))}, '') AS label, nullif({_text(_one('r', P.VALUE))}, '') AS value FROM rw),
kv AS (SELECT *, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY page_id, nth ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '_') AS key FROM lv WHERE value IS NOT NULL),
specs AS (SELECT page_id, section, key, string_agg(value, ' ' ORDER BY nth, pos) AS value, min(nth * 1000 + pos) AS first FROM kv GROUP BY ALL)"""  # fmt: skip


@query(f"{_SPEC} SELECT page_id, section, key, value FROM specs")
def page_spec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.spec_rows(_pages(spark, sf_dir)).select("page_id", "section", "key", "value")


_SPACED = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
_quick = lambda k: f"(SELECT v FROM (SELECT unnest({_all('html', P.QUICK, 1)}) AS k, {_text('unnest(' + _all('html', P.QUICK, 2) + ')')} AS v) WHERE k = '{k}' AND v <> '' LIMIT 1)"
_sp = lambda s, k: f"(SELECT value FROM specs WHERE specs.page_id = pages.page_id AND section = '{s}' AND key = '{k}')"


@query(rf"""{_SPEC} SELECT page_id, {_text(_one('html', P.MODEL_NAME))} AS model_name, split_part({_text(_one('html', P.MODEL_NAME))}, ' ', 1) AS brand, 'pic/one.jpg' AS image_url, regexp_extract(coalesce({_quick('released')}, {_sp('Launch', 'Announced')}), '((?:19|20)[0-9]{{2}})', 1)::INT AS release_year, replace({_one(_SPACED, '(?i)([0-9,]+)[ ]*hits')}, ',', '')::BIGINT AS popularity,
{_quick('ramsize')} || ' GB' AS ram, coalesce({_quick('storage')}, {_sp('Memory', 'Internal')}) AS storage, coalesce({_quick('chipset')}, {_sp('Platform', 'Chipset')}) AS chipset, coalesce({_quick('batsize')} || ' mAh', {_sp('Battery', 'Type')}) AS battery, coalesce({_sp('Display', 'Size')}, {_quick('displaysize')}) AS display,
coalesce((SELECT arg_min(value, first) FROM specs WHERE specs.page_id = pages.page_id AND section = 'Main Camera'), {_quick('camerapixels')} || ' MP') AS camera, coalesce({_quick('os')}, {_sp('Platform', 'OS')}) AS os, {_sp('Network', 'Technology')} AS network FROM pages WHERE regexp_matches(html, '{P.MODEL_NAME}')""")  # fmt: skip
def page_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.devices(_pages(spark, sf_dir))


@query(f"{_PG} SELECT page_id, array_to_string(list_filter({_all('html', P.SOURCE, 1)}, lambda x, i: list_position({_all('html', P.SOURCE, 1)}, x) = i), ',') AS pictures FROM pages")
def page_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.array_join(P.pictures(c("html")), ",").alias("pictures"))


_entries = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")


@query(f"{_PG}, m AS (SELECT page_id, unnest(range(0, len({_all('html', P.META, 1)}))) AS pos, unnest({_all('html', P.META, 1)}) AS k, unnest({_all('html', P.META, 2)}) AS v FROM pages), l AS (SELECT page_id, k, arg_max(v, pos) AS v FROM m WHERE k <> '' AND v <> '' GROUP BY ALL) SELECT page_id, coalesce(string_agg(k || '=' || v, '; ' ORDER BY k), '') AS meta FROM pages LEFT JOIN l USING (page_id) GROUP BY page_id")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", _entries(P.meta(c("html"))).alias("meta"))


_FIRST = f"""{_PG}, b AS (SELECT page_id, html, regexp_extract(html, '{P.TABLE}', 0) AS tab FROM pages WHERE page_id % 5 = 3), r AS (SELECT page_id, unnest(range(0, len({_all('tab', P.ROW, 0)}))) AS pos, unnest({_all('tab', P.ROW, 0)}) AS r FROM b),
cells AS (SELECT page_id, pos, {_all('r', P.CELL, 1)} AS x FROM r), kv AS (SELECT page_id, regexp_replace({_text('x[1]')}, ':$', '') AS k, arg_max({_text('x[2]')}, pos) AS v FROM cells WHERE len(x) >= 2 AND {_text('x[1]')} <> '' AND {_text('x[2]')} <> '' GROUP BY ALL)"""


@query(rf"""{_FIRST} SELECT b.page_id, coalesce((SELECT string_agg(k || '=' || v, '; ' ORDER BY k) FROM kv WHERE kv.page_id = b.page_id), '') AS specs, trim(regexp_replace(regexp_replace(regexp_replace(replace(html, tab, ' '), '(?i)</?(p|table|tr|td)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS description FROM b""")
def page_first_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    shops = _pages(spark, sf_dir).where("page_id % 5 = 3")
    return shops.select("page_id", P.first_table(c("html")).alias("t")).select("page_id", _entries(c("t.specs")).alias("specs"), "t.description")


@query("SELECT page_id, array_to_string(list_filter(regexp_extract_all(html, '(?is)<img\\b[^>]*\\bsrc=\"([^\"]*)\"', 1), lambda x: true), ',') AS pictures, coalesce(regexp_extract(url, '([0-9]+)', 1), '') AS first_number FROM pages")
def page_table_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns over the table of raw pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(P.SOURCE), F.lit(1)), ",").alias("pictures"), F.coalesce(T.first_match(c("url"), r"(\d+)"), F.lit("")).alias("first_number"))


#: Rows of a specification table as a shop's page or interface gives them, five for each product.
_SPEC_ROW = {"id": "p_partkey", "pos": "pos", "key": filled(["Display :", "General", "Display", "Share", "k" * 81, " RAM ", "OS", "{type}:", ""], 1).replace("p_partkey", "(p_partkey * 5 + pos)"), "value": filled(["{inch}", "x", "6.7", "{name}", "long", " {gb}  GB ", "", "{size}"], 1)}
_SPEC_ROW["value"] = f"concat({_SPEC_ROW['value']}, CASE WHEN p_partkey % 8 = 6 THEN '' ELSE concat('/', pos) END)"
_SPEC_ROW["is_title"] = "(CASE WHEN (p_partkey + pos) % 7 = 0 THEN true WHEN (p_partkey + pos) % 7 < 4 THEN false ELSE NULL END)"
_SPEC_SQL = rows_sql(_SPEC_ROW).replace("FROM part", "FROM part, (VALUES (0), (1), (2), (3), (4)) AS places(pos)").replace("{type}", "type")
_SPEC_ROW = {n: e.replace("CAST(p_type AS STRING)", "p_type") for n, e in _SPEC_ROW.items()}


def _spec_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos")
    every = kept(table(spark, sf_dir, "part").select("*", places).selectExpr(*[f"{e} AS {n}" for n, e in _SPEC_ROW.items()]))
    return every.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "value", "is_title"))).alias("rows"))


_KV = rf"s AS ({_SPEC_SQL}), r AS (SELECT pos, id, trim(regexp_replace(regexp_replace(key, '\s+', ' ', 'g'), '\s*:\s*$', '')) AS k0, trim(regexp_replace(key, '\s+', ' ', 'g')) AS k1, trim(regexp_replace(value, '\s+', ' ', 'g')) AS v FROM s WHERE NOT coalesce(is_title, false))"


@query(f"WITH {_KV}, f AS (SELECT id, k0 AS k, arg_min(v, pos) AS v FROM r WHERE k0 <> '' AND v <> '' AND length(k0) <= 80 AND lower(k0) <> 'share' GROUP BY ALL) SELECT ids.id, coalesce(string_agg(k || '=' || v, '; ' ORDER BY k), '') AS specs FROM (SELECT DISTINCT id FROM s) ids LEFT JOIN f USING (id) GROUP BY ids.id")
def spec_rows_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spec_lists(spark, sf_dir).select("id", _entries(P.key_rows(c("rows"), ["share"])).alias("specs"))


@query(f"WITH {_KV}, f AS (SELECT id, k1 AS k, arg_max(v, pos) AS v FROM r WHERE k1 <> '' AND v <> '' GROUP BY ALL) SELECT ids.id, coalesce(string_agg(k || '=' || v, '; ' ORDER BY k), '') AS specs FROM (SELECT DISTINCT id FROM s) ids LEFT JOIN f USING (id) GROUP BY ids.id")
def spec_rows_of_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spec_lists(spark, sf_dir).select("id", _entries(P.api_specs(c("rows"))).alias("specs"))


_some = lambda value, nulls, zeros: f"(CASE WHEN p_partkey % {nulls} = 0 THEN NULL WHEN p_partkey % {zeros} = 1 THEN 0 ELSE {value} END)"
#: Regular and reduced prices of a variant, and of its listing, with gaps and zeros.
_PRICE = {"id": "p_partkey", "a": _some("300 + p_partkey * 37 % 700", 5, 11), "b": _some("200 + p_partkey * 53 % 900", 3, 7), "c": _some("300 + p_partkey * 41 % 700", 4, 13), "d": _some("250 + p_partkey * 29 % 800", 6, 17)}


@query(f"SELECT id, CASE WHEN coalesce(b, d) > 0 THEN coalesce(b, d) ELSE coalesce(a, c) END AS price, CASE WHEN coalesce(a, c) > CASE WHEN coalesce(b, d) > 0 THEN coalesce(b, d) ELSE coalesce(a, c) END THEN coalesce(a, c) END AS original_price FROM ({rows_sql(_PRICE)})")
def price_of_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _PRICE).select("id", P.sku_price(c("a"), c("b"), c("c"), c("d")).alias("p")).select("id", "p.*")


@query(f"SELECT id, CASE WHEN b > 0 AND b < a THEN b ELSE coalesce(nullif(a, 0), nullif(b, 0), nullif(c, 0)) END AS price, CASE WHEN b > 0 AND b < a THEN a END AS original_price FROM ({rows_sql(_PRICE)})")
def price_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _PRICE).select("id", P.chosen_price(c("a"), c("b"), c("c")).alias("p")).select("id", "p.*")


_STOCK = {"id": "p_partkey", "t": filled(["In Stock: {size}", "Out of stock", "call {brand}", None, "", None, "in stock, out of stock"]), "b": filled([None, "instock", "product-{id} instock", "OutOfStock", None], 2)}


@query(f"SELECT id, CASE WHEN trim(t) <> '' THEN contains(lower(t), 'in stock') AND NOT contains(lower(t), 'out of stock') WHEN contains(lower(b), 'instock') THEN true WHEN contains(lower(b), 'outofstock') THEN false ELSE true END AS in_stock FROM ({rows_sql(_STOCK)})")
def stock_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _STOCK).select("id", P.in_stock(c("t"), c("b"), default=True).alias("in_stock"))


_NAMED = {"id": "p_partkey", "n": filled(["Galaxy S{k} Ultra", "iPhone {size}", "lava {name}", "Redmi Note {gb}", "", "ROG Phone {gb}", "{name}", "{brand} {name}"]), "v": filled(["{brand}", "My Shop", None, "", "my shop", None, "My  Shop"], 3)}


@query("SELECT id, CASE WHEN trim(v) <> '' AND lower(regexp_replace(v, ' +', ' ', 'g')) <> 'my shop' THEN v " + " ".join(f"WHEN regexp_matches(n, '(?i){p}') THEN '{b}'" for b, p in P.BRAND_WORDS) + f" WHEN n <> '' THEN upper(split_part(n, ' ', 1)[1]) || split_part(n, ' ', 1)[2:] END AS brand FROM ({rows_sql(_NAMED)})")
def brand_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _NAMED).select("id", P.inferred_brand(c("n"), c("v"), ["my shop"]).alias("brand"))


_CRUMBS = {"id": "p_partkey", "o": filled(["Mobile, {brand}", "product", None, "", "{type}, phones", "{type} phones, x"]), "a": filled(["Home", "", " "], 2), "z": filled(["Phones", "Android ", "", "{type}", "home page"], 3)}


@query(f"SELECT id, CASE WHEN regexp_matches(trim(split_part(coalesce(o, ''), ',', 1)), '(?i)mobile|phone') THEN trim(split_part(o, ',', 1)) WHEN NOT regexp_matches(list_filter([a, z], lambda x: trim(x) <> '')[-1], '(?i)home') THEN list_filter([a, z], lambda x: trim(x) <> '')[-1] END AS category FROM ({rows_sql(_CRUMBS)})")
def category_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _CRUMBS).select("id", P.category(c("o"), F.array("a", "z")).alias("category"))


_LOCAL = {"id": "p_partkey", "t": filled(["plain {name}", '{"en": "{name}", "bn": "Bangla"}', '{"bn": "{brand} {size}"}', '"{type}"', None, "{bad {id}", "{id}"])}


@query(f"SELECT id, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN coalesce(t->>'$.en', t->>'$.bn') WHEN json_valid(t) THEN t->>'$' ELSE t END AS text FROM ({rows_sql(_LOCAL)})")
def localized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _LOCAL).select("id", P.localized(c("t")).alias("text"))


_prose = lambda x, ps: "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({x}, '{_e(p)}', 1)), '')" for p in ps) + ")"
_PROSE = "lower(concat_ws(' ', battery_text || ' and ' || camera_text, name))"
_VALUES = "concat_ws('  ||  ', 'Memory: ' || coalesce(ram_gb, 0) || ' GB LPDDR5', processor_text)"
_BLOB = f"concat_ws('  ||  ', {_VALUES}, {_PROSE})"


@query(f"""WITH phones AS ({PHONES_SQL}) SELECT id, nullif(regexp_extract({_prose(_BLOB, P.RAM_PROSE)}, '([0-9]+)', 1), '')::BIGINT AS ram, nullif(regexp_extract({_prose(_BLOB, P.STORAGE_PROSE)}, '([0-9]+)', 1), '')::BIGINT AS storage, coalesce(nullif(trim(processor_text), ''), {_prose(_PROSE, P.KEY_SPECS['chipset'][1])}) AS chipset,
{', '.join(f"{_prose(_PROSE, P.KEY_SPECS[k][1])} AS {k}" for k in ('battery', 'display', 'camera', 'os'))}, upper({_prose(_PROSE, P.KEY_SPECS['network'][1])}) AS network FROM phones""")  # fmt: skip
def key_specs_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(F.struct(F.lit("Memo").alias("k"), F.concat(F.lit("Memory: "), F.coalesce("ram_gb", F.lit(0)).cast("string"), F.lit(" GB LPDDR5")).alias("v")), F.struct(F.lit("Main Chipset").alias("k"), c("processor_text").alias("v")))
    specs = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    mined = P.key_specs(specs, c("name"), F.concat(c("battery_text"), F.lit(" and "), c("camera_text")))
    return phones(spark, sf_dir).select("id", *[e.alias(n) for n, e in mined.items()])
