"""Queries on rendered answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchlake.operators import comparison, pricing, specs
from merchlake.operators import rendering as R
from merchlake.plans import scores
from merchlake.plans.catalogue import _L, _RANK, _SLUG
from merchlake.plans.language import FIELDS_SQL
from merchlake.sources.catalog import PHONES_SQL, listings, phones, stores, table
from merchlake.sources.texts import filled, rows, rows_sql

QUERIES, ORACLE_SQL = {}, {}
c = F.col


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


_LABEL = "CASE WHEN starts_with(lower(name), lower(brand)) THEN name ELSE trim(brand || ' ' || name) END"
_ORDER = "list_position([" + ", ".join(f"'{k}'" for k in specs.LABELS) + "], field)"


@query(f"WITH phones AS ({PHONES_SQL}), f AS ({FIELDS_SQL}), t AS (SELECT id, string_agg('| **' || label || '** | ' || display || CASE WHEN summary <> '' THEN ' _(see source)_' ELSE '' END || ' |', chr(10) ORDER BY {_ORDER}) AS text FROM f GROUP BY id) SELECT id, '# ' || {_LABEL} || ' — specifications' || chr(10) || chr(10) || '| Field | Value |' || chr(10) || '|---|---|' || chr(10) || text || chr(10) AS markdown FROM phones JOIN t USING (id)")
def markdown_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = phones(spark, sf_dir)
    return R.spec_table(specs.described(p), p)


_money = lambda x: f"coalesce('৳' || format('{{:,}}', floor({x})::BIGINT), '—')"
_PCT = "CASE WHEN original_price > 0 THEN floor(discount_amount / original_price * 100 + 0.5)::BIGINT END"


@query(f"""{_L}, r AS (SELECT *, {_RANK} AS offer_rank FROM offers), b AS (SELECT phone_id, string_agg('| ' || store_name || ' | ' || {_money('price')} || ' | ' || {_money('original_price')} || ' | ' || coalesce('৳' || format('{{:,}}', floor(discount_amount)::BIGINT) || CASE WHEN {_PCT} > 0 THEN ' (' || {_PCT} || '%)' ELSE '' END, '—') || ' | ' || CASE WHEN in_stock THEN 'In stock' ELSE 'Out of stock' END || ' |', chr(10) ORDER BY offer_rank) AS text,
min(price) AS lo, max(price) AS hi, round_even(avg(price), 2) AS mean, arg_min(store_name, (price, offer_rank)) FILTER (WHERE price IS NOT NULL) AS cheap, arg_max(store_name, (price, -offer_rank)) FILTER (WHERE price IS NOT NULL) AS dear, count(*) FILTER (WHERE in_stock) AS n_in, count(*) FILTER (WHERE NOT in_stock) AS n_out FROM r GROUP BY phone_id)
SELECT id, '# ' || {_LABEL} || ' — pricing' || chr(10) || chr(10) || concat_ws(' · ', '**Cheapest:** ' || cheap || ' — ' || {_money('lo')}, CASE WHEN hi > lo THEN '**Highest:** ' || dear || ' — ' || {_money('hi')} END, CASE WHEN mean <> 0 THEN '**Average:** ' || {_money('mean')} END, '**Stock:** ' || n_in || ' in, ' || n_out || ' out', CASE WHEN round_even((hi - lo) / hi * 100, 2) <> 0 THEN '**Spread:** ' || printf('%.1f', round_even(round_even((hi - lo) / hi * 100, 2), 1)) || '%' END)
|| chr(10) || chr(10) || '| Store | Price | Original | Discount | Stock |' || chr(10) || '|---|---|---|---|---|' || chr(10) || text || chr(10) AS markdown FROM phones JOIN b ON phone_id = id""")  # fmt: skip
def markdown_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = pricing.by_rank(pricing.offers(listings(spark, sf_dir), stores(spark, sf_dir)))
    return R.price_table(ranked, phones(spark, sf_dir))


@query(scores._long_sql(list(scores._C)) + ", x AS (SELECT *, max(score) OVER w - min(score) OVER w AS gap, row_number() OVER (PARTITION BY dimension ORDER BY score DESC, id) AS n FROM long WINDOW w AS (PARTITION BY dimension)), l AS (SELECT id, dimension, CASE WHEN n = 1 AND gap >= 0.02 THEN '**' || printf('%.2f', score) || '**' ELSE printf('%.2f', score) END AS cell FROM x) SELECT dimension, '| ' || dimension || ' | ' || string_agg(cell, ' | ' ORDER BY id) || ' |' AS row FROM l GROUP BY dimension")
def markdown_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = phones(spark, sf_dir).where(c("id").isin(scores._COMPARED))
    return R.compare_table(comparison.dimensions(chosen), chosen)


@query(f"WITH phones AS ({PHONES_SQL}) SELECT id, 'About ' || name || ' by ' || brand || ': ' || coalesce(os, '') || ' / ' || coalesce(os, '') || '.' AS text FROM phones")
def template_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phones(spark, sf_dir).select("id", R.filled("About {{name}} by {{ brand }}: {{os}} / {{os}}.", {n: c(n) for n in ("name", "brand", "os")}).alias("text"))


_SECTION = {"section": filled(["Battery", "Zoo", "Network", "{type}", "Alpha", "Memory", "{brand}", "Misc"])}
_PLACE = "list_position([" + ", ".join(f"'{s}'" for s in R.SECTIONS) + "], section)"


@query(f"SELECT section, row_number() OVER (ORDER BY {_PLACE} IS NULL, {_PLACE}, section) AS place FROM (SELECT DISTINCT section FROM ({rows_sql(_SECTION)}))")
def section_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections in their order; as there are few different ones, one task numbers them."""
    return rows(spark, sf_dir, _SECTION).distinct().withColumn("place", F.row_number().over(Window.orderBy(*R.section_order(c("section")))))


@query("SELECT event_id, event_type, value, (ts::VARCHAR)[:10] AS ts, props FROM events")
def metadata_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = e.select(*R.scalars(["event_id", "event_type", "value", "ts", "props"], dict(e.dtypes)))
    return out.withColumn("ts", F.substring("ts", 1, 10))


@query(f"WITH phones AS ({PHONES_SQL}), b AS (SELECT DISTINCT brand FROM phones WHERE {_SLUG('brand')} = 'oneplus') SELECT id, phones.brand FROM phones JOIN b USING (brand)")
def brand_by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products of the brands that a slug stands for; an unknown slug finds none."""
    from merchlake.operators.catalog import of_brand_slug

    return of_brand_slug(phones(spark, sf_dir), "oneplus").select("id", "brand")


@query(f"WITH phones AS ({PHONES_SQL}) SELECT id, coalesce(nullif(lower(trim({_SLUG('name')})), ''), id::VARCHAR) AS key, {_LABEL} AS label FROM phones")
def phone_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from merchlake.operators.catalog import phone_key

    return phones(spark, sf_dir).select("id", phone_key(c("name"), c("id")).alias("key"), R.display_label(c("brand"), c("name")).alias("label"))
