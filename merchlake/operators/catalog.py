"""Catalog reads: filters, facets, listing pages, brand counts, details."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.functions import text as T

c = F.col


def at_least_or_unknown(column: str, least: float) -> Column:
    """A minimum that unknown values pass."""
    return (c(column) >= least) | c(column).isNull()


def search(phones: DataFrame, brand: str | None = None, budget_min: float | None = None, budget_max: float | None = None, ram: int | None = None, storage: int | None = None, battery: int | None = None, charging: int | None = None, inches_min: float | None = None, inches_max: float | None = None, processor: str | None = None, category: str | None = None, is_foldable: bool = False, is_5g: bool = False) -> DataFrame:
    """Products with a price that meet all given criteria. Minima of memory, battery and charging let unknowns pass."""
    tests = [c("price_min") > 0]
    if brand:
        tests.append(c("brand").ilike(brand.strip()))
    tests += [test(c(name), bound) for name, test, bound in (("price_min", operator.ge, budget_min), ("price_min", operator.le, budget_max), ("display_inches", operator.ge, inches_min), ("display_inches", operator.le, inches_max)) if bound is not None]
    tests += [at_least_or_unknown(name, least) for name, least in (("ram_gb", ram), ("storage_gb", storage), ("battery_mah", battery), ("charging_w", charging)) if least is not None]
    tests += [c(name).ilike(f"%{part}%") for name, part in (("processor_text", processor), ("category", category)) if part]
    if is_foldable:
        tests.append(reduce(operator.or_, [c(name).ilike(p) for name in ("category", "name") for p in ("%fold%", "%flip%")]))
    if is_5g:
        tests.append(c("network").ilike("%5g%") | c("name").ilike("%5g%"))
    return phones.where(reduce(operator.and_, tests))


_COMPARE = {"$eq": operator.eq, "$ne": operator.ne, "$lt": operator.lt, "$lte": operator.le, "$gt": operator.gt, "$gte": operator.ge}


def where(conditions: dict) -> Column:
    """A condition from a nested dict: {"field": value}, {"field": {"$gte": 3}}, {"$and": [...]}, {"$or": [...]}."""
    tests = []
    for key, value in conditions.items():
        if key in ("$and", "$or"):
            tests.append(reduce(operator.and_ if key == "$and" else operator.or_, [where(v) for v in value]))
        elif isinstance(value, dict):
            tests += [_COMPARE[op](c(key), F.lit(v)) for op, v in value.items()]
        else:
            tests.append(c(key) == F.lit(value))
    return reduce(operator.and_, tests) if tests else F.lit(True)


#: Sort orders of the catalog list; unknown names mean popularity.
SORTS = {
    "popularity": [F.coalesce, "popularity", "desc"],
    "newest": [F.coalesce, "release_year", "desc"],
    "oldest": [F.coalesce, "release_year", "asc"],
    "name": [None, "name", "asc"],
}


def list_page(catalog: DataFrame, search_text: str = "", brand: str = "", year: int | None = None, min_year: int | None = None, sort: str = "popularity", page: int = 1, size: int = 24) -> DataFrame:
    """One page of the catalog with total and total_pages on each row. Pages begin at 1; sizes are held within 1..100."""
    page, size = max(1, page), min(100, max(1, size))
    df = catalog
    if search_text.strip():
        df = df.where(F.contains(T.lowered(c("brand"), c("name")), F.lit(search_text.strip().lower())))
    if brand.strip():
        b = brand.strip().lower()
        df = df.where((F.lower("brand") == b) | F.startswith(c("slug"), F.lit(f"{b}_")))
    if year is not None:
        df = df.where(c("release_year") == year)
    if min_year is not None:
        df = df.where(F.coalesce(c("release_year"), F.lit(0)) >= min_year)
    kind, name, direction = SORTS.get(sort, SORTS["popularity"])
    key = F.coalesce(c(name), F.lit(0)) if kind else c(name)
    order = [key.desc() if direction == "desc" else key.asc(), c("id")]
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.join(F.broadcast(total)).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(c("total") / size)).cast("long"))


def typeahead(catalog: DataFrame, text: str, most: int = 8) -> DataFrame:
    """The first matches by id; at most 20."""
    return catalog.where(F.contains(T.lowered(c("brand"), c("name")), F.lit(text.strip().lower()))).orderBy("id").limit(min(20, max(1, most)))


def brand_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("brand").agg(F.count("*").alias("phones")).withColumn("slug", T.slugify(c("brand")))


def brands_by_letter(catalog: DataFrame) -> DataFrame:
    """Brands under their first letter; others under #."""
    first = F.upper(F.substring("brand", 1, 1))
    letter = F.when(first.rlike("^[A-Z]$"), first).otherwise(F.lit("#"))
    return catalog.select(letter.alias("letter"), "brand").distinct().groupBy("letter").agg(F.count("*").alias("brands"), F.array_join(F.array_sort(F.collect_list("brand")), ", ").alias("names"))


def details(phones: DataFrame, listings: DataFrame, stores: DataFrame) -> DataFrame:
    """A row a product: cheapest positive listing, whether any store has it, and its stores."""
    offers = listings.join(stores, "store_id")
    found = offers.groupBy("phone_id").agg(
        F.min(F.when(c("price") > 0, c("price"))).alias("lowest"), F.bool_or("in_stock").alias("available"), F.count("*").alias("listings"), F.count_distinct("store_id").alias("stores")
    )
    hint = F.coalesce(F.format_number(c("lowest"), 0), F.lit("TBD"))
    return phones.select("id", "name").join(found, c("id") == c("phone_id"), "left").select("id", "name", hint.alias("price_hint"), F.coalesce("available", F.lit(False)).alias("available"), F.coalesce("listings", F.lit(0)).alias("listings"), F.coalesce("stores", F.lit(0)).alias("stores"))


def in_given_order(phones: DataFrame, slugs: list[str]) -> DataFrame:
    """The first product of each slug, in the order asked for; unknown slugs are left out."""
    spark = phones.sparkSession
    asked = spark.createDataFrame(list(enumerate(slugs)), "pos int, slug string")
    first = Window.partitionBy("pos").orderBy("id")
    return phones.join(asked, "slug").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def finder(phones: DataFrame, networks: list[str], filters: dict) -> DataFrame:
    """Facets: all networks asked for are there, enumerations unless "Any", ranges; `phones.networks` is an array."""
    tests = [F.size(F.array_except(F.array(*[F.lit(n) for n in networks]), "networks")) == 0] if networks else []
    for name, wanted in filters.items():
        if isinstance(wanted, tuple):
            tests.append(c(name).between(*wanted))
        elif wanted != "Any":
            tests.append(c(name) == wanted)
    return phones.where(reduce(operator.and_, tests)) if tests else phones


def related(phones: DataFrame, item: int, most: int = 6) -> DataFrame:
    """Other products, those of the same brand first, then of the same category."""
    one = F.broadcast(phones.where(c("id") == item).select(c("brand").alias("b"), c("category").alias("g")))
    return phones.where(c("id") != item).join(one).orderBy((c("brand") == c("b")).desc(), (c("category") == c("g")).desc(), "id").limit(most).drop("b", "g")


def page_numbers(pages: Column, page: Column) -> Column:
    """Page numbers to show: the first, the last, and two around the current one."""
    return F.filter(F.sequence(F.lit(1), pages), lambda i: (i == 1) | (i == pages) | (F.abs(i - page) <= 2))


def of_brand_slug(phones: DataFrame, slug: str) -> DataFrame:
    """Products of all brands whose slug is the given one."""
    brands = phones.select("brand").distinct().where(T.slugify(c("brand")) == slug)
    return phones.join(brands, "brand", "left_semi")


def phone_key(name: Column, number: Column) -> Column:
    """A key to refer to a product by: its slug, or else its number."""
    return F.coalesce(T.blank_to_null(T.slugify(name)), number.cast("string"))


# Facets of the finder, how each is tested, and the column that it tests
FACETS = {
    "network": ("all_of", "networks"), "year": ("between", "released"), "dimension_max": ("at_most", "depth_mm"), "weight_max": ("at_most", "weight_g"), "build": ("equal", "build"), "sim": ("equal", "sim"), "display_type": ("equal", "display_type"),
    "size": ("between", "inches"), "refresh_min": ("at_least", "refresh_hz"), "os": ("one_of", "os"), "chipset": ("holds", "chipset"), "cpu_cores_min": ("at_least", "cpu_cores"), "ram_min": ("at_least", "ram_gb"), "storage_min": ("at_least", "storage_gb"),
    "card_slot": ("needed", "card_slot"), "main_cam_min": ("at_least", "main_cam_mp"), "video_res": ("equal", "video_res"), "selfie_cam_min": ("at_least", "selfie_cam_mp"), "batt_min": ("at_least", "batt_mah"), "charging_min": ("at_least", "charging_w"),
    "jack": ("yes_no", "jack35"), "form_factor": ("equal", "form_factor"), "price": ("between", "price"),
}
_FACET_TESTS = {
    "all_of": lambda x, v: F.size(F.array_except(F.array(*[F.lit(n) for n in v]), x)) == 0 if v else None,
    "one_of": lambda x, v: x.isin(*v) if v else None,
    "between": lambda x, v: x.between(*v),
    "at_most": lambda x, v: x <= v,
    "at_least": lambda x, v: x >= v,
    "equal": lambda x, v: x == v if v != "Any" else None,
    "holds": lambda x, v: F.contains(F.lower(x), F.lit(v.lower())) if v != "Any" else None,
    "needed": lambda x, v: x if v else None,
    "yes_no": lambda x, v: {"yes": x, "no": ~x}.get(v),
}


def find(phones: DataFrame, wanted: dict) -> DataFrame:
    """Products that meet all wanted facets; lists that are empty, "Any", "any" and false flags ask for nothing."""
    tests = [_FACET_TESTS[kind](c(column), wanted[name]) for name, (kind, column) in FACETS.items() if name in wanted]
    tests = [t for t in tests if t is not None]
    return phones.where(reduce(operator.and_, tests)) if tests else phones


def db_search(phones: DataFrame, text: str) -> DataFrame:
    """Products whose brand, name or variant key holds the text, whatever the case; a blank text holds for all."""
    needle = text.strip().lower()
    return phones.where(reduce(operator.or_, [F.contains(F.lower(F.coalesce(c(n), F.lit(""))), F.lit(needle)) for n in ("brand", "name", "variant_key")]))


def brand_summaries(known: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, slug, phones): brands as a catalog gives them, with its own count where it has one, else the number of products."""
    counted = catalog.groupBy(F.lower("brand").alias("low")).agg(F.count("*").alias("n"))
    joined = known.withColumn("low", F.lower(F.coalesce("name", F.lit("")))).join(counted, "low", "left")
    return joined.select("name", "slug", F.coalesce("phone_count", "n", F.lit(0)).alias("phones"))
