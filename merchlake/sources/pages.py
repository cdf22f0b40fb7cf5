"""Catalog and store pages as rows: brands, models, devices, meta data, tables. Patterns and columns only, no Python on the executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.functions import text as T

c = F.col
# Patterns of markup; the groups are what is taken
ANCHOR = r'(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>'
SPAN = r"(?is)<span\b[^>]*>(.*?)</span>"
TITLE = r'(?is)<img\b[^>]*\btitle="([^"]*)"'
SOURCE = r'(?is)<img\b[^>]*\bsrc="([^"]*)"'
TABLE = r"(?is)<table\b.*?</table>"
ROW = r"(?is)<tr\b.*?</tr>"
CELL = r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"
HEAD = r"(?is)<th\b[^>]*>(.*?)</th>"
LABEL = r'(?is)<td\b[^>]*class="ttl"[^>]*>(.*?)</td>'
VALUE = r'(?is)<td\b[^>]*class="nfo"[^>]*>(.*?)</td>'
META = r'(?is)<meta\b[^>]*\b(?:property|name)="([^"]*)"[^>]*\bcontent="([^"]*)"'
NEXT = r'(?is)<a\b[^>]*title="Next page"[^>]*\bhref="([^"]*)"'
MODEL_NAME = r'(?is)<h1\b[^>]*data-spec="modelname"[^>]*>(.*?)</h1>'
QUICK = r'(?is)data-spec="([a-z]+)-hl"[^>]*>(.*?)<'
# Kinds of devices by words of a summary, in order
DEVICE_TYPES = [("watch", r"\bsmartwatch\b|\bwatch\b"), ("tablet", r"\btablet\b"), ("band", r"\bsmartband\b|\bfitness band\b|\bband\b"), ("phone", r"\bsmartphone\b|\bphone\b")]
# Brands by words of a product's name, in order
BRAND_WORDS = [
    ("Apple", r"\biphone\b"), ("Samsung", r"\bsamsung\b|\bgalaxy\b"), ("Xiaomi", r"\bredmi\b|\bpoco\b|\bxiaomi\b"), ("Realme", r"\brealme\b"), ("OnePlus", r"\boneplus\b"), ("iQOO", r"\biqoo\b"), ("Vivo", r"\bvivo\b"), ("Oppo", r"\boppo\b"),
    ("Google", r"\bpixel\b|\bgoogle\b"), ("Honor", r"\bhonor\b"), ("Huawei", r"\bhuawei\b"), ("Motorola", r"\bmotorola\b|\bmoto\b"), ("Nokia", r"\bnokia\b"), ("Nothing", r"\bnothing\b"), ("Infinix", r"\binfinix\b"), ("Tecno", r"\btecno\b"), ("Itel", r"\bitel\b"),
    ("Symphony", r"\bsymphony\b"), ("Walton", r"\bwalton\b"), ("Asus", r"\basus\b|\brog\s*phone\b"), ("ZTE", r"\bzte\b|\bnubia\b"),
]


def shown(fragment: Column) -> Column:
    """The text of a piece of markup."""
    return T.squeeze(F.replace(F.regexp_replace(fragment, "<[^>]*>", ""), F.lit("&amp;"), F.lit("&")))


def absolute(href: Column, base: str) -> Column:
    """A link in full: as it is if it has a scheme, else behind the base (or its host, for paths)."""
    host = "/".join(base.split("/")[:3])
    return F.when(href.rlike(r"^[a-z]+://"), href).when(F.startswith(href, F.lit("/")), F.concat(F.lit(host), href)).when(href != "", F.concat(F.lit(base.rstrip("/") + "/"), href))


def id_of(href: Column) -> Column:
    """The number before .php."""
    return T.first_match(href, r"-(\d+)\.php").cast("long")


def first_int(text: Column) -> Column:
    return T.first_match(text, r"(\d+)").cast("long")


def release_year(text: Column) -> Column:
    return T.first_match(text, r"((?:19|20)\d{2})").cast("int")


def hits(text: Column) -> Column:
    return F.nullif(F.replace(T.first_match(text, r"(?i)([\d,]+)\s*hits"), F.lit(","), F.lit("")).cast("long"), F.lit(0))


def device_type(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return T.ladder([(low.rlike(p), kind) for kind, p in DEVICE_TYPES], "other")


def _anchors(pages: DataFrame) -> DataFrame:
    every = lambda g: F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(g))
    return pages.select("page_id", F.posexplode(F.arrays_zip(every(1).alias("href"), every(2).alias("inner"))).alias("pos", "a")).select("page_id", "pos", "a.*")


def brands(pages: DataFrame, base: str) -> DataFrame:
    """(page_id, brand_id, name, slug, url, devices): each brand of a list page once, with its count of devices if any link has it."""
    a = _anchors(pages).where(c("href").rlike(r"-phones-\d+\.php$"))
    count = F.nullif(F.replace(T.first_match(shown(T.first_match(c("inner"), SPAN)), r"([\d,]+)"), F.lit(","), F.lit("")).cast("long"), F.lit(0))
    name = shown(F.regexp_replace("inner", SPAN, ""))
    rows = a.select("page_id", "pos", id_of(c("href")).alias("brand_id"), name.alias("name"), F.regexp_replace("href", r"\.php$", "").alias("slug"), absolute(c("href"), base).alias("url"), count.alias("devices")).where("name != ''")
    best = F.min_by(F.struct("name", "slug", "url", "devices"), F.struct(c("devices").isNull(), "pos"))
    return rows.groupBy("page_id", "brand_id").agg(best.alias("b")).select("page_id", "brand_id", "b.*")


def models(pages: DataFrame, base: str, phones_only: bool = True) -> DataFrame:
    """(page_id, model_id, name, slug, url, thumb, summary, device_type) of a brand's list page."""
    a = _anchors(pages).where(c("href").rlike(r"-\d+\.php$") & F.contains("inner", F.lit("<img")))
    title = F.coalesce(T.first_match(c("inner"), TITLE), F.lit(""))
    name = F.coalesce(T.blank_to_null(shown(T.first_match(c("inner"), SPAN))), shown(c("inner")))
    out = a.select("page_id", id_of(c("href")).alias("model_id"), name.alias("name"), F.regexp_replace("href", r"\.php$", "").alias("slug"), absolute(c("href"), base).alias("url"), T.first_match(c("inner"), SOURCE).alias("thumb"), T.squeeze(title).alias("summary"), device_type(title).alias("device_type"))
    return out.where("device_type = 'phone'") if phones_only else out


def next_page(pages: DataFrame, base: str) -> DataFrame:
    return pages.select("page_id", absolute(T.first_match(c("html"), NEXT), base).alias("next_url"))


def followed(pages: DataFrame, first: DataFrame, base: str) -> DataFrame:
    """(first_url, step, url): the pages that one comes to from each first one (url) by next-page links, itself at step 0.

    `pages` has url and html. A chain ends with a page without such a link, with a link to a page that is not stored, or
    before a page that it has been to.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # else a million rows end it with an error
    names = {n: f"{n}_{uuid.uuid4().hex}" for n in ("links", "firsts")}
    pages.select("url", absolute(T.first_match(c("html"), NEXT), base).alias("next_url")).createOrReplaceTempView(names["links"])
    first.select("url").distinct().createOrReplaceTempView(names["firsts"])
    try:
        return spark.sql(f"""
            WITH RECURSIVE walk(first_url, step, url, next_url, been) MAX RECURSION LEVEL 10000 AS (
              SELECT l.url, 0, l.url, l.next_url, array(l.url) FROM {names['firsts']} f JOIN {names['links']} l ON l.url = f.url
              UNION ALL
              SELECT w.first_url, w.step + 1, l.url, l.next_url, array_append(w.been, l.url) FROM walk w JOIN {names['links']} l ON l.url = w.next_url WHERE NOT array_contains(w.been, l.url)
            )
            SELECT first_url, step, url FROM walk
        """)
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def spec_rows(pages: DataFrame) -> DataFrame:
    """(page_id, section, key, value) of a device page's tables.

    A table's first head cell is its section. Values of a repeated key are joined; a row without a key goes on with the
    key before it in its table, or is kept under _ if there is none.
    """
    t = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TABLE), F.lit(0))).alias("nth", "t")).withColumn("section", shown(T.first_match(c("t"), HEAD))).where("section != ''")
    r = t.select("page_id", "nth", "section", F.posexplode(F.regexp_extract_all("t", F.lit(ROW), F.lit(0))).alias("pos", "r"))
    r = r.withColumns({"label": T.blank_to_null(shown(T.first_match(c("r"), LABEL))), "value": T.blank_to_null(shown(T.first_match(c("r"), VALUE)))}).where("value is not null")
    before = Window.partitionBy("page_id", "nth").orderBy("pos")
    r = r.withColumn("key", F.coalesce(F.last("label", ignorenulls=True).over(before), F.lit("_")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "pos", "value"))), lambda x: x["value"]), " ")
    return r.groupBy("page_id", "section", "key").agg(joined.alias("value"), F.min(F.struct("nth", "pos")).alias("first"))


def quick_specs(html: Column) -> Column:
    """The highlights of a device page as a map."""
    every = lambda g: F.regexp_extract_all(html, F.lit(QUICK), F.lit(g))
    pairs = F.filter(F.transform(F.arrays_zip(every(1).alias("k"), every(2).alias("v")), lambda p: F.struct(p["k"].alias("k"), shown(p["v"]).alias("v"))), lambda p: p["v"] != "")
    return _first_pairs(pairs)


def _first_pairs(pairs: Column) -> Column:
    """A map from pairs (k, v), of which the first of each key stays."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(pairs, lambda p: p["k"] == k), 0)["v"]))


def _last_pairs(pairs: Column) -> Column:
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def devices(pages: DataFrame) -> DataFrame:
    """(page_id, model_name, brand, image_url, release_year, popularity, and the key specifications) of device pages; other pages have no row."""
    html = c("html")
    d = pages.select("page_id", shown(T.first_match(html, MODEL_NAME)).alias("model_name"), quick_specs(html).alias("q"), meta(html)["og:image"].alias("og"), hits(F.regexp_replace(html, "<[^>]*>", " ")).alias("popularity")).where("model_name != ''")
    of = lambda section, key=None: F.min_by("value", "first") if key is None else F.max(F.when((c("section") == section) & (c("key") == key), c("value")))
    wanted = {"s_internal": ("Memory", "Internal"), "s_chipset": ("Platform", "Chipset"), "s_battery": ("Battery", "Type"), "s_size": ("Display", "Size"), "s_os": ("Platform", "OS"), "s_net": ("Network", "Technology"), "s_announced": ("Launch", "Announced"), "s_status": ("Launch", "Status")}
    camera = F.min_by(F.when(c("section") == "Main Camera", c("value")), F.when(c("section") == "Main Camera", c("first")))
    s = spec_rows(pages).groupBy("page_id").agg(*[of(*sk).alias(n) for n, sk in wanted.items()], camera.alias("s_camera"))
    q, unit = lambda k: F.element_at("q", F.lit(k)), lambda k, u: F.concat(F.element_at("q", F.lit(k)), F.lit(u))
    d = d.join(s, "page_id", "left")
    return d.select(
        "page_id", "model_name", F.split("model_name", " ")[0].alias("brand"), c("og").alias("image_url"), release_year(F.coalesce(q("released"), "s_announced", "s_status")).alias("release_year"), "popularity",
        unit("ramsize", " GB").alias("ram"), F.coalesce(q("storage"), "s_internal").alias("storage"), F.coalesce(q("chipset"), "s_chipset").alias("chipset"), F.coalesce(unit("batsize", " mAh"), "s_battery").alias("battery"),
        F.coalesce("s_size", q("displaysize")).alias("display"), F.coalesce("s_camera", unit("camerapixels", " MP")).alias("camera"), F.coalesce(q("os"), "s_os").alias("os"), c("s_net").alias("network"),
    )


def pictures(html: Column) -> Column:
    """The sources of all pictures, each once, in their order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(SOURCE), F.lit(1)))


def meta(html: Column) -> Column:
    """The meta data of a page as a map; the last of a repeated name stays, and empty ones are left out."""
    every = lambda g: F.regexp_extract_all(html, F.lit(META), F.lit(g))
    return _last_pairs(F.filter(F.arrays_zip(every(1).alias("k"), every(2).alias("v")), lambda p: (p["k"] != "") & (p["v"] != "")))


def first_table(body: Column) -> Column:
    """A struct of specs (a map from the first table's rows of two cells or more; the last of a key stays) and description (the rest as text)."""
    table = F.regexp_extract(body, TABLE, 0)
    rows = F.transform(F.regexp_extract_all(table, F.lit(ROW), F.lit(0)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), shown))
    pairs = F.transform(F.filter(rows, lambda r: (F.size(r) >= 2) & (F.get(r, 0) != "") & (F.get(r, 1) != "")), lambda r: F.struct(F.regexp_replace(F.get(r, 0), ":$", "").alias("k"), F.get(r, 1).alias("v")))
    return F.struct(_last_pairs(pairs).alias("specs"), T.strip_html(F.replace(body, F.when(table != "", table).otherwise(F.lit("\u0000")), F.lit(" "))).alias("description"))


def key_rows(rows: Column, junk: list[str], longest: int = 80) -> Column:
    """A map from rows (key, value, is_title): section titles, junk and overlong keys are left out, colons at the end go, the first value of a key stays."""
    pairs = F.transform(F.filter(rows, lambda r: ~F.coalesce(r["is_title"], F.lit(False))), lambda r: F.struct(F.regexp_replace(T.squeeze(r["key"]), r"\s*:\s*$", "").alias("k"), T.squeeze(r["value"]).alias("v")))
    return _first_pairs(F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "") & (F.length(p["k"]) <= longest) & ~F.lower(p["k"]).isin(*junk)))


def api_specs(rows: Column) -> Column:
    """A map from rows (key, value, is_title) of which the last value of a key stays; section titles are left out."""
    pairs = F.transform(F.filter(rows, lambda r: ~F.coalesce(r["is_title"], F.lit(False))), lambda r: F.struct(T.squeeze(r["key"]).alias("k"), T.squeeze(r["value"]).alias("v")))
    return _last_pairs(F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "")))


def sku_price(sku_price_: Column, sku_discounted: Column, price: Column, discounted: Column) -> Column:
    """The primary variant's price, or the listing's: reduced if that is above 0, with the full price beside it if higher."""
    full = F.coalesce(sku_price_, price)
    less = F.coalesce(sku_discounted, discounted)
    sell = F.when(less > 0, less).otherwise(full)
    return F.struct(sell.alias("price"), F.when(full > sell, full).alias("original_price"))


def chosen_price(regular: Column, discounted: Column, meta_price: Column) -> Column:
    """A reduced price below the regular one, with that beside it; else the first of regular, reduced and meta price above 0."""
    reduced = F.coalesce((discounted > 0) & (discounted < regular), F.lit(False))
    some = lambda x: F.when(x != 0, x)
    return F.struct(F.when(reduced, discounted).otherwise(F.coalesce(some(regular), some(discounted), some(meta_price))).alias("price"), F.when(reduced, regular).alias("original_price"))


def in_stock(stock_text: Column, body_class: Column, default: bool = False) -> Column:
    """Whether a page says that a product is there: its stock text, else the class of its body, else the store's default."""
    text, cls = F.lower(T.blank_to_null(stock_text)), F.lower(F.coalesce(body_class, F.lit("")))
    said = F.when(F.contains(text, F.lit("out of stock")), False).when(F.contains(text, F.lit("in stock")), True).otherwise(False)
    return F.when(text.isNotNull(), said).when(F.contains(cls, F.lit("instock")), True).when(F.contains(cls, F.lit("outofstock")), False).otherwise(default)


def inferred_brand(name: Column, vendor: Column | None = None, not_vendors: list[str] | None = None) -> Column:
    """The brand of a product: its vendor unless that is a shop's, the first word list that matches, its first word, capitalised."""
    words = T.squeeze(F.coalesce(name, F.lit("")))
    first = F.split(words, " ")[0]
    guess = T.ladder([(words.rlike(f"(?i){p}"), b) for b, p in BRAND_WORDS], F.when(first != "", F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 255))))
    if vendor is None:
        return guess
    v = T.blank_to_null(T.squeeze(vendor))
    return F.when(v.isNotNull() & ~F.lower(v).isin(*(not_vendors or [""])), v).otherwise(guess)


def category(og_type: Column, crumbs: Column) -> Column:
    """The kind of product: the first label of og:type if it is about phones, else the last crumb unless that is home."""
    label = F.trim(F.split(F.coalesce(og_type, F.lit("")), ",")[0])
    leaf = F.try_element_at(F.filter(crumbs, lambda x: F.trim(x) != ""), F.lit(-1))
    return F.when(label.rlike("(?i)mobile|phone"), label).when(~leaf.rlike("(?i)home"), leaf)


def in_table(specs: Column, words: list[str]) -> Column:
    """The value of the first key, in the map's order, that holds a word; words are tried in turn."""
    entries = F.map_entries(specs)
    holding = lambda word: F.filter(entries, lambda e: F.contains(F.lower(e["key"]), F.lit(word)))
    return F.coalesce(*[F.trim(F.get(holding(w.lower()), 0)["value"]) for w in words])


def in_prose(text: Column, patterns: list[str]) -> Column:
    """What the first pattern that matches finds: its group if it has one, else all of it."""
    return F.coalesce(*[F.trim(T.first_match(text, p, 1 if "(" in p.replace("(?:", "").replace("(?i)", "").replace("(?=", "") else 0)) for p in patterns])


def localized(value: Column) -> Column:
    """A text that may be given by language: itself, or what `en` says, or the first language."""
    by = F.try_variant_get(F.try_parse_json(value), "$", "map<string,string>")
    return F.coalesce(F.element_at(by, "en"), F.get(F.map_values(by), 0), F.try_variant_get(F.try_parse_json(value), "$", "string"), value)


# Where the eight key specifications are looked for: keys of the table, then patterns of the prose
KEY_SPECS = {
    "chipset": (["Chipset", "Processor", "CPU", "SoC"], [r"(?i)(exynos[\s\d]+)", r"(?i)(dimensity[\s\d]+)", r"(?i)(helio[\s\w]+)", r"(?i)(a\d+\s*bionic)"]),
    "battery": (["Battery", "Battery Capacity"], [r"(?i)(\d{3,5}\s*mah)", r"(?i)battery[:\s]+(\d{3,5}\s*mah)"]),
    "display": (["Display", "Screen Size", "Screen", "Size"], [r"(?i)(\d+\.\d+[\"'″]\s*[\w\s+]*?(?:amoled|lcd|oled|ips|tft))"]),
    "camera": (["Main Camera", "Rear Camera", "Camera"], [r"(?i)(?:rear|main|triple|quad|dual)\s*camera[^.]*?(\d+mp[\w\s+]*)", r"(?i)(\d+mp\s*\+\s*\d+mp(?:\s*\+\s*\d+mp)*)", r"(?i)(\d+\s*mp\s*(?:main|wide|primary))"]),
    "os": (["OS", "Operating System"], [r"(?i)(android\s*\d+(?:\.\d+)?)", r"(?i)(ios\s*\d+(?:\.\d+)?)", r"(?i)(one\s*ui\s*\d+(?:\.\d+)?)"]),
    "network": (["Network", "Connectivity", "Technology"], [r"(?i)\b(5g)\b", r"(?i)\b(4g\s*lte)\b", r"(?i)\b(4g)\b", r"(?i)\b(3g)\b", r"(?i)\b(2g)\b"]),
}
RAM_PROSE = [r"(?i)(\d+)\s*gb\s*(?:of\s*)?ram", r"(?i)ram[:\s]+(\d+)\s*gb", r"(?i)(\d+)\s*gb\s*lpddr"]
STORAGE_PROSE = [r"(?i)(\d+)\s*gb\s*(?:internal\s*)?storage", r"(?i)storage[:\s]+(\d+)\s*gb", r"(?i)(\d+)\s*gb\s*(?:internal|flash|emmc|ufs|rom)"]


def key_specs(specs: Column, name: Column, description: Column) -> dict[str, Column]:
    """Eight specifications of a product from its table, from all values of the table, and from name and description."""
    prose = F.lower(F.concat_ws(" ", description, name))
    blob = F.concat_ws("  ||  ", F.array_join(F.map_values(specs), "  ||  "), prose)
    out = {"ram": F.coalesce(first_int(in_prose(blob, RAM_PROSE)), first_int(in_table(specs, ["RAM"]))), "storage": F.coalesce(first_int(in_table(specs, ["Storage", "Internal Storage", "ROM"])), first_int(in_prose(blob, STORAGE_PROSE)))}
    out |= {n: F.coalesce(T.blank_to_null(in_table(specs, words)), in_prose(prose, patterns)) for n, (words, patterns) in KEY_SPECS.items()}
    return out | {"network": F.upper(out["network"])}
