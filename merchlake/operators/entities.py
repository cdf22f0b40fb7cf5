"""Entity resolution: product keys, merged specifications, staged name resolution, snapshots and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.functions.vocabulary import SPEC_NAMES

c = F.col
# What is taken out of a product name, in this order
NAME_NOISE = [
    r"\b\d+\s*(?:gb|mb)\s*[/+]\s*\d+\s*(?:gb|mb)\b", r"\b\d+\s*[/+]\s*\d+\s*(?:gb|mb)\b", r"\b\d+\s*(?:gb|mb)\b", r"\b\d+\s*[/+]\s*\d+\b", r"\b[2345]g\b|\blte\b",
    r"[\(\[\{].*?[\)\]\}]", r"\bwith\s+.*$", r"\bclaim\s+support\b", r"\bwaranty\b|\bwarranty\b", r"\|.*$", r"[^a-z0-9\s]",
]


def clean_name(brand: Column, name: Column) -> Column:
    """A product's name without brand, memory, network, brackets and warranty."""
    b, n = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (brand, name))
    n = F.when((b != "") & F.startswith(n, b), F.trim(F.substring(n, F.length(b) + 1, F.length(n)))).otherwise(n)
    for noise in NAME_NOISE:
        n = F.regexp_replace(n, noise, "")
    return T.squeeze(n)


def product_key(brand: Column, name: Column) -> Column:
    return F.concat(F.lower(F.trim(F.coalesce(brand, F.lit("")))), F.lit("|"), clean_name(brand, name))


def source_of_file(name: Column) -> Column:
    """The store that a scrape file's name tells: what stands before the date, capitalised."""
    dated = T.first_match(name, r"^(.+?)-\d{4}-\d{2}-\d{2}T")
    plain = F.regexp_replace(F.replace(name, F.lit(".json"), F.lit("")), r"-\d{4}-\d{2}-\d{2}.*$", "")
    return F.regexp_replace(F.initcap(F.replace(F.coalesce(dated, plain), F.lit("-"), F.lit(" "))), r"\bBd\b", "BD")


def spec_name(raw: Column) -> Column:
    """The standard name of a specification: exact variants first, then cameras, then any variant inside it."""
    name = F.trim(F.regexp_replace(F.lower(F.trim(raw)), r"[\s_-]+", " "))
    steps = [(name.isin(*variants), norm) for norm, variants in SPEC_NAMES.items()]
    steps += [(T.has_any(name, ["front", "selfie"]), "front_camera"), (T.has_any(name, ["rear", "main", "primary", "back"]), "rear_camera")]
    for norm, variants in SPEC_NAMES.items():
        inside = T.has_any(name, variants)
        if norm == "ram":
            steps.append((inside & T.has_any(name, ["storage", "rom", "internal", "capacity"]), "storage"))
        steps.append((inside, norm))
    return T.ladder(steps, F.replace(name, F.lit(" "), F.lit("_")))


def base_record(rows: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """Of each key, the fullest row (the first on ties) and how many there are."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[n for n in rows.columns if n != key]), F.struct(c(score), -c(order))).alias("base"), F.count("*").alias("members"))
    return best.select(key, "base.*", "members")


def longest_values(entries: DataFrame, key: str, name: str, value: str, order: str) -> DataFrame:
    """Of each key and name, the longest value; the first on ties."""
    return entries.where(F.trim(c(value)) != "").groupBy(key, name).agg(F.max_by(value, F.struct(F.length(value), -c(order))).alias(value))


def as_map(entries: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """One map a key from rows of names and values."""
    return entries.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("specs"))


#: Requests that may be broadcast to a catalog, at most; more are joined in the same way without the hint.
BROADCAST_NAMES = 10_000
def content_hash(*columns: str) -> Column:
    """A hash of a row's stable columns: sorted by name, nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def diff(old: DataFrame, new: DataFrame, key: str, hashes: list[str]) -> DataFrame:
    """(key, status) of two snapshots: added, removed, updated if any hash differs, else unchanged."""
    o = old.select(c(key).alias("ok"), *[c(h).alias(f"o_{h}") for h in hashes])
    n = new.select(c(key).alias("nk"), *[c(h).alias(f"n_{h}") for h in hashes])
    same = F.lit(True)
    for h in hashes:
        same = same & c(f"o_{h}").eqNullSafe(c(f"n_{h}"))
    status = F.when(c("ok").isNull(), "added").when(c("nk").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    return o.join(n, c("ok") == c("nk"), "full_outer").select(F.coalesce("ok", "nk").alias(key), status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows with those of `new` in place of, or beside, them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
