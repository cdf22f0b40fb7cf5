"""Recommendation scores, ranking and reasons; all are column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.functions import vocabulary as V
from merchlake.functions.numbers import bucket, mean_present, positive, price_score

c = F.col


def with_features(phones: DataFrame) -> DataFrame:
    """Numbers from their columns, or else from the free texts: f_ram, f_storage, f_mah, f_watt, f_inches, f_hertz, f_mp, f_nits."""
    return phones.withColumns({
        "f_ram": F.coalesce(c("ram_gb"), T.ram_gb(c("name"))),
        "f_storage": c("storage_gb"),
        "f_mah": F.coalesce(c("battery_mah"), T.mah(c("battery_text"))),
        "f_watt": F.coalesce(c("charging_w"), T.watt(c("battery_text"))),
        "f_inches": F.coalesce(c("display_inches"), T.inches(c("display_text"))),
        "f_hertz": T.hertz(c("display_text")),
        "f_mp": T.megapixels(c("camera_text")),
        "f_nits": T.nits(c("display_text")),
    })


def tier(text: Column, tiers: list, lowest: Column) -> Column:
    """The first tier that names something in the text, else `lowest`."""
    return T.ladder([(T.has_any(text, words), value) for value, words in tiers], lowest)


def camera() -> Column:
    text = F.coalesce(c("camera_text"), F.lit(""))
    pixels = F.when(positive(c("f_mp")).isNotNull(), bucket(c("f_mp"), 12, 200)).when(text != "", F.lit(0.1))
    return mean_present(pixels, bucket(T.flag_count(text, V.CAMERA_FLAGS), 0, 6))


def gaming() -> Column:
    chip = T.lowered(c("processor_text"))
    soc = tier(chip, V.SOC_TIERS, F.when(chip != "", F.lit(0.3)).otherwise(F.lit(0.0)))
    return mean_present(soc, bucket(c("f_ram"), 4, 16), bucket(positive(c("f_hertz")), 60, 144), bucket(positive(c("f_inches")), 5.5, 6.9))


def battery() -> Column:
    return mean_present(bucket(c("f_mah"), 3000, 7000), bucket(c("f_watt"), 15, 120))


def display() -> Column:
    text = F.coalesce(c("display_text"), F.lit(""))
    panel = T.ladder([(text.rlike(r"(?i)\bLTPO\b"), 1.0), (text.rlike(r"(?i)\b(AM)?OLED\b"), 0.85), (text.rlike(r"(?i)\bHDR"), 0.6)], F.lit(None).cast("double"))
    return mean_present(bucket(c("f_inches"), 5.5, 7.0), bucket(c("f_hertz"), 60, 144), panel, bucket(positive(c("f_nits")), 400, 3000))


def charging() -> Column:
    return F.coalesce(bucket(c("f_watt"), 10, 150), F.lit(0.0))


def value() -> Column:
    return F.when(F.coalesce(c("price_min"), F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(0.5 * gaming() + 0.5 * price_score(c("price_min")))


def software() -> Column:
    text = T.lowered(c("os"), c("name"))
    base = T.ladder([(T.has_any(text, ["ios", "iphone", "pixel"]), 0.95), (T.has_any(text, ["oneui", "samsung", "oxygenos", "nothing"]), 0.85), (T.has_any(text, ["android"]), 0.70)], 0.5)
    return F.when(T.has_any(text, ["7 years", "5 years", "long support", "clean"]), F.least(base + 0.10, F.lit(1.0))).otherwise(base)


def foldable() -> Column:
    return T.has_any(T.lowered(c("name"), c("display_text"), c("category")), V.FOLD_WORDS).cast("double")


def compact() -> Column:
    size = c("f_inches")
    return T.ladder([(size.isNull(), 0.0), (size <= 6.1, 1.0), (size <= 6.3, 0.85), (size <= 6.5, 0.5)], 0.2)


def business() -> Column:
    return mean_present(bucket(positive(c("f_ram")), 6, 16), bucket(positive(c("f_storage")), 128, 512), software())


def student() -> Column:
    return 0.4 * value() + 0.3 * battery() + 0.3 * gaming()


def travel() -> Column:
    tough = T.has_any(T.lowered(c("body_text"), c("display_text")), ["ip68", "ip67", "gorilla", "waterproof", "rugged"])
    return F.least(0.5 * battery() + 0.3 * charging() + F.when(tough, 0.2).otherwise(0.0) + 0.2, F.lit(1.0))


def photography() -> Column:
    return F.least(camera() + bucket(T.flag_count(c("camera_text"), V.OPTICS_FLAGS), 0, 3) * 0.2, F.lit(1.0))


def durability() -> Column:
    text = T.lowered(c("body_text"), c("display_text"))
    base = T.ladder([(T.has_any(text, ["ip69"]), 1.0), (T.has_any(text, ["ip68"]), 0.9), (T.has_any(text, ["ip67"]), 0.75)], 0.3)
    hard = T.has_any(text, ["victus", "ceramic shield", "gorilla glass", "titanium", "armor"])
    return F.when(hard, F.least(base + 0.15, F.lit(1.0))).otherwise(base)


def _maker() -> tuple[Column, Column]:
    return T.lowered(c("brand")), T.lowered(c("name"))


def resale() -> Column:
    brand, name = _maker()
    top = (brand == "samsung") & T.has_any(name, ["s25", "s24", "s23", "ultra", "z fold", "z flip"])
    return T.ladder([((brand == "apple") | F.contains(name, F.lit("iphone")), 0.95), (top, 0.85), (brand.isin("samsung", "google", "oneplus"), 0.70), (brand.isin("xiaomi", "realme", "vivo", "oppo"), 0.55)], 0.40)


def ecosystem() -> Column:
    brand, name = _maker()
    return T.ladder([((brand == "apple") | F.contains(name, F.lit("iphone")), 1.0), (brand == "samsung", 0.85), (brand == "xiaomi", 0.75), (brand.isin("google", "oneplus"), 0.70)], 0.50)


def accessibility() -> Column:
    return mean_present(bucket(positive(c("f_inches")), 6, 7), bucket(positive(c("f_nits")), 600, 2500), battery())


def content_creator() -> Column:
    video = bucket(T.flag_count(c("camera_text"), V.VIDEO_FLAGS), 0, 4) * 0.3
    room = F.when(c("f_storage") >= 256, 0.1).otherwise(0.0)
    return F.least(camera() * 0.6 + video + room + 0.1, F.lit(1.0))


def ai_features() -> Column:
    text = T.lowered(c("processor_text"), c("os"), c("name"))
    return T.ladder([(T.has_any(text, V.FLAGSHIP_AI), 1.0), (T.has_any(text, V.FAST_NPU), 0.85), (T.has_any(text, V.MIDDLE_NPU), 0.65)], 0.3)


#: Scores by name; aliases share one.
SCORERS: dict[str, Callable[[], Column]] = {
    "camera": camera, "gaming": gaming, "battery": battery, "performance": gaming, "display": display, "charging": charging, "value": value, "budget": value,
    "software": software, "foldable": foldable, "compact": compact, "business": business, "student": student, "travel": travel, "photography": photography,
    "durability": durability, "resale": resale, "ecosystem": ecosystem, "accessibility": accessibility, "content_creator": content_creator, "ai_features": ai_features, "ai": ai_features,
}
#: Scores that a ranking always has.
BASE = ["camera", "gaming", "battery", "performance", "display", "charging", "value"]


def score(name: str) -> Column:
    """A score by name; an unknown name scores 0."""
    return SCORERS[name]() if name in SCORERS else F.lit(0.0)


def with_scores(phones: DataFrame, names: list[str]) -> DataFrame:
    """Columns s_<name> beside the features."""
    return with_features(phones).withColumns({f"s_{n}": score(n) for n in dict.fromkeys(names)})


def candidates(phones: DataFrame, brand: str | None = None, budget_min: float | None = None, budget_max: float | None = None, is_foldable: bool = False, is_5g: bool = False, most: int = 100) -> DataFrame:
    """The `most` cheapest products that meet the request; ranking sees no others."""
    df = phones.where(c("price_min") > 0)
    if brand:
        df = df.where(F.lower("brand") == brand.strip().lower())
    if budget_min is not None:
        df = df.where(c("price_min") >= budget_min)
    if budget_max is not None:
        df = df.where(c("price_min") <= budget_max)
    if is_foldable:
        df = df.where(T.has_any(T.lowered(c("category")), ["fold", "flip"]) | T.has_any(T.lowered(c("name")), ["fold", "flip"]))
    if is_5g:
        df = df.where(c("network").ilike("%5g%") | c("name").ilike("%5g%"))
    return df.orderBy(c("price_min").asc_nulls_last(), "id").limit(most)


def rank(candidates_df: DataFrame, priorities: list[str], top: int = 10) -> DataFrame:
    """The best `top` candidates with their scores, rank (from 1), confidence and unofficial price.

    With priorities the final score is 0.8 of their mean and 0.2 of the mean of all scores, else the mean of all.
    """
    names = list(dict.fromkeys([*BASE, *priorities]))
    df = with_scores(candidates_df, names)
    mean = lambda ns: reduce(lambda a, b: a + b, [c(f"s_{n}") for n in ns]) / len(ns)
    final = 0.8 * mean(priorities) + 0.2 * mean(names) if priorities else mean(names)
    df = df.withColumn("score", F.round(final, 9)).withColumn("confidence", F.bround(F.least(0.85 * c("score") + 0.15, F.lit(1.0)), 2))
    df = df.withColumn("unofficial_price", F.when(c("price_max") != c("price_min"), c("price_max")))
    order = Window.orderBy(F.desc("score"), F.coalesce(positive(c("price_min")), F.lit(999999.0)), "id")
    return df.orderBy(F.desc("score"), F.coalesce(positive(c("price_min")), F.lit(999999.0)), "id").limit(top).withColumn("rank", F.row_number().over(order))


def reason(priorities: list[str]) -> Column:
    """Why a ranked product is recommended, as one sentence."""
    said = lambda word, n: F.concat(F.lit(f"{word} {n} (score: "), F.format_string("%.2f", c(f"s_{n}")), F.lit(")"))
    strong = F.array_compact(F.array(*[F.when(c(f"s_{n}") >= 0.7, said("excellent", n)).when(c(f"s_{n}") >= 0.5, said("good", n)) for n in priorities])) if priorities else F.array().cast("array<string>")
    chip = F.trim(F.split(c("processor_text"), r"\(")[0])
    memory = F.when((positive(c("f_ram")).isNotNull()) & positive(c("storage_gb")).isNotNull(), F.concat(c("f_ram").cast("string"), F.lit("GB RAM / "), c("storage_gb").cast("string"), F.lit("GB Storage")))
    built = F.array_compact(F.array(memory, F.when(~F.contains(F.lower("processor_text"), F.lit("unknown")), chip), F.when(c("battery_mah") > 0, F.concat(c("battery_mah").cast("string"), F.lit("mAh battery")))))
    parts = F.array_compact(F.array(
        F.when(c("price_min") > 0, F.concat(F.lit("Priced at "), F.format_number(c("price_min"), 0), F.lit(" BDT"))),
        F.when(F.size(strong) > 0, F.concat(F.lit("delivers "), F.array_join(strong, " and "))),
        F.when(F.size(built) > 0, F.concat(F.lit("features "), F.array_join(built, ", "))),
    ))
    text = F.concat(F.array_join(parts, ", "), F.lit("."))
    return F.regexp_replace(F.regexp_replace(text, "^d", "D"), "^f", "F")


#: Sentences that speak for and against a product, by score.
FOR = [
    (["camera"], "High-resolution camera system with clear optics"),
    (["gaming", "performance"], "Strong processor performance suitable for heavy gaming and multitasking"),
    (["battery"], "Large battery endurance for all-day usage"),
    (["display"], "Vibrant high refresh rate display"),
    (["charging"], "Fast charging support"),
]
AGAINST = [
    ("charging", "Modest charging speed compared to competitors"),
    ("battery", "Smaller battery capacity requiring more frequent charges"),
    ("performance", "Entry-level processor suited mainly for casual tasks"),
]


def pros() -> Column:
    hit = F.array_compact(F.array(*[F.when(F.greatest(*[c(f"s_{n}") for n in ns], F.lit(0.0)) >= 0.7, F.lit(s)) for ns, s in FOR]))
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit("Balanced price-to-performance feature set")))


def cons() -> Column:
    hit = F.array_compact(F.array(*[F.when(c(f"s_{n}") < 0.5, F.lit(s)) for n, s in AGAINST]))
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit("Premium pricing relative to budget alternatives")))
