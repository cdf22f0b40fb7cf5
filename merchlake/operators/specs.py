"""Specifications: numbers from text, fields in long form, features that are there, are not, or are unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.sources.scratch import spread

c = F.col


def _check(text: Column, yes: list[str], no: list[str]) -> Column:
    """True, false or unknown; a positive word decides first."""
    return T.ladder([(T.has_any(text, yes), True)] + ([(T.has_any(text, no), False)] if no else []), F.lit(None).cast("boolean"))


def feature_checks() -> dict[str, Column]:
    net = T.lowered(c("network"))
    body = T.lowered(c("display_text"), c("camera_text"), c("battery_text"), c("network"))
    water = F.when(body.rlike(r"\bip68\b") | T.has_any(body, ["water resistant", "ipx"]), True).when(T.has_any(body, ["no ip", "no water resistance"]), False)
    return {
        "wireless_charging": _check(T.lowered(*[c(x) for x in ("battery_text", "display_text", "camera_text", "network", "os")]), ["wireless charging", "qi ", "qi-charging", "qi charging", "inductive charging"], ["no wireless", "not support wireless"]),
        "five_g": F.when(net != "", T.has_any(net, ["5g", "lte-a"])),
        "nfc": _check(T.lowered(*[c(x) for x in ("network", "camera_text", "battery_text", "display_text")]), ["nfc"], []),
        "water_resistance": water,
        "sd_card": _check(T.lowered(*[c(x) for x in ("display_text", "battery_text", "camera_text", "os")]), ["microsd", "memory card", "sd card"], ["no microsd", "no sd card"]),
    }


def numbers() -> dict[str, Column]:
    return {"mah": T.mah(c("battery_text")), "watt": T.watt(c("battery_text")), "ram": T.ram_gb(c("name")), "inches": T.inches(c("display_text")), "hertz": T.hertz(c("display_text")), "megapixels": T.megapixels(c("camera_text")), "nits": T.nits(c("display_text"))}


def fields_long(phones: DataFrame) -> DataFrame:
    """(id, field, value, source): each field from its column, or else from the text; unknown fields are left out."""
    pairs = [
        ("ram", c("ram_gb"), T.ram_gb(c("name")), " GB"),
        ("storage", c("storage_gb"), F.lit(None).cast("int"), " GB"),
        ("battery", c("battery_mah"), T.mah(c("battery_text")), " mAh"),
        ("charging", c("charging_w"), T.watt(c("battery_text")), " W"),
    ]
    rows = [F.struct(F.lit(n).alias("field"), F.concat(F.coalesce(col, text).cast("string"), F.lit(unit)).alias("value"), F.when(col.isNotNull(), "column").otherwise("text").alias("source")) for n, col, text, unit in pairs]
    rows += [F.struct(F.lit(n).alias("field"), T.blank_to_null(c(col)).alias("value"), F.lit("column").alias("source")) for n, col in (("os", "os"), ("network", "network"), ("processor", "processor_text"))]
    return phones.select("id", F.explode(F.array(*rows)).alias("r")).select("id", "r.*").where(c("value").isNotNull())


# Labels of the 13 fields in their order, what a field's display says, and what counts as a feature of a camera
LABELS = {
    "ram": "RAM", "storage": "Storage", "processor": "Processor", "battery": "Battery", "charging": "Charging", "wireless_charging": "Wireless charging", "display": "Display", "camera": "Camera",
    "os": "Operating System", "network": "Network", "nfc": "NFC", "water_resistance": "Water resistance", "sd_card": "microSD card",
}
CAMERA_WORDS = ["ois", "periscope", "telephoto", "sensor-shift", "raw", "dolby vision", "prores", "8k", "4k dolby vision"]
YES, NO, UNKNOWN, MISSING = "Yes — supported", "No — not supported", "Not specified", "not specified"


def described(phones: DataFrame) -> DataFrame:
    """(id, field, label, value, display, source, summary): all 13 fields of each product, known or not.

    Numbers are `parsed`, from their column or from text; where there is none the text's first sentence stands for them.
    Features are `checked`; what nothing tells is `unknown`. The patterns are the work here: few files are dealt to all cores.
    """
    phones = spread(phones)
    text = {n: T.blank_to_null(c(n)) for n in ("battery_text", "display_text", "camera_text", "processor_text", "os", "network")}
    sentence = {n: T.first_sentence(t) for n, t in text.items()}
    none = F.lit(None).cast("string")
    row = lambda key, value, display, source, summary=none: F.struct(F.lit(key).alias("field"), F.lit(LABELS[key]).alias("label"), value.cast("string").alias("value"), display.alias("display"), source.alias("source"), F.coalesce(summary, F.lit("")).alias("summary"))
    told = lambda known, other: F.when(known, "parsed").when(other.isNotNull(), "text").otherwise("unknown")

    def number(key: str, value: Column, unit: str, other: Column = none) -> Column:
        return row(key, value, F.coalesce(F.concat(value.cast("string"), F.lit(unit)), other, F.lit(MISSING)), told(value.isNotNull(), other))

    def listed(key: str, bits: list[Column], source_text: str) -> Column:
        known = F.array_compact(F.array(*bits))
        return row(key, none, F.when(F.size(known) > 0, F.array_join(known, ", ")).otherwise(F.coalesce(sentence[source_text], F.lit(MISSING))), told(F.size(known) > 0, text[source_text]), F.when(F.size(known) > 0, sentence[source_text]))

    def feature(key: str, flag: Column) -> Column:
        return row(key, flag, F.when(flag, YES).when(~flag, NO).otherwise(UNKNOWN), F.when(flag.isNotNull(), "checked").otherwise("unknown"))

    plain = lambda key, n: row(key, none, F.coalesce(sentence[n], F.lit(MISSING)), F.when(text[n].isNotNull(), "text").otherwise("unknown"))
    checks, low = feature_checks(), F.lower(F.coalesce(c("display_text"), F.lit("")))
    inches = F.coalesce(c("display_inches"), T.inches(c("display_text")))
    panel = F.when(F.contains(low, F.lit("amoled")), "AMOLED").when(F.contains(low, F.lit("oled")), "OLED").when(F.contains(low, F.lit("ips")), "IPS")
    words = F.size(F.filter(F.array(*[F.lit(w) for w in CAMERA_WORDS]), lambda w: F.contains(F.lower(F.coalesce(c("camera_text"), F.lit(""))), w)))
    five = checks["five_g"]
    said = F.concat(sentence["network"], F.when(five, " — 5G support ✓").when(~five, " — 5G support ✗").otherwise(""))
    rows = [
        number("ram", F.coalesce(c("ram_gb"), T.ram_gb(c("name"))), " GB"),
        number("storage", c("storage_gb"), " GB"),
        plain("processor", "processor_text"),
        number("battery", F.coalesce(c("battery_mah"), T.mah(c("battery_text"))), " mAh", sentence["battery_text"]),
        number("charging", F.coalesce(c("charging_w"), T.watt(c("battery_text"))), " W", sentence["battery_text"]),
        feature("wireless_charging", checks["wireless_charging"]),
        listed("display", [F.when(inches.isNotNull(), F.format_string('%.2f"', inches)), F.concat(T.hertz(c("display_text")).cast("string"), F.lit(" Hz")), F.concat(T.nits(c("display_text")).cast("string"), F.lit(" nits peak")), panel], "display_text"),
        listed("camera", [F.concat(T.megapixels(c("camera_text")).cast("string"), F.lit(" MP main")), F.when(words > 0, F.concat(words.cast("string"), F.lit(" pro features")))], "camera_text"),
        plain("os", "os"),
        row("network", F.when(text["network"].isNotNull(), five), F.coalesce(said, F.lit(MISSING)), F.when(text["network"].isNotNull(), "text+feature").otherwise("unknown")),
        *[feature(n, checks[n]) for n in ("nfc", "water_resistance", "sd_card")],
    ]
    return phones.select("id", F.explode(F.array(*rows)).alias("r")).select("id", "r.*")
