"""Head-to-head comparison: dimension scores in long form, winners, and who leads."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.functions import vocabulary as V
from merchlake.functions.numbers import bucket, mean_present, positive, price_score
from merchlake.operators.scoring import tier, with_features

c = F.col
#: Dimensions whose scores lie closer than this have no winner.
TIE = 0.02


def _chip() -> Column:
    return F.when(c("processor_text").isNull(), F.lit(0.3)).otherwise(tier(F.lower("processor_text"), V.CPU_TIERS, F.lit(0.5)))


def _display() -> Column:
    text = F.coalesce(c("display_text"), F.lit(""))
    panel = T.ladder([(text.rlike(r"\bLTPO\b"), 1.0), (text.rlike(r"\b(AM)?OLED\b"), 0.85), (text.rlike(r"\bHDR"), 0.5)], F.lit(None).cast("double"))
    return mean_present(bucket(c("f_inches"), 5.5, 7.0), bucket(c("f_hertz"), 60, 144), panel, bucket(positive(c("f_nits")), 400, 3000))


def _pictures(flags: list[str], most: int) -> Column:
    return mean_present(bucket(positive(c("f_mp")), 12, 200), bucket(positive(T.flag_count(c("camera_text"), flags)), 0, most))


def _software() -> Column:
    text = T.lowered(c("os"), c("brand"))
    kinds = [(["ios", "iphone"], 0.9), (["android"], 0.6), (["stock", "pixel"], 0.85), (["one ui", "oxygen", "coloros", "origin"], 0.75)]
    return reduce(F.greatest, [F.when(T.has_any(text, words), value).otherwise(0.5) for words, value in kinds])


def _ai() -> Column:
    text = T.lowered(c("processor_text"), c("os"), c("name"))
    return T.ladder([(T.has_any(text, V.FLAGSHIP_AI), 1.0), (T.has_any(text, V.COMPARE_FAST_NPU), 0.85), (T.has_any(text, V.MIDDLE_NPU), 0.65)], 0.3)


def _value() -> Column:
    able = mean_present(_chip(), bucket(c("f_ram"), 4, 16), bucket(c("f_storage"), 64, 1024), bucket(c("f_mah"), 3000, 7000))
    return F.when(F.coalesce(c("price_min"), F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(0.55 * able + 0.45 * price_score(c("price_min")))


#: Dimensions in the order in which they are shown.
DIMENSIONS: dict[str, Callable[[], Column]] = {
    "Display": _display,
    "Processor": _chip,
    "Camera": lambda: _pictures(V.COMPARE_CAMERA_FLAGS, 5),
    "Battery": lambda: F.coalesce(bucket(c("f_mah"), 3000, 7000), F.lit(0.0)),
    "Charging": lambda: F.coalesce(bucket(c("f_watt"), 10, 150), F.lit(0.0)),
    "Software": _software,
    "AI Features": _ai,
    "Gaming": lambda: mean_present(_chip(), bucket(c("f_ram"), 4, 16), bucket(c("f_hertz"), 60, 144)),
    "Photography": lambda: _pictures(V.COMPARE_PHOTO_FLAGS, 6),
    "Value": _value,
}


def dimensions(phones: DataFrame, aspect: str | None = None) -> DataFrame:
    """(id, name, price_min, dimension, ord, score), a row for each product and dimension of the aspect (all without one)."""
    names = V.ASPECTS.get((aspect or "").lower(), list(DIMENSIONS))
    scored = [F.struct(F.lit(n).alias("dimension"), F.lit(list(DIMENSIONS).index(n)).alias("ord"), DIMENSIONS[n]().alias("score")) for n in names]
    return with_features(phones).select("id", "name", "price_min", F.explode(F.array(*scored)).alias("d")).select("id", "name", "price_min", "d.*")


def winners(long: DataFrame) -> DataFrame:
    """(dimension, winner_id, is_tie, spread): the best product, none where all lie within TIE."""
    best = long.groupBy("dimension").agg(F.max("score").alias("hi"), F.min("score").alias("lo"), F.max_by("id", F.struct("score", -F.col("id"))).alias("best"))
    spread = F.col("hi") - F.col("lo")
    return best.select("dimension", F.when(spread >= TIE, F.col("best")).alias("winner_id"), (spread < TIE).alias("is_tie"), F.round(spread, 9).alias("spread"))


def leader(long: DataFrame) -> DataFrame:
    """(id, name, wins, ties, leads): most wins lead, then the cheapest."""
    counted = long.join(F.broadcast(winners(long)), "dimension").groupBy("id", "name", "price_min").agg(F.count_if(F.col("winner_id") == F.col("id")).alias("wins"), F.count_if("is_tie").alias("ties"))
    order = Window.orderBy(F.desc("wins"), F.col("price_min").asc_nulls_last(), "id")
    return counted.select("id", "name", "wins", "ties", (F.row_number().over(order) == 1).alias("leads"))
