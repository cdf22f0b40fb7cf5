"""Queries on scores, ranking and comparison, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.functions import vocabulary as V
from merchlake.operators import comparison, scoring
from merchlake.sources.catalog import PHONES_SQL, phones


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


def _has(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _low(*columns: str) -> str:
    return "lower(" + " || ' ' || ".join(f"coalesce({x}, '')" for x in columns) + ")"


def _flags(text: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches(coalesce({text}, ''), '(?i){_re(p)}')::INT" for p in patterns) + ")"


def _bucket(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x}::DOUBLE - {low}::DOUBLE) / {float(high - low)}::DOUBLE)) END)"


def _mean(*parts: str) -> str:
    total = " + ".join(f"coalesce({p}, 0.0::DOUBLE)" for p in parts)
    count = " + ".join(f"({p} IS NOT NULL)::INT" for p in parts)
    return f"(CASE WHEN {count} > 0 THEN ({total}) / ({count}) ELSE 0.0::DOUBLE END)"


def _ladder(steps: list[tuple[str, float]], otherwise: str) -> str:
    return "(CASE " + " ".join(f"WHEN {cond} THEN {v}::DOUBLE" for cond, v in steps) + f" ELSE {otherwise} END)"


def _first(x: str, pattern: str) -> str:
    return f"nullif(regexp_extract({x}, '{_re(pattern)}', 1), '')"


def _most(x: str, pattern: str) -> str:
    return f"list_max(list_transform(regexp_extract_all({x}, '{_re(pattern)}', 1), lambda n: n::INT))"


FEATURES_SQL = f"""phones AS ({PHONES_SQL}), feats AS (
  SELECT *, coalesce(ram_gb, {_first('name', '(?i)([0-9]{1,3})[ ]*GB(?:[ ]+RAM|[ ]*RAM|[ ]+LPDDR)')}::INT, {_first('name', '(?i)(?:^|[^0-9A-Za-z_])([0-9]{1,2})[ ]*GB(?:[^0-9A-Za-z_]|$)')}::INT) AS f_ram,
    storage_gb AS f_storage, coalesce(battery_mah, {_first('battery_text', '(?i)([0-9]{2,5})[ ]*mAh')}::INT) AS f_mah,
    coalesce(charging_w, floor({_first('battery_text', '(?i)([0-9]{1,3}(?:[.][0-9]+)?)[ ]*W(?:[^0-9A-Za-z_]|$)')}::DOUBLE)::INT) AS f_watt,
    coalesce(display_inches, {_first('display_text', '(?i)([0-9][.][0-9]{1,2})[ ]*-?[ ]*inch')}::DOUBLE) AS f_inches,
    {_first('display_text', '(?i)([0-9]{2,3})[ ]*Hz')}::INT AS f_hertz, {_most('camera_text', '(?i)([0-9]{1,3})[ ]*MP')} AS f_mp, {_most('display_text', '(?i)([0-9]{3,5})[ ]*nits')} AS f_nits
  FROM phones
)"""
_CHIP, _SOFT = _low("processor_text"), _low("os", "name")
_TOUGH = _low("body_text", "display_text")
_BRAND, _NAME = _low("brand"), _low("name")
_AI = _low("processor_text", "os", "name")
_S: dict[str, str] = {}
_S["camera"] = _mean(f"(CASE WHEN nullif(f_mp, 0) IS NOT NULL THEN {_bucket('f_mp', 12, 200)} WHEN coalesce(camera_text, '') <> '' THEN 0.1::DOUBLE END)", _bucket(_flags("camera_text", V.CAMERA_FLAGS), 0, 6))
_S["gaming"] = _mean(_ladder([(_has(_CHIP, w), v) for v, w in V.SOC_TIERS] + [(f"{_CHIP} <> ''", 0.3)], "0.0::DOUBLE"), _bucket("f_ram", 4, 16), _bucket("nullif(f_hertz, 0)", 60, 144), _bucket("nullif(f_inches, 0)", 5.5, 6.9))
_S["battery"] = _mean(_bucket("f_mah", 3000, 7000), _bucket("f_watt", 15, 120))
_S["performance"] = _S["gaming"]
_S["display"] = _mean(_bucket("f_inches", 5.5, 7.0), _bucket("f_hertz", 60, 144), r"(CASE WHEN regexp_matches(display_text, '(?i)\bLTPO\b') THEN 1.0::DOUBLE WHEN regexp_matches(display_text, '(?i)\b(AMOLED|OLED)\b') THEN 0.85::DOUBLE WHEN regexp_matches(display_text, '(?i)\bHDR') THEN 0.6::DOUBLE END)", _bucket("nullif(f_nits, 0)", 400, 3000))
_S["charging"] = f"coalesce({_bucket('f_watt', 10, 150)}, 0.0::DOUBLE)"
_PRICE = f"(1.0::DOUBLE - {_bucket('log10(greatest(price_min, 1000.0::DOUBLE))', 3.5, 5.5)})"
_S["value"] = f"(CASE WHEN coalesce(price_min, 0) <= 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * {_S['gaming']} + 0.5::DOUBLE * {_PRICE} END)"
_S["software"] = (lambda base: f"(CASE WHEN {_has(_SOFT, ['7 years', '5 years', 'long support', 'clean'])} THEN least({base} + 0.10::DOUBLE, 1.0::DOUBLE) ELSE {base} END)")(_ladder([(_has(_SOFT, ["ios", "iphone", "pixel"]), 0.95), (_has(_SOFT, ["oneui", "samsung", "oxygenos", "nothing"]), 0.85), (_has(_SOFT, ["android"]), 0.7)], "0.5::DOUBLE"))
_S["foldable"] = f"{_has(_low('name', 'display_text', 'category'), V.FOLD_WORDS)}::INT::DOUBLE"
_S["compact"] = _ladder([("f_inches IS NULL", 0.0), ("f_inches <= 6.1::DOUBLE", 1.0), ("f_inches <= 6.3::DOUBLE", 0.85), ("f_inches <= 6.5::DOUBLE", 0.5)], "0.2::DOUBLE")
_S["business"] = _mean(_bucket("nullif(f_ram, 0)", 6, 16), _bucket("nullif(f_storage, 0)", 128, 512), _S["software"])
_S["student"] = f"(0.4::DOUBLE * {_S['value']} + 0.3::DOUBLE * {_S['battery']} + 0.3::DOUBLE * {_S['gaming']})"
_S["travel"] = f"least(0.5::DOUBLE * {_S['battery']} + 0.3::DOUBLE * {_S['charging']} + {_ladder([(_has(_TOUGH, ['ip68', 'ip67', 'gorilla', 'waterproof', 'rugged']), 0.2)], '0.0::DOUBLE')} + 0.2::DOUBLE, 1.0::DOUBLE)"
_S["photography"] = f"least({_S['camera']} + {_bucket(_flags('camera_text', V.OPTICS_FLAGS), 0, 3)} * 0.2::DOUBLE, 1.0::DOUBLE)"
_S["durability"] = (lambda base: f"(CASE WHEN {_has(_TOUGH, ['victus', 'ceramic shield', 'gorilla glass', 'titanium', 'armor'])} THEN least({base} + 0.15::DOUBLE, 1.0::DOUBLE) ELSE {base} END)")(_ladder([(_has(_TOUGH, ["ip69"]), 1.0), (_has(_TOUGH, ["ip68"]), 0.9), (_has(_TOUGH, ["ip67"]), 0.75)], "0.3::DOUBLE"))
_APPLE = f"({_BRAND} = 'apple' OR contains({_NAME}, 'iphone'))"
_S["resale"] = _ladder([(_APPLE, 0.95), (f"({_BRAND} = 'samsung' AND {_has(_NAME, ['s25', 's24', 's23', 'ultra', 'z fold', 'z flip'])})", 0.85), (f"{_BRAND} IN ('samsung', 'google', 'oneplus')", 0.7), (f"{_BRAND} IN ('xiaomi', 'realme', 'vivo', 'oppo')", 0.55)], "0.4::DOUBLE")
_S["ecosystem"] = _ladder([(_APPLE, 1.0), (f"{_BRAND} = 'samsung'", 0.85), (f"{_BRAND} = 'xiaomi'", 0.75), (f"{_BRAND} IN ('google', 'oneplus')", 0.7)], "0.5::DOUBLE")
_S["accessibility"] = _mean(_bucket("nullif(f_inches, 0)", 6, 7), _bucket("nullif(f_nits, 0)", 600, 2500), _S["battery"])
_S["content_creator"] = f"least({_S['camera']} * 0.6::DOUBLE + {_bucket(_flags('camera_text', V.VIDEO_FLAGS), 0, 4)} * 0.3::DOUBLE + {_ladder([('f_storage >= 256', 0.1)], '0.0::DOUBLE')} + 0.1::DOUBLE, 1.0::DOUBLE)"
_S["ai_features"] = _ladder([(_has(_AI, V.FLAGSHIP_AI), 1.0), (_has(_AI, V.FAST_NPU), 0.85), (_has(_AI, V.MIDDLE_NPU), 0.65)], "0.3::DOUBLE")
_S["budget"], _S["ai"] = _S["value"], _S["ai_features"]


def _score_query(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scoring.with_features(phones(spark, sf_dir)).select("id", F.round(scoring.score(name), 9).alias("score"))

    return query


_ASKS = {"recommend_ranked": ["camera", "value", "durability"], "recommend_plain": []}
_FILTER = {"brand": "samsung", "budget_min": 8000.0, "budget_max": 150000.0}


def _ranked(spark: SparkSession, sf_dir: str, priorities: list[str]) -> DataFrame:
    return scoring.rank(scoring.candidates(phones(spark, sf_dir), **_FILTER), priorities, 10)


def _ranked_sql(priorities: list[str], extra: str = "") -> str:
    names = list(dict.fromkeys([*scoring.BASE, *priorities]))
    mean = lambda ns: "(" + " + ".join(f"s_{n}" for n in ns) + f") / {len(ns)}"
    final = f"0.8::DOUBLE * ({mean(priorities)}) + 0.2::DOUBLE * ({mean(names)})" if priorities else mean(names)
    return f"""WITH {FEATURES_SQL}, picked AS (
  SELECT * FROM feats WHERE price_min > 0 AND lower(brand) = 'samsung' AND price_min >= 8000 AND price_min <= 150000 ORDER BY price_min NULLS LAST, id LIMIT 100
), scored AS (SELECT *, {', '.join(f'{_S[n]} AS s_{n}' for n in names)} FROM picked
), final AS (SELECT *, round({final}, 9) AS score FROM scored
), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, coalesce(nullif(price_min, 0), 999999), id) AS rank FROM final)
{extra}"""


_RANK_COLUMNS = ["rank", "id", "name", "score", "confidence", "unofficial_price"]
_RANK_SELECT = "SELECT rank, id, name, score, round_even(least(0.85::DOUBLE * score + 0.15::DOUBLE, 1.0::DOUBLE), 2) AS confidence, CASE WHEN price_max <> price_min THEN price_max END AS unofficial_price FROM ranked WHERE rank <= 10"


def recommend_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    priorities = _ASKS["recommend_ranked"]
    return _ranked(spark, sf_dir, priorities).select("rank", "id", scoring.reason(priorities).alias("reason"))


def recommend_pros_cons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, []).select("rank", "id", F.array_join(scoring.pros(), "; ").alias("pros"), F.array_join(scoring.cons(), "; ").alias("cons"))


_SAID = lambda n: f"CASE WHEN s_{n} >= 0.7 THEN concat('excellent {n} (score: ', printf('%.2f', s_{n}), ')') WHEN s_{n} >= 0.5 THEN concat('good {n} (score: ', printf('%.2f', s_{n}), ')') END"
_REASON_SQL = f"""SELECT rank, id, concat(upper(t[1]), t[2:], '.') AS reason FROM (SELECT rank, id, array_to_string(list_filter([
    CASE WHEN price_min > 0 THEN concat('Priced at ', format('{{:,}}', price_min::BIGINT), ' BDT') END,
    CASE WHEN len(strong) > 0 THEN concat('delivers ', array_to_string(strong, ' and ')) END,
    CASE WHEN len(built) > 0 THEN concat('features ', array_to_string(built, ', ')) END], lambda x: x IS NOT NULL), ', ') AS t
  FROM (SELECT *, list_filter([{', '.join(_SAID(n) for n in _ASKS['recommend_ranked'])}], lambda x: x IS NOT NULL) AS strong,
    list_filter([CASE WHEN f_ram > 0 AND storage_gb > 0 THEN concat(f_ram, 'GB RAM / ', storage_gb, 'GB Storage') END,
      CASE WHEN NOT contains(lower(processor_text), 'unknown') THEN trim(split_part(processor_text, '(', 1)) END,
      CASE WHEN battery_mah > 0 THEN concat(battery_mah, 'mAh battery') END], lambda x: x IS NOT NULL) AS built
  FROM ranked WHERE rank <= 10))"""
_PROS_SQL = "SELECT rank, id, coalesce(nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN greatest({', '.join('s_' + n for n in ns)}) >= 0.7 THEN '{s}' END" for ns, s in scoring.FOR) + "], lambda x: x IS NOT NULL), '; '), ''), 'Balanced price-to-performance feature set') AS pros, coalesce(nullif(array_to_string(list_filter([" + ", ".join(f"CASE WHEN s_{n} < 0.5 THEN '{s}' END" for n, s in scoring.AGAINST) + "], lambda x: x IS NOT NULL), '; '), ''), 'Premium pricing relative to budget alternatives') AS cons FROM ranked WHERE rank <= 10"

QUERIES = {f"score_{n}": _score_query(n) for n in scoring.SCORERS if n not in ("performance", "budget", "ai")}
ORACLE_SQL = {f"score_{n}": f"WITH {FEATURES_SQL} SELECT id, round({_S[n]}, 9) AS score FROM feats" for n in scoring.SCORERS if n not in ("performance", "budget", "ai")}
for _name, _asked in _ASKS.items():
    QUERIES[_name] = lambda spark, sf_dir, asked=_asked: _ranked(spark, sf_dir, asked).select(*_RANK_COLUMNS)
    ORACLE_SQL[_name] = _ranked_sql(_asked, _RANK_SELECT)
QUERIES |= {"recommend_reasons": recommend_reasons, "recommend_pros_cons": recommend_pros_cons}
ORACLE_SQL |= {"recommend_reasons": _ranked_sql(_ASKS["recommend_ranked"], _REASON_SQL), "recommend_pros_cons": _ranked_sql([], _PROS_SQL)}


# Comparison: dimensions of some products, winners, and who leads

_C: dict[str, str] = {}
_CPU = _ladder([("processor_text IS NULL", 0.3)] + [(_has("lower(processor_text)", w), v) for v, w in V.CPU_TIERS], "0.5::DOUBLE")
_COS = _low("os", "brand")
_C["Display"] = _mean(_bucket("f_inches", 5.5, 7.0), _bucket("f_hertz", 60, 144), r"(CASE WHEN regexp_matches(display_text, '\bLTPO\b') THEN 1.0::DOUBLE WHEN regexp_matches(display_text, '\b(AMOLED|OLED)\b') THEN 0.85::DOUBLE WHEN regexp_matches(display_text, '\bHDR') THEN 0.5::DOUBLE END)", _bucket("nullif(f_nits, 0)", 400, 3000))
_C["Processor"] = _CPU
_C["Camera"] = _mean(_bucket("nullif(f_mp, 0)", 12, 200), _bucket(f"nullif({_flags('camera_text', V.COMPARE_CAMERA_FLAGS)}, 0)", 0, 5))
_C["Battery"] = f"coalesce({_bucket('f_mah', 3000, 7000)}, 0.0::DOUBLE)"
_C["Charging"] = f"coalesce({_bucket('f_watt', 10, 150)}, 0.0::DOUBLE)"
_C["Software"] = f"greatest({', '.join(_ladder([(_has(_COS, w), v)], '0.5::DOUBLE') for w, v in ((['ios', 'iphone'], 0.9), (['android'], 0.6), (['stock', 'pixel'], 0.85), (['one ui', 'oxygen', 'coloros', 'origin'], 0.75)))})"
_C["AI Features"] = _ladder([(_has(_AI, V.FLAGSHIP_AI), 1.0), (_has(_AI, V.COMPARE_FAST_NPU), 0.85), (_has(_AI, V.MIDDLE_NPU), 0.65)], "0.3::DOUBLE")
_C["Gaming"] = _mean(_CPU, _bucket("f_ram", 4, 16), _bucket("f_hertz", 60, 144))
_C["Photography"] = _mean(_bucket("nullif(f_mp, 0)", 12, 200), _bucket(f"nullif({_flags('camera_text', V.COMPARE_PHOTO_FLAGS)}, 0)", 0, 6))
_C["Value"] = f"(CASE WHEN coalesce(price_min, 0) <= 0 THEN 0.0::DOUBLE ELSE 0.55::DOUBLE * {_mean(_CPU, _bucket('f_ram', 4, 16), _bucket('f_storage', 64, 1024), _bucket('f_mah', 3000, 7000))} + 0.45::DOUBLE * {_PRICE} END)"
_COMPARED = [5, 42, 77, 301]


def _compared(spark: SparkSession, sf_dir: str, aspect: str | None = None) -> DataFrame:
    return comparison.dimensions(phones(spark, sf_dir).where(F.col("id").isin(_COMPARED)), aspect)


def compare_dimensions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).select("id", "dimension", F.round("score", 9).alias("score"))


def compare_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir, "camera").select("id", "dimension", F.round("score", 9).alias("score"))


def compare_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.winners(_compared(spark, sf_dir))


def compare_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.leader(_compared(spark, sf_dir))


def _long_sql(names: list[str]) -> str:
    some = ", ".join(map(str, _COMPARED))
    parts = " UNION ALL ".join(f"SELECT id, name, price_min, '{n}' AS dimension, {list(_C).index(n)} AS ord, {_C[n]} AS score FROM chosen" for n in names)
    return f"WITH {FEATURES_SQL}, chosen AS (SELECT * FROM feats WHERE id IN ({some})), long AS ({parts})"


_WIN = "w AS (SELECT dimension, ord, max(score) AS hi, min(score) AS lo, arg_max(id, (score, -id)) AS best FROM long GROUP BY ALL), won AS (SELECT dimension, ord, CASE WHEN hi - lo < 0.02 THEN NULL ELSE best END AS winner_id, round(hi - lo, 9) AS spread FROM w)"
QUERIES |= {"compare_dimensions_long": compare_dimensions_long, "compare_aspect": compare_aspect, "compare_winners": compare_winners, "compare_leader": compare_leader}
ORACLE_SQL |= {
    "compare_dimensions_long": _long_sql(list(_C)) + " SELECT id, dimension, round(score, 9) AS score FROM long",
    "compare_aspect": _long_sql(V.ASPECTS["camera"]) + " SELECT id, dimension, round(score, 9) AS score FROM long",
    "compare_winners": _long_sql(list(_C)) + f", {_WIN} SELECT dimension, winner_id, winner_id IS NULL AS is_tie, spread FROM won",
    "compare_leader": _long_sql(list(_C)) + f", {_WIN}, n AS (SELECT l.id, any_value(l.name) AS name, any_value(l.price_min) AS price_min, count(*) FILTER (WHERE w.winner_id = l.id) AS wins, count(*) FILTER (WHERE w.winner_id IS NULL) AS ties FROM long l JOIN won w USING (dimension) GROUP BY l.id) SELECT id, name, wins, ties, row_number() OVER (ORDER BY wins DESC, price_min NULLS LAST, id) = 1 AS leads FROM n",
}
