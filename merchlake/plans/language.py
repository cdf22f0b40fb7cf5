"""Queries on requests, specifications and rendered documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.functions import vocabulary as V
from merchlake.operators import specs as S
from merchlake.operators import understanding as U
from merchlake.plans.scores import _first, _has, _low, _most
from merchlake.sources.catalog import PHONES_SQL, phones
from merchlake.sources.texts import filled, rows, rows_sql, varied

QUERIES, ORACLE_SQL = {}, {}
c = F.col
MESSAGES = [
    "Best phone under 20000 taka", "Best phone under 30k in Bangladesh", "Phones between 15000 to 25000 taka", "Best Samsung phone under 50000 taka", "Cheapest 5G phone in Bangladesh",
    "hello", "hi there!", "thanks a lot", "How are you today?", "write a python function", "who won the world cup", "aaaaaaaaaaaaaa", "x", "", "what is gravity", "blorp", "blorp glorp frob",
    "compare galaxy s25 vs iphone 16", "where to buy pixel 9", "is the redmi note in stock?", "Samsung S24 specs and details", "review of nothing phone", "should i wait or buy now", "resale value of iphone 13",
    "any emi or bank offer on vivo?", "price of poco x6", "good camera for vlogging and night video", "above 40k gaming", "starting from 15 thousand", "a phone less than 35 k", "iphone 16 and 17", "just 45000", "battery 5000 mah", "cheap student phone", "foldable with hinge", "Does it support wireless Qi charging?", "How much ram has it", "which chipset", "fast charge?", "sd card slot", "android 15 update", "is it IP68?",
]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


_SAID = {"query_id": "p_partkey", "text": filled(varied(MESSAGES, ["samsung", "redmi", "vivo", "poco", "pixel"]))}


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each product: one of MESSAGES with amounts and brands of its own."""
    return rows(spark, sf_dir, _SAID)


_M = f"WITH m AS ({rows_sql(_SAID)})"
_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_any = lambda x, ps: "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in ps) + ")"


def _word(x: str, words: list[str]) -> str:
    single = "|".join(w.replace(".", "[.]") for w in words if " " not in w)
    tests = ([f"regexp_matches({x}, '\\b(?:{single})\\b')"] if single else []) + [f"contains({x}, '{w}')" for w in words if " " in w]
    return "(" + " OR ".join(tests) + ")"


_SCOPES = [
    ("coalesce(text, '') = ''", "UNKNOWN", 1.0), ("length(t) < 2 OR (len(ws) = 1 AND length(t) > 8 AND len(list_distinct(string_split(t, ''))) < 4)", "UNKNOWN", 0.9),
    (f"list_has_any(ws, {_list([*V.SCOPE_BRANDS, *V.SCOPE_WORDS])}) OR {_any('l', V.SCOPE_PATTERNS)}", "PHONE_DOMAIN", 0.95), (f"regexp_matches(l, '{V.GREETING}') AND len(ws) <= 5", "GENERAL_GREETING", 0.95),
    (f"{_any('l', V.SMALL_TALK)} AND len(ws) <= 7", "SMALL_TALK", 0.95), (_any("l", V.UNRELATED), "UNRELATED", 0.95), (f"regexp_matches(l, '{V.QUESTION_START}')", "UNRELATED", 0.85), ("len(ws) = 1", "UNKNOWN", 0.8), ("true", "UNKNOWN", 0.7),
]
SCOPED_SQL = _M + rf""", w AS (SELECT *, trim(text) AS t, lower(trim(text)) AS l, list_distinct(regexp_extract_all(lower(trim(text)), '\w+')) AS ws FROM m),
sc AS (SELECT query_id, text, CASE {' '.join(f"WHEN {x} THEN '{n}'" for x, n, _ in _SCOPES)} END AS scope, CASE {' '.join(f"WHEN {x} THEN {v}::DOUBLE" for x, _, v in _SCOPES)} END AS confidence FROM w)"""


@query(SCOPED_SQL + " SELECT query_id, scope FROM sc")
def nlu_scope_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("query_id", U.scope(c("text")).alias("scope"))


_num = lambda p, g: f"nullif(regexp_extract(lower(text), '{p}', {g}), '')"
_scaled = lambda n, k: f"(CASE WHEN {k} OR {n} < 1000 THEN {n} * 1000 ELSE {n} END)"
_B = _M + f""", b AS (SELECT *, {_num(U._RANGE, 1)}::DOUBLE AS a0, {_num(U._RANGE, 3)}::DOUBLE AS b0, coalesce(starts_with({_num(U._RANGE, 2)}, 'k'), false) AS ka, coalesce(starts_with({_num(U._RANGE, 4)}, 'k'), false) AS kb,
{_num(U._UPPER, 1)}::DOUBLE AS u0, coalesce({_num(U._UPPER, 2)} = 'k', false) AS ku, {_num(U._LOWER, 1)}::DOUBLE AS l0, coalesce({_num(U._LOWER, 2)} = 'k', false) AS kl,
coalesce({_num(chr(92) + 'b(' + chr(92) + 'd+(?:' + chr(92) + '.' + chr(92) + 'd+)?)' + chr(92) + 's*(k|thousand)' + chr(92) + 'b', 1)}::DOUBLE * 1000, {_num(chr(92) + 'b(' + chr(92) + 'd{4,6})' + chr(92) + 'b', 1)}::DOUBLE) AS alone FROM m),
bud AS (SELECT query_id, text, CASE WHEN a0 IS NOT NULL THEN greatest({_scaled('a0', '(ka OR kb)')}, {_scaled('b0', 'kb')}) WHEN u0 IS NOT NULL THEN {_scaled('u0', 'ku')} WHEN l0 IS NULL THEN alone END AS budget_max,
CASE WHEN a0 IS NOT NULL THEN least({_scaled('a0', '(ka OR kb)')}, {_scaled('b0', 'kb')}) WHEN u0 IS NULL THEN {_scaled('l0', 'kl')} END AS budget_min FROM b),
pri AS (SELECT *, CASE {' '.join(f"WHEN {_word('lower(text)', w)} THEN '{n}'" for n, w in V.PRIORITIES.items())} END AS priority, lower(trim(text)) AS q FROM bud)"""  # fmt: skip


@query(_B + " SELECT query_id, budget_max, budget_min FROM bud")
def nlu_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    most, least = U.budget(c("text"))
    return _messages(spark, sf_dir).select("query_id", most.alias("budget_max"), least.alias("budget_min"))


@query(_B + " SELECT query_id, priority FROM pri")
def nlu_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("query_id", U.priority(c("text")).alias("priority"))


_w = lambda n: _word("q", V.INTENT_WORDS[n])
_POINTS = {
    "recommendation": f"CASE WHEN {_w('recommendation')} OR ({_word('q', ['buy'])} AND NOT contains(q, 'where to buy') AND NOT contains(q, 'where can i buy')) THEN 3 WHEN budget_max IS NOT NULL OR budget_min IS NOT NULL OR priority IS NOT NULL THEN 2 ELSE 0 END",
    "comparison": f"CASE WHEN {_w('comparison')} THEN 4 ELSE 0 END",
    "price_lookup": f"CASE WHEN {_w('price_lookup')} OR ({_w('currency')} AND budget_max IS NULL) THEN 2 ELSE 0 END",
    "availability": f"CASE WHEN contains(q, 'where to buy') OR ({_w('availability')} AND contains(q, 'in stock')) THEN 3 WHEN {_w('availability')} THEN 2 ELSE 0 END",
    "specification": f"CASE WHEN {_w('specification')} THEN 2 ELSE 0 END",
    "review": f"CASE WHEN {_w('review')} THEN 3 ELSE 0 END",
    "lifecycle": f"CASE WHEN {_w('lifecycle')} OR (contains(q, 'wait') AND contains(q, 'buy')) OR (contains(q, 'upgrade') AND contains(q, 'year')) OR contains(q, 'upcoming') THEN 5 ELSE 0 END",
    "resale": f"CASE WHEN {_w('resale')} OR contains(q, 'resale') OR contains(q, 'trade-in') OR contains(q, 'refurbished') OR contains(q, 'pre-owned') THEN 4 ELSE 0 END",
    "deals": f"CASE WHEN {_w('deals')} THEN 4 ELSE 0 END",
    "general": "CASE WHEN " + " OR ".join(f"starts_with(q, '{g}')" for g in V.INTENT_WORDS["general"]) + r" OR len(regexp_split_to_array(q, '\s+')) <= 2 THEN 1 ELSE 0 END",
}
_I = _B + ", pts AS (" + " UNION ALL ".join(f"SELECT query_id, '{n}' AS intent, {i} AS ord, {p} AS points FROM pri" for i, (n, p) in enumerate(_POINTS.items())) + "), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, ord) AS n, lead(points) OVER (PARTITION BY query_id ORDER BY points DESC, ord) AS next FROM pts), cls AS (SELECT query_id, CASE WHEN points = 0 THEN 'general' WHEN points = next AND points >= 2 THEN 'mixed' ELSE intent END AS intent, CASE WHEN points = 0 THEN 0.5::DOUBLE ELSE round(least(0.5::DOUBLE + 0.1::DOUBLE * points, 0.9::DOUBLE), 6) END AS confidence FROM rk WHERE n = 1)"


@query(_I + " SELECT * FROM cls")
def nlu_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.with_intent(_messages(spark, sf_dir)).select("query_id", "intent", "confidence")


@query(_I + ", rub AS (SELECT unnest([" + ", ".join(f"'{i}'" for i, es in V.RUBRIC.items() for _ in es) + "]) AS intent, unnest([" + ", ".join(str(n + 1) for es in V.RUBRIC.values() for n, _ in enumerate(es)) + "]) AS step, unnest([" + ", ".join(f"'{e}'" for es in V.RUBRIC.values() for e in es) + "]) AS engine) SELECT query_id, step, engine FROM cls JOIN rub USING (intent)")
def nlu_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.with_plan(U.with_intent(_messages(spark, sf_dir))).select("query_id", "step", "engine")


@query(_M + " SELECT query_id, CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{f}'" for p, f in V.QUESTION_FIELDS) + " END AS field FROM m")
def spec_question_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("query_id", U.question_field(c("text")).alias("field"))


_P = f"WITH phones AS ({PHONES_SQL})"
_N = {
    "mah": _first("battery_text", "(?i)([0-9]{2,5})[ ]*mAh") + "::INT",
    "watt": "floor(" + _first("battery_text", "(?i)([0-9]{1,3}(?:[.][0-9]+)?)[ ]*W(?:[^0-9A-Za-z_]|$)") + "::DOUBLE)::INT",
    "ram": "coalesce(" + _first("name", "(?i)([0-9]{1,3})[ ]*GB(?:[ ]+RAM|[ ]*RAM|[ ]+LPDDR)") + ", " + _first("name", "(?i)(?:^|[^0-9A-Za-z_])([0-9]{1,2})[ ]*GB(?:[^0-9A-Za-z_]|$)") + ")::INT",
    "inches": _first("display_text", "(?i)([0-9][.][0-9]{1,2})[ ]*-?[ ]*inch") + "::DOUBLE",
    "hertz": _first("display_text", "(?i)([0-9]{2,3})[ ]*Hz") + "::INT",
    "megapixels": _most("camera_text", "(?i)([0-9]{1,3})[ ]*MP"),
    "nits": _most("display_text", "(?i)([0-9]{3,5})[ ]*nits"),
}


@query(_P + " SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in _N.items()) + " FROM phones")
def spec_extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phones(spark, sf_dir).select("id", *[e.alias(n) for n, e in S.numbers().items()])


_wl, _net, _body = _low("battery_text", "display_text", "camera_text", "network", "os"), _low("network"), _low("display_text", "camera_text", "battery_text", "network")
_CHECKS = {
    "wireless_charging": f"CASE WHEN {_has(_wl, ['wireless charging', 'qi ', 'qi-charging', 'qi charging', 'inductive charging'])} THEN true WHEN {_has(_wl, ['no wireless', 'not support wireless'])} THEN false END",
    "five_g": f"CASE WHEN {_net} <> '' THEN {_has(_net, ['5g', 'lte-a'])} END",
    "nfc": f"CASE WHEN {_has(_low('network', 'camera_text', 'battery_text', 'display_text'), ['nfc'])} THEN true END",
    "water_resistance": rf"CASE WHEN regexp_matches({_body}, '\bip68\b') OR {_has(_body, ['water resistant', 'ipx'])} THEN true WHEN {_has(_body, ['no ip', 'no water resistance'])} THEN false END",
    "sd_card": f"CASE WHEN {_has(_low('display_text', 'battery_text', 'camera_text', 'os'), ['microsd', 'memory card', 'sd card'])} THEN true WHEN {_has(_low('display_text', 'battery_text', 'camera_text', 'os'), ['no microsd', 'no sd card'])} THEN false END",
}


@query(_P + " SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in _CHECKS.items()) + " FROM phones")
def spec_feature_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phones(spark, sf_dir).select("id", *[e.alias(n) for n, e in S.feature_checks().items()])


_F = [("ram", "ram_gb", _N["ram"], " GB"), ("storage", "storage_gb", "NULL::INT", " GB"), ("battery", "battery_mah", _N["mah"], " mAh"), ("charging", "charging_w", _N["watt"], " W")]


@query(_P + " SELECT * FROM (" + " UNION ALL ".join([f"SELECT id, '{f}' AS field, coalesce({col}, {t}) || '{u}' AS value, CASE WHEN {col} IS NOT NULL THEN 'column' ELSE 'text' END AS source FROM phones" for f, col, t, u in _F] + [f"SELECT id, '{f}', CASE WHEN trim({x}) <> '' THEN {x} END, 'column' FROM phones" for f, x in (("os", "os"), ("network", "network"), ("processor", "processor_text"))]) + ") WHERE value IS NOT NULL")
def spec_fields_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fields_long(phones(spark, sf_dir))


_flat = lambda x: rf"trim(regexp_replace(nullif(trim({x}), ''), '\s+', ' ', 'g'))"
_first_of = lambda x: rf"coalesce(nullif(regexp_extract({_flat(x)}, '^(.*?[.!?])\s', 1), ''), {_flat(x)})"
_sentence = lambda x: f"(CASE WHEN length({_first_of(x)}) <= 140 THEN {_first_of(x)} ELSE rtrim({_first_of(x)}[:139]) || '…' END)"
_blank = lambda x: f"nullif(trim({x}), '')"
_field = lambda key, value, display, source, summary="''": f"SELECT id, '{key}' AS field, '{S.LABELS[key]}' AS label, ({value})::VARCHAR AS value, {display} AS display, {source} AS source, coalesce({summary}, '') AS summary FROM phones"
_count = lambda key, value, unit, other="NULL": _field(key, value, f"coalesce({value} || '{unit}', {other}, '{S.MISSING}')", f"CASE WHEN {value} IS NOT NULL THEN 'parsed' WHEN {other} IS NOT NULL THEN 'text' ELSE 'unknown' END")
_plain = lambda key, x: _field(key, "NULL", f"coalesce({_sentence(x)}, '{S.MISSING}')", f"CASE WHEN {_blank(x)} IS NOT NULL THEN 'text' ELSE 'unknown' END")
_feature = lambda key, x: _field(key, x, f"CASE WHEN {x} THEN '{S.YES}' WHEN NOT ({x}) THEN '{S.NO}' ELSE '{S.UNKNOWN}' END", f"CASE WHEN ({x}) IS NOT NULL THEN 'checked' ELSE 'unknown' END")


def _bits(key: str, bits: list[str], x: str) -> str:
    known = f"list_filter([{', '.join(bits)}], lambda b: b IS NOT NULL)"
    return _field(key, "NULL", f"CASE WHEN len({known}) > 0 THEN array_to_string({known}, ', ') ELSE coalesce({_sentence(x)}, '{S.MISSING}') END", f"CASE WHEN len({known}) > 0 THEN 'parsed' WHEN {_blank(x)} IS NOT NULL THEN 'text' ELSE 'unknown' END", f"CASE WHEN len({known}) > 0 THEN {_sentence(x)} END")


_INCHES, _LOW_D = f"coalesce(display_inches, {_N['inches']})", "lower(coalesce(display_text, ''))"
_PANEL = f"CASE WHEN contains({_LOW_D}, 'amoled') THEN 'AMOLED' WHEN contains({_LOW_D}, 'oled') THEN 'OLED' WHEN contains({_LOW_D}, 'ips') THEN 'IPS' END"
_PRO = f"len(list_filter({_list(S.CAMERA_WORDS)}, lambda w: contains(lower(coalesce(camera_text, '')), w)))"
_FIVE, _NETWORK = _CHECKS["five_g"], _sentence("network")
FIELDS_SQL = " UNION ALL ".join([
    _count("ram", f"coalesce(ram_gb, {_N['ram']})", " GB"), _count("storage", "storage_gb", " GB"), _plain("processor", "processor_text"),
    _count("battery", f"coalesce(battery_mah, {_N['mah']})", " mAh", _sentence("battery_text")), _count("charging", f"coalesce(charging_w, {_N['watt']})", " W", _sentence("battery_text")), _feature("wireless_charging", _CHECKS["wireless_charging"]),
    _bits("display", [f"CASE WHEN {_INCHES} IS NOT NULL THEN printf('%.2f\"', {_INCHES}) END", f"{_N['hertz']} || ' Hz'", f"{_N['nits']} || ' nits peak'", _PANEL], "display_text"),
    _bits("camera", [f"{_N['megapixels']} || ' MP main'", f"CASE WHEN {_PRO} > 0 THEN {_PRO} || ' pro features' END"], "camera_text"), _plain("os", "os"),
    _field("network", f"CASE WHEN {_blank('network')} IS NOT NULL THEN {_FIVE} END", f"coalesce({_NETWORK} || CASE WHEN {_FIVE} THEN ' — 5G support ✓' WHEN NOT ({_FIVE}) THEN ' — 5G support ✗' ELSE '' END, '{S.MISSING}')", f"CASE WHEN {_blank('network')} IS NOT NULL THEN 'text+feature' ELSE 'unknown' END"),
    *[_feature(n, _CHECKS[n]) for n in ("nfc", "water_resistance", "sd_card")],
])


@query(f"{_P} {FIELDS_SQL}")
def spec_fields_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.described(phones(spark, sf_dir))
