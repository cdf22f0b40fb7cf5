"""Queries on whole requests: slots, names, priorities, recommendations, comparisons, questions, answers; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.functions import slots as S
from merchlake.functions import vocabulary as V
from merchlake.operators import answers
from merchlake.operators import pricing as P
from merchlake.operators import requests as R
from merchlake.operators import retrieval, scoring, specs
from merchlake.operators import understanding as U
from merchlake.operators.names import resolve
from merchlake.plans import language as L
from merchlake.plans import retrieval as PR
from merchlake.plans.catalogue import resolved_sql
from merchlake.plans.scores import _C, _S, FEATURES_SQL, _has
from merchlake.sources.catalog import LISTINGS_SQL, PHONES_SQL, listings, phones, stores, table
from merchlake.sources.scratch import fresh_root, kept
from merchlake.sources.texts import filled, rows, rows_sql, varied

QUERIES, ORACLE_SQL = {}, {}
c = F.col
ASKED = [
    "Best Samsung phone under $500 with stylus and ip68", "iPhone 16 vs Galaxy S25 camera zoom", "redmi note 13 or poco x6 below 30k", "student phone around 25000 taka with 5000mah battery", "gaming phone with cooling and 144hz display",
    "z flip 6 or z fold 5, foldable with esim", "galaxy ai translation on-device ai", "refurbished pixel, trade in my motorola", "wifi 7, uwb, satellite and dual 5g", "eco-friendly phone with removable battery", "wireless 65w fast charging amoled curved",
    "business phone with long software update support, travel roaming", "nothing phone 2 for a photographer, smartwatch", "oneplus nord 4 or vivo for kids", "best camera and battery 40 thousand taka", "cheap 5G phone", "", "hello there", "ram and chipset of a good performance phone", "best apple phone for gaming",
]
COMPARED = ["Samsung large pink iPhone 16 Pro vs google", "apple versus xiaomi and vivo", "nothing at all vs samsung", "realme", "oppo pixel vs. symphony flip"]
QUESTIONS = ["How much RAM does the Samsung Flip have?", "Does Xiaomi support wireless charging?", "google pixel 9 display", "Is the vivo water resistant?", "What about apple?", "how much"]
CHECKED = ["samsung", "google pixel", "Apple Z Flip 6 ring", "xiaomi", "zzz"]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _m(texts: list[str]) -> str:
    return f"WITH m AS (SELECT unnest(range(0, {len(texts)})) AS query_id, unnest([{', '.join(map(_quoted, texts))}]) AS text)"


_kept = lambda items: f"list_filter([{items}], lambda x: x IS NOT NULL)"
_once = lambda items: f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"
_get = lambda t, p, g=1: f"nullif(regexp_extract({t}, '{p}', {g}), '')"
_more = lambda n, short: f"(CASE WHEN coalesce({short}, false) OR {n} < 1000 THEN {n} * 1000 ELSE {n} END)"
_BUDGET = f"coalesce({_get('text', S.DOLLARS)}::DOUBLE * 120, {_more(_get('q', S.AT_MOST) + '::DOUBLE', _get('q', S.AT_MOST, 2) + ' IN (' + chr(39) + 'k' + chr(39) + ', ' + chr(39) + 'thousand' + chr(39) + ')')}, {_more(_get('q', S.AMOUNT) + '::DOUBLE', _get('q', S.AMOUNT, 2) + ' IS NOT NULL')})"
_AT = lambda words: "list_min(" + _kept(", ".join(f"nullif(instr(q, '{w}'), 0)" for w in words)) + ")"
_NAMED = "list_transform(list_sort(list_filter([" + ", ".join(f"{{'at': {_AT(words)}, 'i': {i}, 'brand': '{b}'}}" for i, (b, words) in enumerate(S.BRAND_WORDS.items())) + "], lambda b: b.at IS NOT NULL)), lambda b: b.brand)"
_TOLD = _kept(", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN '{b}' END" for p, b in S.MODEL_PATTERNS))
_MODELS = _kept(", ".join(f"nullif(trim(regexp_extract(text, '(?i){p}', 0)), '')" for p, _ in S.MODEL_PATTERNS))
_SLOT = {name: "CASE " + " ".join(f"WHEN {_has('q', words)} THEN '{v}'" for v, words in steps) + " END" for name, steps in S.LADDERS.items()}
_SLOT |= {name: f"CASE WHEN {_has('q', words)} THEN true END" for name, words in S.FLAGS.items()}
_E = f"""{_m(ASKED)}, l AS (SELECT *, lower(text) AS q FROM m), e0 AS (SELECT *, {_BUDGET} AS budget, list_concat({_NAMED}, {_TOLD}) AS b, {_MODELS} AS md FROM l),
e AS (SELECT query_id, text, q, budget, {_once('b')} AS brands, {_once('md')} AS models, {', '.join(f'{x} AS {n}' for n, x in _SLOT.items())} FROM e0)"""
_SLOT_COLUMNS = ["budget", "brand", "brands", "model", "models", *S.LADDERS, *S.FLAGS]


#: A request for each product: one of ASKED with amounts and a brand of its own.
_BRANDS = ["samsung", "redmi", "vivo", "poco", "apple", "motorola", "oneplus"]
_EACH = {"query_id": "p_partkey", "text": filled([t.replace("$500", "$1{k}") for t in varied(ASKED, _BRANDS)])}
_QUESTION = {"query_id": "p_partkey", "text": filled([q.replace("Flip", "{name}") for q in varied(QUESTIONS, ["samsung", "xiaomi", "vivo", "apple"])])}
_OF_ROWS = lambda sql, columns=_EACH, texts=ASKED: sql.replace(_m(texts), f"WITH m AS ({rows_sql(columns)})")


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _EACH).select("query_id", *[x.alias(n) for n, x in R.slots(c("text")).items()])


@query(f"{_OF_ROWS(_E)} SELECT query_id, budget, brands[1] AS brand, array_to_string(brands, ',') AS brands, models[1] AS model, array_to_string(models, ',') AS models, {', '.join(_SLOT)} FROM e")
def nlu_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).withColumns({"brands": F.array_join("brands", ","), "models": F.array_join("models", ",")})


_JSON = _kept(", ".join([f"'\"budget\":' || budget::VARCHAR", "CASE WHEN len(brands) > 0 THEN '\"brand\":\"' || brands[1] || '\"' END", "CASE WHEN len(brands) > 0 THEN '\"brands\":[\"' || array_to_string(brands, '\",\"') || '\"]' END", "CASE WHEN len(models) > 0 THEN '\"model\":\"' || models[1] || '\"' END", "CASE WHEN len(models) > 0 THEN '\"models\":[\"' || array_to_string(models, '\",\"') || '\"]' END"] + [f"'\"{n}\":\"' || {n} || '\"'" for n in S.LADDERS] + [f"CASE WHEN {n} THEN '\"{n}\":true' END" for n in S.FLAGS]))


@query(f"{_OF_ROWS(_E)} SELECT query_id, '{{' || array_to_string({_JSON}, ',') || '}}' AS entities FROM e")
def nlu_entities_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).select("query_id", R.compact(_SLOT_COLUMNS).alias("entities"))


_PH = f"WITH phones AS ({FEATURES_SQL.partition('phones AS (')[2].partition('), feats AS')[0]})"
_NAME = "lower(trim(name))"
_TERMS = rf"""t AS (SELECT 'brand' AS kind, lower(trim(brand)) AS term, CASE lower(trim(brand)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in S.CATALOG_BRANDS.items())} ELSE upper(lower(trim(brand))[1]) || lower(trim(brand))[2:] END AS shown FROM phones WHERE trim(brand) <> '' GROUP BY ALL
UNION ALL SELECT DISTINCT 'model', term, NULL FROM (SELECT unnest([{_NAME}, trim(regexp_replace(regexp_replace(regexp_replace({_NAME}, '[\(\[\{{].*?[\)\]\}}]', '', 'g'), '\b(?:5g|4g|lte)\b', '', 'g'), '\s+', ' ', 'g'))]) AS term FROM phones) WHERE length(term) >= 3)"""
_CATALOG_TEXTS = ["compare samsung and vivo today", "is there any google phone", "the xiaomi large ring note 13 pro 5g please", "nothing known"]


def _catalog_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that name products of the catalog: the fixed ones, and one that holds a whole name."""
    own = phones(spark, sf_dir).where("id in (7, 11)").select((F.lit(100) + c("id")).cast("int").alias("query_id"), F.concat(F.lit("price of "), F.lower("name"), F.lit(" now")).alias("text"))
    return _texts(spark, _CATALOG_TEXTS).unionByName(own)


@query(rf"""{_PH}, m AS (SELECT unnest(range(0, {len(_CATALOG_TEXTS)}))::INT AS query_id, unnest([{', '.join(map(_quoted, _CATALOG_TEXTS))}]) AS text UNION ALL SELECT (100 + id)::INT, 'price of ' || lower(name) || ' now' FROM phones WHERE id IN (7, 11)), {_TERMS},
met AS (SELECT query_id, kind, term, shown FROM m, t WHERE regexp_matches(lower(text), '\b' || regexp_replace(term, '([^\w\s])', '\\\1', 'g') || '\b')),
kept AS (SELECT * FROM met a WHERE kind = 'brand' OR NOT EXISTS (SELECT 1 FROM met b WHERE b.query_id = a.query_id AND b.kind = 'model' AND length(b.term) > length(a.term) AND contains(b.term, a.term)))
SELECT m.query_id, coalesce(string_agg(shown, ',' ORDER BY -length(term), term) FILTER (WHERE kind = 'brand'), '') AS brands, coalesce(string_agg(term, ',' ORDER BY -length(term), term) FILTER (WHERE kind = 'model'), '') AS models FROM m LEFT JOIN kept USING (query_id) GROUP BY m.query_id""")  # fmt: skip
def nlu_catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.named_in(_catalog_texts(spark, sf_dir), R.catalog_terms(phones(spark, sf_dir)))
    return found.select("query_id", F.array_join("brands", ",").alias("brands"), F.lower(F.array_join("models", ",")).alias("models"))


_low = "lower(text)"
_PRI = "CASE " + " ".join(f"WHEN {L._word(_low, w)} THEN '{n}'" for n, w in V.PRIORITIES.items()) + " END"
_FIELDS = _kept(", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{f}' END" for p, f in V.QUESTION_FIELDS))
_RAW = f"list_concat({_kept(_PRI)}, {_FIELDS})"
_MAPPED = f"list_filter(list_transform({_RAW}, lambda p: CASE p {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in S.PRIORITY_OF_FIELD.items())} ELSE p END), lambda p: list_contains({S.SUPPORTED_PRIORITIES!r}, p))"
_ASK = f"""{_E}, r0 AS (SELECT e.*, {_MAPPED} AS p FROM e), r AS (SELECT query_id, budget AS budget_max, brands[1] AS brand, {_once('p')} AS priorities, coalesce(list_contains({_once('p')}, 'foldable'), false) OR contains(q, 'fold') AS foldable, contains(q, '5g') AS five_g FROM r0)"""


@query(f"{_OF_ROWS(_ASK)} SELECT query_id, budget_max, brand, array_to_string(priorities, ',') AS priorities, foldable, five_g FROM r")
def request_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.wishes(rows(spark, sf_dir, _EACH)).select("query_id", "budget_max", "brand", F.array_join("priorities", ",").alias("priorities"), "foldable", "five_g")


_FOLD = "(" + " OR ".join(f"contains(lower(coalesce({x}, '')), '{w}')" for x in ("category", "name") for w in ("fold", "flip")) + ")"
_FIVE = "(contains(lower(coalesce(network, '')), '5g') OR contains(lower(name), '5g'))"
_BASE = ", ".join(f"'{n}'" for n in scoring.BASE)
_LONG = " UNION ALL ".join(f"SELECT id, '{n}' AS n, {_S.get({'performance': 'gaming', 'budget': 'value', 'ai': 'ai_features'}.get(n, n))} AS s FROM feats WHERE price_min > 0" for n in sorted(scoring.SCORERS))
_RECOMMEND = f"""{_ASK}, {FEATURES_SQL}, sc AS ({_LONG}),
met AS (SELECT query_id, id, price_min, priorities FROM r, feats WHERE price_min > 0 AND (brand IS NULL OR lower(feats.brand) = lower(r.brand)) AND (budget_max IS NULL OR price_min <= budget_max) AND (NOT foldable OR {_FOLD}) AND (NOT five_g OR {_FIVE}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY price_min, id) <= 100),
pr AS (SELECT query_id, id, avg(coalesce(s, 0)) AS s FROM (SELECT query_id, id, unnest(priorities) AS n FROM met) LEFT JOIN sc USING (id, n) GROUP BY ALL),
al AS (SELECT query_id, id, avg(coalesce(s, 0)) AS s FROM (SELECT DISTINCT query_id, id, n FROM (SELECT query_id, id, unnest(list_concat([{_BASE}], priorities)) AS n FROM met)) LEFT JOIN sc USING (id, n) GROUP BY ALL),
fin AS (SELECT query_id, id, price_min, round(CASE WHEN len(priorities) > 0 THEN 0.8::DOUBLE * pr.s + 0.2::DOUBLE * al.s ELSE al.s END, 9) AS score FROM met LEFT JOIN pr USING (query_id, id) LEFT JOIN al USING (query_id, id)),
ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, price_min, id) AS rank FROM fin QUALIFY rank <= 5)"""  # fmt: skip


@query(f"{_RECOMMEND.replace('r.brand)', 'r.brand)').replace('(brand IS NULL OR', '(r.brand IS NULL OR')} SELECT query_id, rank, id, round(score, 6) AS score FROM ranked")
def recommend_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recommend(R.wishes(_texts(spark, ASKED)), phones(spark, sf_dir)).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(_OF_ROWS(ORACLE_SQL["recommend_requests"]))
def recommend_for_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for as many requests as there are products."""
    return R.recommend(R.wishes(rows(spark, sf_dir, _EACH)), phones(spark, sf_dir)).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


_SPLIT = r"list_filter(list_transform(regexp_split_to_array(text, '(?i)\b(?:vs\.?|versus|and)\b'), lambda p: trim(p)), lambda p: p <> '')"
_COMPARE = f"""{_m(COMPARED)}, {FEATURES_SQL}, asked AS (SELECT query_id, unnest(list_transform({_SPLIT}, lambda p, i: {{'ord': i - 1, 'name': p}})) AS a FROM m), names AS (SELECT query_id * 100 + a.ord AS name_id, a.name AS name FROM asked), {resolved_sql('names', 'compare')},
rows AS (SELECT names.name_id // 100 AS query_id, names.name_id % 100 AS ord, trim(names.name) AS name, met.id FROM names LEFT JOIN met USING (name_id)),
state AS (SELECT query_id, CASE WHEN count(*) FILTER (WHERE id IS NULL) > 0 THEN 'No phone matched: ' || string_agg(name, ', ' ORDER BY name) FILTER (WHERE id IS NULL) WHEN count(*) < 2 THEN 'Need at least 2 phones, got ' || count(*) END AS error FROM rows GROUP BY query_id),
good AS (SELECT DISTINCT query_id, id FROM rows JOIN state USING (query_id) WHERE error IS NULL), chosen AS (SELECT * FROM feats WHERE id IN (SELECT id FROM good)),
dims AS ({" UNION ALL ".join(f"SELECT id, price_min, '{n}' AS dimension, {x} AS score FROM chosen" for n, x in _C.items())}), long AS (SELECT query_id, dims.* FROM good JOIN dims USING (id)),
won AS (SELECT query_id, dimension, CASE WHEN max(score) - min(score) >= 0.02 THEN arg_max(id, (score, -id)) END AS winner_id FROM long GROUP BY ALL),
cnt AS (SELECT long.query_id, long.id, any_value(price_min) AS price_min, count(*) FILTER (WHERE winner_id = long.id) AS wins, count(*) FILTER (WHERE winner_id IS NULL) AS ties FROM long JOIN won USING (query_id, dimension) GROUP BY ALL),
led AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY wins DESC, price_min NULLS LAST, id) = 1 AS leads FROM cnt)"""  # fmt: skip


@query(f"{_COMPARE} SELECT rows.query_id, ord, name AS asked, id, wins, ties, leads, error FROM rows JOIN state USING (query_id) LEFT JOIN led USING (query_id, id)")
def compare_by_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _texts(spark, COMPARED).select("query_id", R.compared_names(c("text")).alias("names"))
    return R.compare(asked, phones(spark, sf_dir))


_WORDS = r"""list_transform(regexp_split_to_array(trim(text), '\s+'), lambda w: regexp_replace(w, '^[?,.:;!"''()\[\]]+|[?,.:;!"''()\[\]]+$', '', 'g'))"""
_QNAME = f"coalesce(nullif(array_to_string(list_filter({_WORDS}, lambda w: w <> '' AND NOT list_contains({S.QUESTION_WORDS!r}, lower(w))), ' '), ''), trim(text))"
_QFIELD = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{f}'" for p, f in V.QUESTION_FIELDS) + " END"


@query(f"{_OF_ROWS(_m(QUESTIONS), _QUESTION, QUESTIONS)} SELECT query_id, {_QNAME} AS name, {_QFIELD} AS field FROM m")
def spec_question_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _QUESTION).select("query_id", R.question_name(c("text")).alias("name"), U.question_field(c("text")).alias("field"))


@query(f"{_m(QUESTIONS)}, qs AS (SELECT query_id, {_QNAME} AS name, {_QFIELD} AS field FROM m), {FEATURES_SQL}, names AS (SELECT query_id AS name_id, name FROM qs), {resolved_sql('names', 'lookup')}, fields AS ({L.FIELDS_SQL}) SELECT query_id, met.id, fields.field, label, display, source FROM qs JOIN met ON met.name_id = query_id JOIN fields ON fields.id = met.id AND (qs.field IS NULL OR qs.field = fields.field)")
def spec_question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _texts(spark, QUESTIONS).select("query_id", R.question_name(c("text")).alias("name"), U.question_field(c("text")).alias("asked"))
    found = resolve(asked.select(c("query_id").alias("name_id"), "name"), phones(spark, sf_dir)).select(c("name_id").alias("query_id"), "id")
    fields = specs.described(phones(spark, sf_dir).join(found.select("id").distinct(), "id", "left_semi"))
    return asked.join(found, "query_id").join(fields, "id").where(c("asked").isNull() | (c("asked") == c("field"))).select("query_id", "id", "field", "label", "display", "source")


_money = lambda x: f"format('{{:,}}', ({x})::BIGINT)"
_LABEL = "CASE WHEN starts_with(lower(name), lower(brand)) THEN name ELSE trim(brand || ' ' || name) END"


@query(f"""WITH {FEATURES_SQL}, names AS (SELECT unnest(range(0, {len(CHECKED)})) AS name_id, unnest([{', '.join(map(_quoted, CHECKED))}]) AS name), {resolved_sql('names', 'lookup')}, listings AS ({LISTINGS_SQL}),
o AS (SELECT l.phone_id, s_name AS store_name, price, in_stock, row_number() OVER (PARTITION BY phone_id ORDER BY in_stock DESC, price NULLS LAST, s_name, order_id, line) AS r FROM listings l JOIN supplier ON store_id = s_suppkey WHERE phone_id IN (SELECT id FROM met)),
s AS (SELECT phone_id, min(price) AS lowest, max(price) AS highest, count(*) AS offers, arg_min(store_name, (price, r)) FILTER (WHERE price IS NOT NULL) AS cheapest FROM o GROUP BY phone_id)
SELECT names.name_id AS query_id, met.id, lowest, highest, coalesce(offers, 0) AS offers, CASE WHEN met.id IS NULL THEN 'No phone matched: ' || names.name WHEN offers IS NULL THEN 'No store listings found for ' || brand || ' ' || p.name || '.' WHEN lowest IS NULL THEN 'Listings exist for ' || brand || ' ' || p.name || ' but no price has been published yet.'
WHEN highest > lowest THEN 'Cheapest: ' || cheapest || ' at ৳' || {_money('lowest')} || '. Buying from there saves ~' || printf('%.1f', round_even(round_even((highest - lowest) / highest * 100, 2), 1)) || '% versus the highest priced store.' ELSE 'Only one store has a price for ' || brand || ' ' || p.name || ': ' || cheapest || ' at ৳' || {_money('lowest')} || '.' END AS advice
FROM names LEFT JOIN met USING (name_id) LEFT JOIN phones p ON p.id = met.id LEFT JOIN s ON s.phone_id = met.id""")  # fmt: skip
def price_check_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _texts(spark, CHECKED).select(c("query_id").alias("name_id"), c("text").alias("name"))
    return P.check(names, phones(spark, sf_dir), listings(spark, sf_dir), stores(spark, sf_dir))


_SUFFIX = "CASE engine " + " ".join(f"WHEN '{e}' THEN text || '{s}'" for e, s in S.SEARCH_SUFFIX.items()) + " END"
_RUB = ", rub AS (SELECT unnest([" + ", ".join(f"'{i}'" for i, es in V.RUBRIC.items() for _ in es) + "]) AS intent, unnest([" + ", ".join(str(n + 1) for es in V.RUBRIC.values() for n, _ in enumerate(es)) + "]) AS step, unnest([" + ", ".join(f"'{e}'" for es in V.RUBRIC.values() for e in es) + "]) AS engine)"


@query(f"{L._I}{_RUB} SELECT query_id, step, engine, {_SUFFIX} AS search_text FROM cls JOIN rub USING (intent) JOIN m USING (query_id)")
def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.steps(U.with_plan(U.with_intent(L._messages(spark, sf_dir))))


_REPLY = "CASE scope " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in S.REPLIES.items()) + f" ELSE {_quoted(S.REPLIES['UNKNOWN'])} END"


@query(f"{L.SCOPED_SQL} SELECT query_id, {_REPLY} AS reply FROM sc WHERE scope <> 'PHONE_DOMAIN'")
def guard_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = L._messages(spark, sf_dir).select("query_id", U.scope(c("text")).alias("scope"), F.lit("general").alias("intent"), F.lit("").alias("catalog"), F.lit("").alias("snippets")).where("scope != 'PHONE_DOMAIN'")
    return R.compose(scoped).select("query_id", c("answer").alias("reply"))


@query(f"{L.SCOPED_SQL} SELECT query_id, scope, confidence FROM sc")
def nlu_scope_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L._messages(spark, sf_dir).select("query_id", U.scope(c("text")).alias("scope"), U.scope_confidence(c("text")).alias("confidence"))


_TEXT_LINES = f"""{_RECOMMEND.replace('(brand IS NULL OR', '(r.brand IS NULL OR')}, found AS (SELECT query_id, string_agg(rank || '. ' || name || ' (' || brand || ') — score ' || printf('%.2f', score), chr(10) ORDER BY rank) AS lines FROM ranked JOIN feats USING (id) GROUP BY query_id)"""


@query(f"{_TEXT_LINES}, a AS (SELECT query_id, CASE WHEN lines IS NOT NULL THEN '### Recommendation — answer' || chr(10) || chr(10) || '#### From the catalog (SQL)' || chr(10) || chr(10) || '### Recommendations' || chr(10) || lines ELSE {_quoted(S.NO_ANSWER)} END AS answer FROM m LEFT JOIN found USING (query_id)) SELECT query_id, answer, answer[:1200] AS kept, (length(answer) // 4) AS tokens FROM a")
def answer_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to each request that recommendations alone can give, and its trace."""
    found = R.recommend(R.wishes(_texts(spark, ASKED)), phones(spark, sf_dir)).join(phones(spark, sf_dir).select("id", "name", "brand"), "id")
    line = F.format_string("%d. %s (%s) — score %.2f", "rank", "name", "brand", "score")
    lines = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    parts = _texts(spark, ASKED).join(lines, "query_id", "left").select("query_id", F.lit("PHONE_DOMAIN").alias("scope"), F.lit("recommendation").alias("intent"), F.coalesce(F.concat(F.lit("### Recommendations\n"), "lines"), F.lit("")).alias("catalog"), F.lit("").alias("snippets"))
    return R.compose(parts).withColumn("t", R.trace(c("answer"))).select("query_id", "answer", "t.*")


_RANKED = _RECOMMEND.replace("(brand IS NULL OR", "(r.brand IS NULL OR")
_FALL = f"asked AS (SELECT query_id, text FROM m WHERE trim(text) <> '' AND query_id NOT IN (SELECT query_id FROM ranked)), qtok AS ({PR._TOKENS('asked', 'query_id')})"


@query(f"{_RANKED}, {PR._BASE.removeprefix('WITH ')}, {_FALL}, {PR._COS}, {PR._BM}, h AS (SELECT query_id, doc_id, round(0.5::DOUBLE * {PR._MM('cand.score')} + 0.5::DOUBLE * {PR._MM('bm.score')}, 6) AS score FROM cand JOIN bm USING (query_id, doc_id) WINDOW w AS (PARTITION BY query_id)), hr AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= 5) SELECT query_id, rank, id, NULL::BIGINT AS doc_id, round(score, 6) AS score FROM ranked UNION ALL SELECT query_id, rank, NULL, doc_id, score FROM hr")
def recommend_or_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations, and documents for requests that no product fits."""
    ranked = R.recommend(R.wishes(_texts(spark, ASKED)), phones(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return R.with_fallback(kept(ranked), _texts(spark, ASKED), lambda left: retrieval.search(table(spark, sf_dir, "documents"), left, kept, fresh_root(spark, "index")))


CHAT = ASKED + COMPARED + QUESTIONS + ["compare Samsung large pink iPhone 16 Pro and google", "specs of the Apple Z Flip 6 ring", "what does the google pixel 9 cost", "upcoming xiaomi, should i wait or buy", "how are you", "recipe for chicken curry", "resale value of a vivo"]
_FROM = "WITH m AS (SELECT query_id, text FROM about)"
_nested = lambda sql, of: sql.replace(_m(of), _FROM)
_NAMES_ABOUT = f"names AS (SELECT query_id AS name_id, {_QNAME} AS name FROM about)"
_PRICED = ORACLE_SQL["price_check_by_name"].replace(f"names AS (SELECT unnest(range(0, {len(CHECKED)})) AS name_id, unnest([{', '.join(map(_quoted, CHECKED))}]) AS name)", _NAMES_ABOUT)
_SPECIFIED = _nested(ORACLE_SQL["spec_question_answer"], QUESTIONS).replace("met.id, fields.field, label, display, source FROM", "CASE WHEN starts_with(lower(phones.name), lower(phones.brand)) THEN phones.name ELSE trim(phones.brand || ' ' || phones.name) END AS product, fields.field, label, display FROM").replace("FROM qs JOIN met ON met.name_id = query_id", "FROM qs JOIN met ON met.name_id = query_id JOIN phones ON phones.id = met.id")
_COMPARED_SQL = _nested(ORACLE_SQL["compare_by_names"], COMPARED)
_SNIP = r"(CASE WHEN length(flat) <= 160 THEN flat ELSE rtrim(regexp_replace(flat[:160], '\s\S*$', '')) || '…' END)"
_SEARCHED = f"""{PR._BASE}, asked AS (SELECT query_id * 100 + step AS query_id, {_SUFFIX} AS text FROM planned JOIN about USING (query_id) WHERE engine IN ('deals', 'future_phones', 'resale', 'review', 'search')), qtok AS ({PR._TOKENS('asked', 'query_id')}), {PR._COS}, {PR._BM},
h AS (SELECT query_id, doc_id, round(0.5::DOUBLE * {PR._MM('cand.score')} + 0.5::DOUBLE * {PR._MM('bm.score')}, 6) AS score FROM cand JOIN bm USING (query_id, doc_id) WINDOW w AS (PARTITION BY query_id)), hr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= 5),
flat AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents WHERE doc_id IN (SELECT doc_id FROM hr)) SELECT query_id // 100 AS query_id, query_id % 100 AS step, '### Found' || chr(10) || string_agg(rank || '. ' || {_SNIP}, chr(10) ORDER BY rank) AS text FROM hr JOIN flat USING (doc_id) GROUP BY ALL"""
_ANSWERS = f"""WITH chat AS (SELECT unnest(range(0, {len(CHAT)})) AS query_id, unnest([{', '.join(map(_quoted, CHAT))}]) AS text),
scoped AS ({L.SCOPED_SQL.replace(L._M, 'WITH m AS (SELECT query_id, text FROM chat)')} SELECT query_id, scope FROM sc), about AS (SELECT chat.* FROM chat JOIN scoped USING (query_id) WHERE scope = 'PHONE_DOMAIN'),
intents AS ({L._I.replace(L._M, _FROM)} SELECT query_id, intent FROM cls){_RUB}, planned AS (SELECT query_id, step, engine FROM intents JOIN rub USING (intent)),
rec AS ({_nested(_TEXT_LINES, ASKED)} SELECT query_id, '### Recommendations' || chr(10) || lines AS text FROM found),
pri AS (SELECT query_id, '### Prices' || chr(10) || advice AS text FROM ({_PRICED}) WHERE id IS NOT NULL),
spe AS (SELECT query_id, '### ' || any_value(product) || chr(10) || string_agg('- ' || label || ': ' || display, chr(10) ORDER BY field) AS text FROM ({_SPECIFIED}) GROUP BY query_id),
com AS (SELECT c.*, p.name AS product FROM ({_COMPARED_SQL}) c LEFT JOIN ({PHONES_SQL}) p USING (id)), cmp AS (SELECT query_id, '### Comparison' || chr(10) || string_agg('- ' || product || ': ' || wins || ' won, ' || ties || ' even' || CASE WHEN leads THEN ' — leads' ELSE '' END, chr(10) ORDER BY ord) AS text FROM com WHERE error IS NULL GROUP BY query_id),
sea AS ({_SEARCHED}),
said AS (SELECT query_id, step, engine, text FROM planned JOIN rec USING (query_id) WHERE engine IN ('recommend', 'buying_guide') UNION ALL SELECT query_id, step, engine, text FROM planned JOIN pri USING (query_id) WHERE engine = 'pricing' UNION ALL SELECT query_id, step, engine, text FROM planned JOIN spe USING (query_id) WHERE engine = 'specs'
UNION ALL SELECT query_id, step, engine, text FROM planned JOIN cmp USING (query_id) WHERE engine = 'compare' UNION ALL SELECT query_id, step, engine, text FROM planned JOIN sea USING (query_id, step)),
ctx AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY step) FILTER (WHERE engine IN ('recommend', 'buying_guide', 'pricing', 'specs', 'compare')) AS catalog, string_agg(text, chr(10) || chr(10) ORDER BY step) FILTER (WHERE engine IN ('deals', 'future_phones', 'resale', 'review', 'search')) AS snippets FROM said GROUP BY query_id)"""  # fmt: skip


def _chat(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, root = table(spark, sf_dir, "documents"), fresh_root(spark, "index")
    retrieval.build_index(docs.select("doc_id", "text"), root)
    by_name = answers.engines(phones(spark, sf_dir), listings(spark, sf_dir), stores(spark, sf_dir), docs, retrieval.load_index(spark, root))
    return answers.answer(_texts(spark, CHAT), by_name, strict=True)


@query(f"""{_ANSWERS} SELECT query_id, scope, coalesce(intent, 'general') AS intent, CASE WHEN scope <> 'PHONE_DOMAIN' THEN {_REPLY} WHEN coalesce(trim(catalog), '') = '' AND coalesce(trim(snippets), '') = '' THEN {_quoted(S.NO_ANSWER)}
ELSE concat_ws(chr(10) || chr(10), '### ' || array_to_string(list_transform(string_split(intent, '_'), lambda w: upper(w[1]) || w[2:]), '_') || ' — answer', '#### From the catalog (SQL)' || chr(10) || chr(10) || nullif(trim(catalog), ''), '#### Supporting snippets (vector search)' || chr(10) || chr(10) || nullif(trim(snippets), '')) END AS answer
FROM chat JOIN scoped USING (query_id) LEFT JOIN intents USING (query_id) LEFT JOIN ctx USING (query_id)""")  # fmt: skip
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request through guard, plan and all engines that its plan names, each of which runs once for all requests; one that fails ends the query."""
    return _chat(spark, sf_dir)[0]


@query(f"{_ANSWERS} SELECT DISTINCT query_id, step, engine, error FROM planned JOIN com USING (query_id) WHERE engine = 'compare' AND error IS NOT NULL")
def chat_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of these requests that an engine could not take, and why."""
    return _chat(spark, sf_dir)[1].drop("broken")
