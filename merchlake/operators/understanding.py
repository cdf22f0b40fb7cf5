"""What a request asks for: scope, budget, priority, intent, plan; and which field a question is about."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.functions import vocabulary as V

c = F.col


def has_word(text: Column, words: list[str]) -> Column:
    """Whether a word stands alone in the text, or a phrase is part of it."""
    single = [w for w in words if " " not in w]
    phrases = [w for w in words if " " in w]
    tests = [text.rlike(r"\b(?:" + "|".join(w.replace(".", r"\.") for w in single) + r")\b")] if single else []
    return reduce(lambda a, b: a | b, tests + [F.contains(text, F.lit(p)) for p in phrases])


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def _scopes(message: Column) -> list[tuple[Column, str, float]]:
    """(condition, scope, confidence) in order: noise first, then the domain, greetings, small talk, other topics."""
    clean = F.trim(F.coalesce(message, F.lit("")))
    low = F.lower(clean)
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\w+"), F.lit(0)))
    smashed = (F.size(words) == 1) & (F.length(clean) > 8) & (F.size(F.array_distinct(F.split(clean, ""))) < 4)
    domain = F.arrays_overlap(words, F.array(*[F.lit(w) for w in [*V.SCOPE_BRANDS, *V.SCOPE_WORDS]])) | _any(low, V.SCOPE_PATTERNS)
    return [
        (F.coalesce(message, F.lit("")) == "", "UNKNOWN", 1.0),
        ((F.length(clean) < 2) | smashed, "UNKNOWN", 0.9),
        (domain, "PHONE_DOMAIN", 0.95),
        (low.rlike(V.GREETING) & (F.size(words) <= 5), "GENERAL_GREETING", 0.95),
        (_any(low, V.SMALL_TALK) & (F.size(words) <= 7), "SMALL_TALK", 0.95),
        (_any(low, V.UNRELATED), "UNRELATED", 0.95),
        (low.rlike(V.QUESTION_START), "UNRELATED", 0.85),
        (F.size(words) == 1, "UNKNOWN", 0.8),
        (F.lit(True), "UNKNOWN", 0.7),
    ]


def scope(message: Column) -> Column:
    """The scope of a message."""
    return T.ladder([(condition, name) for condition, name, _ in _scopes(message)], F.lit(None).cast("string"))


def scope_confidence(message: Column) -> Column:
    """How sure the scope of a message is."""
    return T.ladder([(condition, sure) for condition, _, sure in _scopes(message)], F.lit(None).cast("double"))


# Patterns of budgets
_UPPER = r"\b(?:under|below|less\s+than|within|max(?:imum)?|upto|up\s+to|cheap(?:er)?\s+than)\s*(\d+(?:\.\d+)?)\s*(k|thousand)?\b"
_LOWER = r"\b(?:above|over|more\s+than|min(?:imum)?|start(?:ing)?\s+from)\s*(\d+(?:\.\d+)?)\s*(k|thousand)?\b"
_RANGE = r"\b(?:between\s+)?(\d+(?:\.\d+)?)\s*(k|thousand)?\s*(?:and|to|-)\s*(\d+(?:\.\d+)?)\s*(k|thousand)?\b"


def budget(query: Column) -> tuple[Column, Column]:
    """(most, least) of the budget: a range, an upper or lower bound, 35k, or four to six digits; below 1000 means thousands."""
    q = F.lower(query)
    number = lambda p, g: T.first_match(q, p, g).cast("double")
    scaled = lambda n, short: F.when(short | (n < 1000), n * 1000).otherwise(n)
    a, b = number(_RANGE, 1), number(_RANGE, 3)
    ka, kb = (F.coalesce(T.first_match(q, _RANGE, g).startswith("k"), F.lit(False)) for g in (2, 4))
    a, b = scaled(a, ka | kb), scaled(b, kb)
    upper = scaled(number(_UPPER, 1), F.coalesce(T.first_match(q, _UPPER, 2) == "k", F.lit(False)))
    lower = scaled(number(_LOWER, 1), F.coalesce(T.first_match(q, _LOWER, 2) == "k", F.lit(False)))
    alone = F.coalesce(number(r"\b(\d+(?:\.\d+)?)\s*(k|thousand)\b", 1) * 1000, number(r"\b(\d{4,6})\b", 1))
    most = F.when(a.isNotNull(), F.greatest(a, b)).when(upper.isNotNull(), upper).when(lower.isNull(), alone)
    least = F.when(a.isNotNull(), F.least(a, b)).when(upper.isNull(), lower)
    return most, least


def priority(query: Column) -> Column:
    return T.ladder([(has_word(F.lower(query), words), name) for name, words in V.PRIORITIES.items()], F.lit(None).cast("string"))


def question_field(question: Column) -> Column:
    return T.ladder([(question.rlike(f"(?i){p}"), field) for p, field in V.QUESTION_FIELDS], F.lit(None).cast("string"))


def with_intent(queries: DataFrame, text: str = "text") -> DataFrame:
    """Adds budget_max, budget_min, priority, intent and confidence; the two best scores alike, from 2 on, mean mixed."""
    q = F.lower(F.trim(c(text)))
    most, least = budget(c(text))
    df = queries.withColumns({"budget_max": most, "budget_min": least, "priority": priority(c(text))})
    w = lambda name: has_word(q, V.INTENT_WORDS[name])
    part = lambda s: F.contains(q, F.lit(s))
    has_budget = c("budget_max").isNotNull() | c("budget_min").isNotNull()
    asks = w("recommendation") | (has_word(q, ["buy"]) & ~part("where to buy") & ~part("where can i buy"))
    points = {
        "recommendation": F.when(asks, 3).when(has_budget | c("priority").isNotNull(), 2),
        "comparison": F.when(w("comparison"), 4),
        "price_lookup": F.when(w("price_lookup") | (w("currency") & c("budget_max").isNull()), 2),
        "availability": F.when(part("where to buy") | (w("availability") & part("in stock")), 3).when(w("availability"), 2),
        "specification": F.when(w("specification"), 2),
        "review": F.when(w("review"), 3),
        "lifecycle": F.when(w("lifecycle") | (part("wait") & part("buy")) | (part("upgrade") & part("year")) | part("upcoming"), 5),
        "resale": F.when(w("resale") | part("resale") | part("trade-in") | part("refurbished") | part("pre-owned"), 4),
        "deals": F.when(w("deals"), 4),
        "general": F.when(reduce(lambda a, b: a | b, [q.startswith(g) for g in V.INTENT_WORDS["general"]]) | (F.size(F.split(q, r"\s+")) <= 2), 1),
    }
    scored = F.array(*[F.struct(F.coalesce(p, F.lit(0)).alias("points"), F.lit(-i).alias("order"), F.lit(n).alias("intent")) for i, (n, p) in enumerate(points.items())])

    def settled(best: Column) -> Column:
        first, second = best[0], best[1]
        intent = T.ladder([(first["points"] == 0, "general"), ((first["points"] == second["points"]) & (first["points"] >= 2), "mixed")], first["intent"])
        confidence = F.when(first["points"] == 0, 0.5).otherwise(F.least(0.5 + 0.1 * first["points"], F.lit(0.9)))
        return F.struct(intent.alias("intent"), F.round(confidence, 6).alias("confidence"))

    # inside a lambda the points are made once, and their many word tests stay out of one huge generated method
    df = df.withColumn("_r", F.transform(F.array(F.sort_array(scored, asc=False)), settled)[0])
    return df.withColumns({"intent": c("_r.intent"), "confidence": c("_r.confidence")}).drop("_r")


def with_plan(classified: DataFrame) -> DataFrame:
    """A row for each engine that answers a query, in order from 1."""
    spark = classified.sparkSession
    rubric = spark.createDataFrame([(i, n + 1, e) for i, engines in V.RUBRIC.items() for n, e in enumerate(engines)], "intent string, step int, engine string")
    return classified.join(F.broadcast(rubric), "intent")
