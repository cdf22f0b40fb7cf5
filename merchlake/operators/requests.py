"""Requests taken apart: 25 slots, brands and models by the catalog, priorities, names; and answered for many at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.functions import slots as S
from merchlake.functions import text as T
from merchlake.functions import vocabulary as V
from merchlake.functions.numbers import positive
from merchlake.operators import bands, comparison, scoring, understanding
from merchlake.operators.isolation import halved
from merchlake.operators.names import resolve
from merchlake.operators.understanding import has_word
from merchlake.sources.scratch import kept, spread

c = F.col


def budget(text: Column) -> Column:
    """The most that a request would spend, in taka: dollars first, then an upper bound, then an amount."""
    q = F.lower(text)
    number = lambda t, p, g=1: T.first_match(t, p, g)
    thousands = lambda n, short: F.when(F.coalesce(short, F.lit(False)) | (n < 1000), n * 1000).otherwise(n)
    most = thousands(number(q, S.AT_MOST).cast("double"), number(q, S.AT_MOST, 2).isin("k", "thousand"))
    amount = thousands(number(q, S.AMOUNT).cast("double"), number(q, S.AMOUNT, 2).isNotNull())
    return F.coalesce(number(text, S.DOLLARS).cast("double") * S.TAKA_PER_DOLLAR, most, amount)


def brands(text: Column) -> Column:
    """Brands in the order in which they appear; then those that only a model tells."""
    q = F.lower(text)
    at = [F.array_min(F.array_compact(F.array(*[F.nullif(F.instr(q, F.lit(w)), F.lit(0)) for w in words]))) for words in S.BRAND_WORDS.values()]
    named = F.array(*[F.struct(p.alias("at"), F.lit(i).alias("i"), F.lit(b).alias("brand")) for i, (p, b) in enumerate(zip(at, S.BRAND_WORDS, strict=True))])
    named = F.transform(F.array_sort(F.filter(named, lambda b: b["at"].isNotNull())), lambda b: b["brand"])
    told = F.array_compact(F.array(*[F.when(q.rlike(p), F.lit(b)) for p, b in S.MODEL_PATTERNS]))
    return F.array_distinct(F.concat(named, told))


def models(text: Column) -> Column:
    """What each pattern of models finds first, as it is written."""
    return F.array_distinct(F.array_compact(F.array(*[T.blank_to_null(F.trim(F.regexp_extract(text, f"(?i){p}", 0))) for p, _ in S.MODEL_PATTERNS])))


def slots(text: Column) -> dict[str, Column]:
    """Every slot of a request as a column; null where it names none."""
    text = F.coalesce(text, F.lit(""))
    q = F.lower(text)
    first = lambda items: F.get(items, 0)
    out = {"budget": budget(text), "brand": first(brands(text)), "brands": brands(text), "model": first(models(text)), "models": models(text)}
    out |= {name: T.ladder([(T.has_any(q, words), value) for value, words in steps], F.lit(None).cast("string")) for name, steps in S.LADDERS.items()}
    return out | {name: F.when(T.has_any(q, words), True) for name, words in S.FLAGS.items()}


def compact(columns: list[str]) -> Column:
    """Columns as JSON without nulls and empty lists."""
    return F.to_json(F.struct(*[F.when(F.size(n) > 0, c(n)).alias(n) if n in ("brands", "models") else c(n) for n in columns]))


def catalog_terms(phones: DataFrame) -> DataFrame:
    """(kind, term, shown): brands, product names and names without brackets and networks, each once, in lower case."""
    b = phones.select(F.lower(F.trim("brand")).alias("term")).where("term != ''").distinct()
    known = F.element_at(F.create_map(*[F.lit(x) for pair in S.CATALOG_BRANDS.items() for x in pair]), c("term"))
    b = b.select(F.lit("brand").alias("kind"), "term", F.coalesce(known, F.concat(F.upper(F.substring("term", 1, 1)), F.substring("term", 2, 255))).alias("shown"))
    name = F.lower(F.trim("name"))
    plain = T.squeeze(F.regexp_replace(F.regexp_replace(name, r"[\(\[\{].*?[\)\]\}]", ""), r"\b(?:5g|4g|lte)\b", ""))
    m = phones.select(F.explode(F.array(name, plain)).alias("term")).where(F.length("term") >= 3).distinct()
    return b.unionByName(m.select(F.lit("model").alias("kind"), "term", F.initcap("term").alias("shown")))


def named_in(requests: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, brands, models): terms of the catalog that stand alone in a request, the longest first.

    A model that is part of a longer one found before it is left out. Requests and terms meet by the word of each term that
    fewest terms have, an equi-join, and only such pairs are looked at as a whole; so a request that names a brand does
    not meet all models that do.
    """
    every = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0)))
    words = requests.select("query_id", F.lower("text").alias("q")).select("query_id", "q", F.explode(every("q")).alias("word"))
    in_terms = terms.select("kind", "term", "shown", F.explode(every("term")).alias("word"))
    rare = in_terms.groupBy("word").agg(F.count("*").alias("n"))
    t = in_terms.join(rare, "word").groupBy("kind", "term", "shown").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    edge = lambda x: F.regexp_replace(x, r"([^\w\s])", r"\\$1")
    met = words.join(t, "word").where(F.regexp_like("q", F.concat(F.lit(r"\b"), edge(c("term")), F.lit(r"\b"))))
    found = F.struct((-F.length("term")).alias("l"), c("term").alias("t"), c("shown").alias("s"))
    of = lambda kind: F.array_sort(F.collect_set(F.when(c("kind") == kind, found)))
    lists = met.groupBy("query_id").agg(of("brand").alias("b"), of("model").alias("m"))
    longest = F.filter("m", lambda x: ~F.exists("m", lambda y: (y["l"] < x["l"]) & F.contains(y["t"], x["t"])))
    lists = lists.select("query_id", F.transform("b", lambda x: x["s"]).alias("brands"), F.transform(longest, lambda x: x["s"]).alias("models"))
    empty = F.array().cast("array<string>")
    return requests.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce("brands", empty).alias("brands"), F.coalesce("models", empty).alias("models"))


def fields_asked(text: Column) -> Column:
    """The fields that a request names, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(f)) for p, f in V.QUESTION_FIELDS]))


def priorities(priority: Column, fields: Column) -> Column:
    """The scores that a request asks for: its priority, then its fields, each brought to a score that there is."""
    raw = F.concat(F.array_compact(F.array(F.lower(priority))), fields)
    to = F.create_map(*[F.lit(x) for pair in S.PRIORITY_OF_FIELD.items() for x in pair])
    mapped = F.transform(raw, lambda p: F.coalesce(F.element_at(to, p), p))
    return F.array_distinct(F.filter(mapped, lambda p: p.isin(*S.SUPPORTED_PRIORITIES)))


def wishes(texts: DataFrame) -> DataFrame:
    """What `recommend` is asked for by each request (query_id, text)."""
    text = c("text")
    df = texts.withColumns({"budget_max": budget(text), "budget_min": F.lit(None).cast("double"), "brand": F.get(brands(text), 0), "priorities": priorities(understanding.priority(text), fields_asked(text))})
    return df.withColumns({"foldable": F.array_contains("priorities", "foldable") | F.contains(F.lower("text"), F.lit("fold")), "five_g": F.contains(F.lower("text"), F.lit("5g"))})


def recommend(requests: DataFrame, phones: DataFrame, most: int = 100, top: int = 5) -> DataFrame:
    """(query_id, rank, id, score): for each request (query_id, budget_min, budget_max, brand, priorities, foldable, five_g)
    the best `top` of its `most` cheapest matches.

    Matches are kept to `most` a request before they are ranked, as a feature. They are found by price bands, and only
    products that some request has kept are scored, once each and by the scores that requests ask for. A catalog in few files is dealt to all cores.
    The final score is 0.8 of the mean of the priorities and 0.2 of the mean of all, or the mean of all without any.
    """
    phones = spread(phones)
    fold = T.has_any(T.lowered(c("category")), ["fold", "flip"]) | T.has_any(T.lowered(c("name")), ["fold", "flip"])
    five = T.has_any(T.lowered(c("network")), ["5g"]) | T.has_any(T.lowered(c("name")), ["5g"])
    narrow = phones.select("id", "price_min", "brand", fold.alias("foldable"), five.alias("five_g"))
    met = kept(bands.cheapest(requests, narrow, most))
    asked = {r["p"] for r in requests.select(F.explode("priorities").alias("p")).distinct().where(c("p").isin(*scoring.SCORERS)).collect()}
    names = sorted(asked | set(scoring.BASE))
    scored = scoring.with_scores(phones.join(met.select("id").distinct(), "id", "left_semi"), names)
    scored = scored.select("id", F.create_map(*[x for n in names for x in (F.lit(n), c(f"s_{n}"))]).alias("scores"))
    met = met.join(scored, "id").join(requests.select("query_id", "priorities"), "query_id")
    at = lambda n: F.coalesce(F.try_element_at("scores", n), F.lit(0.0))
    mean = lambda ns: F.aggregate(ns, F.lit(0.0), lambda s, n: s + at(n)) / F.size(ns)
    every = F.array_distinct(F.concat(F.array(*[F.lit(n) for n in scoring.BASE]), c("priorities")))
    final = F.when(F.size("priorities") > 0, 0.8 * mean(c("priorities")) + 0.2 * mean(every)).otherwise(mean(every))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce(positive(c("price_min")), F.lit(999999.0)), "id")
    ranked = met.withColumn("score", F.round(final, 9)).withColumn("rank", F.row_number().over(best))
    return ranked.where(c("rank") <= top).select("query_id", "rank", "id", "score")


def compared_names(text: Column) -> Column:
    """The names between vs, versus and `and`."""
    parts = F.transform(F.split(text, r"(?i)\b(?:vs\.?|versus|and)\b"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def question_name(question: Column) -> Column:
    """What a question leaves when its usual words are taken out: the product's name; all of it if nothing is left."""
    words = F.transform(F.split(F.trim(question), r"\s+"), lambda w: F.regexp_replace(w, r"""^[?,.:;!"'()\[\]]+|[?,.:;!"'()\[\]]+$""", ""))
    left = F.array_join(F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*S.QUESTION_WORDS)), " ")
    return F.when(left != "", left).otherwise(F.trim(question))


def display_label(brand: Column, name: Column) -> Column:
    """The name with its brand before it, unless it begins with that."""
    return F.when(F.startswith(F.lower(name), F.lower(brand)), name).otherwise(F.trim(F.concat_ws(" ", brand, name)))


def compare(requests: DataFrame, phones: DataFrame) -> DataFrame:
    """(query_id, ord, asked, id, wins, ties, leads, error) for requests (query_id, names: the names to compare).

    Names are resolved; where one is not found, or fewer than two are given, the request has an error and no scores.
    """
    asked = requests.select("query_id", F.posexplode("names").alias("ord", "name")).withColumn("name_id", F.struct("query_id", "ord"))
    found = resolve(asked.select("name_id", "name"), phones, "compare").select("name_id", "id")
    rows = asked.join(found, "name_id", "left").drop("name_id")
    state = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(c("id").isNull(), c("name")))).alias("missing"))
    error = F.when(F.size("missing") > 0, F.concat(F.lit("No phone matched: "), F.array_join("missing", ", "))).when(c("n") < 2, F.concat(F.lit("Need at least 2 phones, got "), c("n").cast("string")))
    state = state.select("query_id", error.alias("error"))
    good = rows.join(state.where("error is null"), "query_id").select("query_id", "id").distinct()
    long = good.join(comparison.dimensions(phones.join(good.select("id").distinct(), "id", "left_semi")), "id")
    best = long.groupBy("query_id", "dimension").agg(F.max("score").alias("hi"), F.min("score").alias("lo"), F.max_by("id", F.struct("score", -c("id"))).alias("best"))
    best = best.select("query_id", "dimension", F.when(c("hi") - c("lo") >= comparison.TIE, c("best")).alias("winner_id"))
    counted = long.join(best, ["query_id", "dimension"]).groupBy("query_id", "id", "price_min").agg(F.count_if(c("winner_id") == c("id")).alias("wins"), F.count_if(c("winner_id").isNull()).alias("ties"))
    order = Window.partitionBy("query_id").orderBy(F.desc("wins"), c("price_min").asc_nulls_last(), "id")
    counted = counted.withColumn("leads", F.row_number().over(order) == 1).drop("price_min")
    out = rows.join(state, "query_id").join(counted, ["query_id", "id"], "left")
    return out.select("query_id", "ord", c("name").alias("asked"), "id", "wins", "ties", "leads", "error")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def steps(planned: DataFrame) -> DataFrame:
    """(query_id, step, engine, search_text): what each engine that searches is asked; null for those that read the catalog."""
    suffix = F.element_at(F.create_map(*[F.lit(x) for pair in S.SEARCH_SUFFIX.items() for x in pair]), c("engine"))
    return planned.select("query_id", "step", "engine", F.concat("text", suffix).alias("search_text"))


def compose(parts: DataFrame) -> DataFrame:
    """(query_id, answer) from (query_id, scope, intent, catalog, snippets): a reply by scope, else what was found.

    With a column `broken`, engines that failed, an answer tells of them, so that it is not taken for all there is.
    """
    reply = F.element_at(F.create_map(*[F.lit(x) for pair in S.REPLIES.items() for x in pair]), c("scope"))
    section = lambda title, body: F.when(F.trim(body) != "", F.concat(F.lit(f"#### {title}\n\n"), F.trim(body)))
    body = F.concat_ws("\n\n", section("From the catalog (SQL)", c("catalog")), section("Supporting snippets (vector search)", c("snippets")), *([section("Failed, so not answered", c("broken"))] if "broken" in parts.columns else []))
    title = F.concat(F.lit("### "), F.array_join(F.transform(F.split("intent", "_"), F.initcap), "_"), F.lit(" — answer"))
    found = F.when(body != "", F.concat_ws("\n\n", title, body)).otherwise(F.lit(S.NO_ANSWER))
    return parts.select("query_id", F.when(c("scope") != "PHONE_DOMAIN", F.coalesce(reply, F.lit(S.REPLIES["UNKNOWN"]))).otherwise(found).alias("answer"))


def trace(text: Column) -> Column:
    """A text as a trace keeps it: at most 1200 characters, and about how many tokens the whole has."""
    return F.struct(F.substring(text, 1, 1200).alias("kept"), F.floor(F.length(text) / 4).alias("tokens"))


def has_field(text: Column, words: list[str]) -> Column:
    return has_word(F.lower(text), words)


def with_fallback(ranked: DataFrame, requests: DataFrame, search: Callable[[DataFrame], DataFrame], top: int = 5) -> DataFrame:
    """(query_id, rank, id, doc_id, score): ranked products, or for requests without any, documents found by `search`.

    `ranked` has query_id, rank, id, score. `search` gets the requests (query_id, text) that are left, and returns
    query_id, doc_id, score and rank from 0.
    """
    left = requests.select("query_id", "text").join(ranked.select("query_id").distinct(), "query_id", "left_anti").where(F.trim("text") != "")
    found = search(left).where(c("rank") < top).select("query_id", (c("rank") + 1).alias("rank"), F.lit(None).cast("long").alias("id"), "doc_id", "score")
    return ranked.select("query_id", "rank", c("id").cast("long").alias("id"), F.lit(None).cast("long").alias("doc_id"), "score").unionByName(found)


def dispatch(planned: DataFrame, engines: dict[str, Callable[[DataFrame], DataFrame]], tries: int = 64, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """What each engine says to the requests whose plan names it, and what went wrong.

    `planned` has a row for each request and step (query_id, step, engine, and whatever engines read). An engine takes its
    rows, of which each has a query_id of its own here, and returns (query_id, text) and, if it likes, error; it runs once
    for all its rows, and engines that are one function run together. Where that fails the rows are halved by a hash and
    tried again, until what fails is a single one, or `tries` runs are used up; so a request that an engine cannot take does
    not cost others their answer. Returns (query_id, step, engine, text), and (query_id, step, engine, error, broken) of steps
    that failed, that said they could not, or whose engine there is none; `broken` is false for those that said so, which is
    an engine's own result, and true for the others. `strict` is for jobs whose result has to be whole: an engine that
    fails, or that there is none of, ends them with its error, and nothing is tried again.
    """
    said = planned.select("query_id", "step", "engine").limit(0).withColumn("text", F.lit(""))
    failed = said.select("query_id", "step", "engine", c("text").alias("error"), F.lit(False).alias("broken"))
    named = sorted(r["engine"] for r in planned.select("engine").distinct().collect())  # as many as the rubric has
    if lost := [n for n in named if n not in engines]:
        if strict:
            raise LookupError(f"there is no engine {', '.join(lost)}")
        gone = planned.where(c("engine").isin(lost))
        failed = failed.unionByName(gone.select("query_id", "step", "engine", F.concat(F.lit("there is no engine "), "engine").alias("error"), F.lit(True).alias("broken")))
    of = lambda rows, other: rows.select(c("query_id").alias("ask"), c("query_id.query_id").alias("query_id"), "step", "engine").join(other.withColumnRenamed("query_id", "ask"), "ask").drop("ask")
    for engine in dict.fromkeys(engines[n] for n in named if n in engines):
        own = c("engine").isin([n for n in named if engines.get(n) is engine])
        done, lost = halved(planned.where(own).withColumn("query_id", F.struct("query_id", "step")), "query_id", lambda rows, engine=engine: _with_error(engine(rows)), tries, strict)
        for part, out in done:
            said = said.unionByName(of(part, out.where("text is not null").select("query_id", "text")))
            failed = failed.unionByName(of(part, out.where("error is not null").select("query_id", "error", F.lit(False).alias("broken"))))
        for part, why in lost:
            failed = failed.unionByName(part.select("query_id.query_id", "step", "engine", F.lit(why).alias("error"), F.lit(True).alias("broken")))
    return said, failed


def _with_error(out: DataFrame) -> DataFrame:
    return out.select("query_id", "text", c("error") if "error" in out.columns else F.lit(None).cast("string").alias("error"))


def joined_contexts(said: DataFrame, from_catalog: list[str]) -> DataFrame:
    """(query_id, catalog, snippets): what engines said, in the order of their steps, by where it comes from."""
    text = lambda mine: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(mine, F.struct("step", "text")))), lambda x: x["text"]), "\n\n")
    catalog = c("engine").isin(*from_catalog)
    return said.groupBy("query_id").agg(text(catalog).alias("catalog"), text(~catalog).alias("snippets"))
