"""Answers to requests, many at once: the guard, the plan, the engines that it names, and what they say put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.operators import pricing, requests, retrieval, specs, understanding
from merchlake.operators.names import resolve
from merchlake.sources.scratch import kept

c = F.col
#: Engines that read the catalog; the others search documents.
CATALOG = ["buying_guide", "compare", "pricing", "recommend", "specs"]
SEARCHES = ["deals", "future_phones", "resale", "review", "search"]


def _lines(rows: DataFrame, title: Column, order: list[str], line: Column) -> DataFrame:
    """(query_id, text): a title and the lines of each request in order."""
    g = rows.withColumns({"_title": title, "_line": line}).groupBy("query_id").agg(F.first("_title").alias("t"), F.array_sort(F.collect_list(F.struct(*order, "_line"))).alias("l"))
    return g.select("query_id", F.concat_ws("\n", F.concat(F.lit("### "), c("t")), F.array_join(F.transform("l", lambda x: x["_line"]), "\n")).alias("text"))


def recommended(rows: DataFrame, phones: DataFrame) -> DataFrame:
    """The best products for each request, one to a line."""
    found = requests.recommend(requests.wishes(rows.select("query_id", "text")), phones).join(phones.select("id", "name", "brand"), "id")
    return _lines(found, F.lit("Recommendations"), ["rank"], F.format_string("%d. %s (%s) — score %.2f", "rank", "name", "brand", "score"))


def specified(rows: DataFrame, phones: DataFrame) -> DataFrame:
    """What a request asks of the product that it names: one field, or all of them."""
    asked = rows.select("query_id", requests.question_name(c("text")).alias("name"), understanding.question_field(c("text")).alias("asked"))
    found = kept(resolve(asked.select(c("query_id").alias("name_id"), "name"), phones).select(c("name_id").alias("query_id"), "id"))
    own = phones.join(found.select("id").distinct(), "id", "left_semi")
    said = specs.described(own).join(own.select("id", requests.display_label(c("brand"), c("name")).alias("product")), "id")
    lines = asked.join(found, "query_id").join(said, "id").where(c("asked").isNull() | (c("asked") == c("field")))
    return _lines(lines, c("product"), ["field"], F.concat(F.lit("- "), "label", F.lit(": "), "display"))


def priced(rows: DataFrame, phones: DataFrame, listings: DataFrame, stores: DataFrame) -> DataFrame:
    """The prices of the product that a request names; nothing where it names none."""
    names = rows.select(c("query_id").alias("name_id"), requests.question_name(c("text")).alias("name"))
    found = pricing.check(names, phones, listings, stores).where("id is not null")
    return found.select("query_id", F.concat(F.lit("### Prices\n"), "advice").alias("text"))


def compared(rows: DataFrame, phones: DataFrame) -> DataFrame:
    """How the products that a request names compare; an error where one is not found or there are fewer than two."""
    found = kept(requests.compare(rows.select("query_id", requests.compared_names(c("text")).alias("names")), phones))
    named = found.where("error is null").join(phones.select("id", c("name").alias("product")), "id")
    lines = _lines(named, F.lit("Comparison"), ["ord"], F.concat(F.lit("- "), "product", F.lit(": "), c("wins").cast("string"), F.lit(" won, "), c("ties").cast("string"), F.lit(" even"), F.when(c("leads"), F.lit(" — leads")).otherwise("")))
    return lines.withColumn("error", F.lit(None).cast("string")).unionByName(found.where("error is not null").select("query_id", F.lit(None).cast("string").alias("text"), "error").distinct())


def searched(rows: DataFrame, docs: DataFrame, index: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """The beginnings of the documents that a request's search text finds."""
    found = kept(retrieval.search_index(index, rows.select("query_id", c("search_text").alias("text")), kept, key))
    texts = docs.join(found.select(key).distinct(), key, "left_semi").select(key, T.snippet(c("text"), 160).alias("snippet"))
    return _lines(found.join(texts, key), F.lit("Found"), ["rank"], F.concat((c("rank") + 1).cast("string"), F.lit(". "), "snippet"))


def engines(phones: DataFrame, listings: DataFrame, stores: DataFrame, docs: DataFrame, index: dict[str, DataFrame]) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Every engine that a plan may name."""
    recommend, search = (lambda r: recommended(r, phones)), (lambda r: searched(r, docs, index))
    catalog = {"recommend": recommend, "buying_guide": recommend, "specs": lambda r: specified(r, phones), "pricing": lambda r: priced(r, phones, listings, stores), "compare": lambda r: compared(r, phones)}
    return catalog | {name: search for name in SEARCHES}


def answer(texts: DataFrame, by_name: dict[str, Callable[[DataFrame], DataFrame]], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(query_id, scope, intent, answer) for requests (query_id, text), and (query_id, step, engine, error, broken) of steps that failed.

    A request that is not about phones gets the reply of its scope and no engine sees it. The others go by the plan of their
    intent; what the engines say is put together in the order of its steps, what reads the catalog first. An answer names
    engines that broke under it; with `strict` there is none, and their error is raised (see `requests.dispatch`).
    """
    asked = kept(texts.select("query_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("scope", understanding.scope(c("text"))))
    mine = kept(understanding.with_intent(asked.where("scope = 'PHONE_DOMAIN'").select("query_id", "text")))
    said, failed = requests.dispatch(kept(requests.steps(understanding.with_plan(mine)).join(mine.select("query_id", "text"), "query_id")), by_name, strict=strict)
    contexts = requests.joined_contexts(said, CATALOG)
    broken = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "engine", "error"))), lambda x: F.concat(F.lit("- "), x["engine"], F.lit(": "), x["error"])), "\n")
    broken = failed.where("broken").groupBy("query_id").agg(broken.alias("broken"))
    parts = asked.select("query_id", "scope").join(mine.select("query_id", "intent"), "query_id", "left").join(contexts, "query_id", "left").join(broken, "query_id", "left")
    parts = kept(parts.select("query_id", "scope", F.coalesce("intent", F.lit("general")).alias("intent"), F.coalesce("catalog", F.lit("")).alias("catalog"), F.coalesce("snippets", F.lit("")).alias("snippets"), F.coalesce("broken", F.lit("")).alias("broken")))
    return parts.select("query_id", "scope", "intent").join(requests.compose(parts), "query_id"), failed
