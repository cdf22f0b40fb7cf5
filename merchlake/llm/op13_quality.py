"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A document is kept if no rule rejects it. Rules are asked one after the other and the first that rejects ends it; so what
comes first should reject much and cost little. Both are measured on a sample: the share of documents a rule rejects, and
the time it takes over them. The order changes what is computed for a document, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import Scratch, fresh

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: Words in a window that may be repeated.
WINDOW = 5
#: Documents in the sample that costs and rejections are estimated on, about.
SAMPLE = 2_000
#: Times that a rule is timed; the least counts.
ROUNDS = 2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return _count(text, WORD)


def word_chars(text: Column) -> Column:
    return F.length(text).cast("long") - _count(text, SPACE)


def n_symbols(text: Column) -> Column:
    return _count(text, SYMBOL)


def _lines(text: Column) -> Column:
    """Lines, split at line feeds, that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier one."""
    return _let(_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words that stand in a window of WINDOW words which the text has twice or more.

    Windows are known by a 64-bit hash of the hashes of their words. Where no two are equal, which a hash set tells in one
    walk, that is all. Otherwise windows are sorted by hash, neighbours of equal hash are the repeated ones, and of their
    places in order each adds what reaches beyond the one before: n log n, with nothing compared pair by pair.
    """

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.when(F.size(h) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))

    def covered(w: Column) -> Column:
        by_hash = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s, x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        # beyond either end get() is null, and null or false is null, which filter leaves out
        places = _let(by_hash, lambda s: F.transform(F.filter(s, lambda x, i: twice(s, x, i)), lambda x: x["i"]))
        return _let(F.sort_array(places), lambda p: F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(WINDOW), F.get(p, i + 1) - x), F.lit(WINDOW))), F.lit(0), lambda a, b: a + b))

    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    repeated = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w))
    return F.coalesce(_let(_let(hashes, windows), repeated), F.lit(0)).cast("long")


def n_bare_words(text: Column) -> Column:
    """Words without a letter; a match can only begin where a word does, so a long one is gone through once."""
    return _count(text, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])")


def _only(text: Column, others: str) -> Column:
    """How many characters are left if runs of `others` go."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


#: The measures that rules may ask for, by name; each is a column made from the text.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_lines": lambda text: F.size(_lines(text)).cast("long"),
    "n_bare_words": n_bare_words,
    "n_letters": lambda text: _only(text, r"\P{L}+"),
    "n_capitals": lambda text: _only(text, r"\P{Lu}+"),
    "n_bullets": lambda text: _count(text, r"(?md)^[\x20\x09]*[-*\u2022]\x20"),
}

#: Rules by name: the measures that each asks for, and the condition on them under which it rejects. Measures are whole
#: numbers and so are the bounds, so that any engine decides alike.
RULES: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "few_words": (("n_words",), lambda n: n < 10),
    "repeated_words": (("n_repeat_words", "n_words"), lambda r, n: 100 * r > 20 * n),
    "word_length": (("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 15 * n)),
    "symbols": (("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    "duplicate_lines": (("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 3 * n),
    "words_without_letters": (("n_bare_words", "n_words"), lambda b, n: 10 * b > 3 * n),
    "capitals": (("n_capitals", "n_letters"), lambda u, n: 2 * u > n),
    "bullets": (("n_bullets", "n_lines"), lambda b, n: 10 * b > 9 * n),
}
#: The rules whose verdict is the base one, and the measures that every document's row has.
BASE = ("few_words", "repeated_words")
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _rejects(name: str, text: Column, known: dict[str, Column]) -> Column:
    """Whether a rule rejects a text; measures that are there already are not made again."""
    measures, condition = RULES[name]
    values = F.struct(*[(known[m] if m in known else MEASURES[m](text)).alias(m) for m in measures])
    return _let(values, lambda v: condition(*[v[m] for m in measures]))


def estimate(docs: DataFrame, text_col: str = "text", names: tuple[str, ...] = tuple(RULES), given: tuple[str, ...] = (), sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) of each rule on about `sample` documents, chosen by a hash of the text.

    A rule's time is that of one job that asks it of the whole sample, less that of one that reads the sample only; the
    least of ROUNDS. Measures named in `given` are there whatever the rules ask for, so they cost nothing. An empty sample
    gives no rejections.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = min(1.0, sample / max(1, texts.count()))
    chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    rows = scratch.keep(texts.where(chosen).select("text", *[MEASURES[m](F.col("text")).alias(m) for m in given]))

    def ask(condition: Column) -> tuple[float, float]:
        took, rejected = float("inf"), 0.0
        for _ in range(ROUNDS):
            began = time.perf_counter()
            rejected = rows.select(F.avg(condition.cast("int"))).first()[0] or 0.0
            took = min(took, time.perf_counter() - began)
        return took, rejected

    reading, _ = ask(F.length("text") < 0)
    out = []
    for name in names:
        took, rejected = ask(_rejects(name, F.col("text"), {m: F.col(m) for m in given}))
        out.append((name, max(took - reading, 1e-4), rejected))
    scratch.drop(rows)
    return out


def ordered(estimates: list[tuple[str, float, float]]) -> list[str]:
    """Rules by rejection per cost, the greatest first; ties by name."""
    return [name for name, *_ in sorted(estimates, key=lambda e: (-e[2] / e[1], e[0]))]


def verdict(text: Column, order: list[str], known: dict[str, Column] | None = None) -> Column:
    """Whether no rule rejects the text: rules are asked in `order`, and those after the first that rejects are not asked."""
    out = None
    for name in order:
        rejects = _rejects(name, text, known or {})
        out = F.when(rejects, False) if out is None else out.when(rejects, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), order: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each row of `docs`.

    kept: neither the base rules nor any other of RULES rejects the document; the others form the cascade, in `order` or in
    the order that a sample suggests. A null text has no words. Null and repeated ids are kept as they are; an empty table
    gives an empty result. `carry` names columns of `docs` to keep beside, none called like one of the result.
    """
    kept = [c for c in carry if c != id_col]
    others = tuple(r for r in RULES if r not in BASE)
    if order is None:
        order = ordered(estimate(docs, text_col, others, BASE_MEASURES))
    text = fresh(docs, "whole")
    rows = docs.select(F.col(id_col).alias("doc_id"), *kept, F.coalesce(F.col(text_col), F.lit("")).alias(text))
    # one struct, so that every measure is made once and the cascade reads it from there
    made = fresh(rows, "made")
    rows = rows.withColumn(made, F.struct(*[MEASURES[m](F.col(text)).alias(m) for m in BASE_MEASURES]))
    known = {m: F.col(made).getField(m) for m in BASE_MEASURES}
    failed = _rejects(BASE[0], F.col(text), known) | _rejects(BASE[1], F.col(text), known)
    return rows.select("doc_id", *kept, *[known[m].alias(m) for m in BASE_MEASURES], failed.alias("base_failed"), F.when(failed, False).otherwise(verdict(F.col(text), order, known)).alias("kept"))
