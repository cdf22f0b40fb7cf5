"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio. No Python on the executors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import fresh

# The kinds of base spans in their order, with patterns and the least length that counts.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: What the models judge: long runs of characters that keys are written in.
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Documents that samples are taken from, at most: of random strings, and of ordinary identifiers.
SECRET_DOCS, IDENTIFIER_DOCS = 50_000, 4_000
#: A candidate is reported if its log-likelihood ratio is at least TOTAL nats and PER_PAIR nats for each pair of characters.
TOTAL, PER_PAIR = 12.0, 0.5
_BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _starts(lengths: Column) -> Column:
    """Sums of all lengths before each one; by blocks, so the work stays far below the square of their number."""

    def blocks(ls: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / _BLOCK).cast("int"))
        sums = F.transform(numbers, lambda b: _sum(F.slice(ls, b * _BLOCK + 1, F.lit(_BLOCK))))
        firsts = _let(sums, lambda s: F.transform(numbers, lambda b: _sum(F.slice(s, F.lit(1), b))))

        def within(b: Column, first: Column) -> Column:
            part = F.slice(ls, b * _BLOCK + 1, F.lit(_BLOCK))
            return _let(part, lambda p: F.transform(p, lambda _, i: first + _sum(F.slice(p, F.lit(1), i))))

        return _let(firsts, lambda f: F.flatten(F.transform(numbers, lambda b: within(b, F.get(f, b)))))

    return _let(lengths, blocks)


def _spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of structs of start, kind and end, in code points.

    Where `least` is above 0, matches whose group 2 is shorter are dropped after matching.
    The texts between matches, and the matches, have lengths that add up to where each match starts.
    """
    gap_and_match = lambda gaps, found: F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("len")))

    def located(pairs: Column) -> Column:
        return F.zip_with(pairs, _starts(F.transform(pairs, lambda p: p["gap"] + p["len"])), lambda p, s: F.struct((s + p["gap"]).alias("start"), F.lit(kind).alias("kind"), (s + p["gap"] + p["len"]).alias("end")))

    everything = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    out = _let(everything, lambda found: F.when(F.size(found) > 0, _let(gap_and_match(F.split(text, pattern, -1), found), located)))
    if least:
        long_enough = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.length(v) >= least)
        kept = F.filter(F.arrays_zip(out.alias("span"), long_enough.alias("ok")), lambda z: z["ok"])
        out = F.when(F.regexp_count(text, F.lit(pattern)) > 0, F.transform(kept, lambda z: z["span"]))
    return F.coalesce(out, F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))


def samples(docs: DataFrame, text_col: str = "text", secret_docs: int = SECRET_DOCS, identifier_docs: int = IDENTIFIER_DOCS) -> DataFrame:
    """Labelled samples (token, label) from documents chosen by a hash of the text, at most about the given numbers.

    Label 1, random strings: what the base patterns find (of assignments, the value). Label 0, ordinary identifiers:
    runs of letters, digits and underscores of 6 or more that begin with a letter and that no base pattern matches.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    n = max(1, rows.count())
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    every = lambda pattern, group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    values = F.concat(F.filter(every(ASSIGN, 2), lambda v: F.length(v) >= ASSIGN_LEAST), every(ACCESS, 0), every(HEX, 0))
    secret = rows.where(chance < min(1.0, secret_docs / n)).select(F.explode(values).alias("token"), F.lit(1).alias("label"))
    words = F.filter(every(r"\b[A-Za-z][A-Za-z0-9_]{5,}", 0), lambda w: ~w.rlike(f"{HEX}|{ACCESS}"))
    plain = rows.where(chance < min(1.0, identifier_docs / n)).select(F.explode(words).alias("token"), F.lit(0).alias("label"))
    return secret.unionByName(plain)


def learn(labelled: DataFrame) -> list[float]:
    """The table of log-likelihood ratios of one character after another, from labelled samples (token, label).

    One row and column for each character of ALPHABET, and one for all others. Counts of pairs are made by Spark; at
    most two for each cell come back. Cells are smoothed by one; without samples every ratio is 0. Null tokens and
    other labels teach nothing.
    """
    k = len(ALPHABET) + 1
    chars = F.regexp_extract_all("token", F.lit("(?s)."), F.lit(0))
    pairs = _let(chars, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    rows = labelled.where("label in (0, 1) and length(token) > 1").select("label", F.explode(pairs).alias("p"))
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    counted = rows.groupBy("label", "p.a", "p.b").count().groupBy("label", code(F.col("a")).alias("a"), code(F.col("b")).alias("b")).agg(F.sum("count").alias("n"))
    seen = [[[1.0] * k for _ in range(k)] for _ in range(2)]
    for r in counted.collect():
        seen[r["label"]][r["a"]][r["b"]] += r["n"]
    share = [[[x / sum(row) for x in row] for row in table] for table in seen]
    return [math.log(share[1][a][b] / share[0][a][b]) for a in range(k) for b in range(k)]


def ratio(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token, random against ordinary; its characters are looked up once each."""
    k = len(ALPHABET) + 1
    cells = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    codes = F.transform(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c))
    step = lambda c, acc, i: acc + F.get(cells, F.get(c, i - 1) * k + F.get(c, i))
    walk = lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda acc, i: step(c, acc, i))
    return _let(codes, walk)


def _outside(span: Column, base: Column) -> Column:
    """What sorted base spans that overlap a span leave of it, as spans of kind 3 with LEAST characters or more."""
    ends = F.transform(base, lambda b: b["end"])
    begin = F.concat(F.array(span["start"]), F.transform(ends, lambda _, i: F.array_max(F.slice(ends, F.lit(1), i + 1))))
    stop = F.concat(F.transform(base, lambda b: b["start"]), F.array(span["end"]))
    return F.filter(F.zip_with(begin, stop, lambda a, b: F.struct(a.alias("start"), F.lit(3).alias("kind"), b.alias("end"))), lambda p: p["end"] - p["start"] >= LEAST)


def find(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Secrets of each row of `docs`: doc_id, base and spans (arrays of structs of start, kind and end).

    base: what the fixed patterns find. spans: those and, as kind 3, candidates, or what base spans leave of them if that is
    LEAST characters or more, that the Markov models of `table` find random; both sorted by start, then kind. Positions are code points, ends exclusive.
    `carry` names columns of `docs` to keep beside, none of them called like one of the result; others play no part. Null texts count as empty and have no spans.
    Null and repeated ids are kept as they are; an empty table gives an empty result.
    """
    kept = [c for c in carry if c != id_col]
    text, base, extra = (fresh(docs, n) for n in ("whole", "base", "random"))
    rows = docs.select(F.col(id_col).alias("doc_id"), *kept, F.coalesce(F.col(text_col), F.lit("")).alias(text))
    t = F.col(text)
    rows = rows.withColumn(base, F.array_sort(F.concat(_spans(t, ASSIGN, 0, ASSIGN_LEAST), _spans(t, ACCESS, 1), _spans(t, HEX, 2))))
    value = lambda s: F.substring(t, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    is_random = lambda s: _let(ratio(value(s), table), lambda r: (r >= TOTAL) & (r >= PER_PAIR * (s["end"] - s["start"] - 1)))
    own = lambda s: _let(F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), lambda bs: _outside(s, bs))
    rows = rows.withColumn(extra, F.filter(F.flatten(F.transform(_spans(t, CANDIDATE, 3), own)), is_random))
    return rows.select("doc_id", *kept, F.col(base).alias("base"), F.array_sort(F.concat(base, extra)).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of (perhaps overlapping) sorted spans replaced by `mark`; a null text stays null."""
    part = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["pos"], s["end"]).alias("pos"),
        F.when((s["start"] >= acc["pos"]), F.concat(acc["out"], part(acc["pos"], s["start"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
    )
    done = lambda acc: F.concat(acc["out"], part(acc["pos"], F.length(text).cast("long")))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, done))
