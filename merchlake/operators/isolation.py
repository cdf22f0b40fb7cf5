"""Runs a step over a batch so that rows it cannot take are found, and cost the others nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.sources.scratch import kept

c = F.col


def message(error: Exception) -> str:
    text = str(error)
    return f"{type(error).__name__}: {text.splitlines()[0] if text else ''}"[:200]


def halved(rows: DataFrame, key: str, run: Callable[[DataFrame], DataFrame], tries: int = 64, strict: bool = False) -> tuple[list[tuple[DataFrame, DataFrame]], list[tuple[DataFrame, str]]]:
    """`run` of all rows at once; where that fails, of halves by a hash of `key`, down to single rows or until `tries` runs are used up.

    Returns pairs of rows and what was made of them, written, and pairs of rows that failed and why. One bad row among n
    costs about twice the logarithm of n runs; a step that always fails costs `tries`. With `strict` the first failure is raised.
    """
    done, failed, parts, used = [], [], [(kept(rows), 0)], 0
    while parts:
        part, depth = parts.pop()
        used += 1
        try:
            done.append((part, kept(run(part))))
        except Exception as e:  # noqa: BLE001  a step may fail in any way
            if strict:
                raise
            if used + len(parts) + 2 > tries or part.limit(2).count() < 2:
                failed.append((part, message(e)))
            else:
                half = F.pmod(F.xxhash64(key, F.lit(depth)), F.lit(2))
                parts += [(kept(part.where(half == i)), depth + 1) for i in (0, 1)]
    return done, failed


def embedded(documents: DataFrame, key: str, embed: Callable[[DataFrame], DataFrame], tries: int = 64) -> tuple[DataFrame | None, DataFrame]:
    """Vectors of documents (key, text) by `embed`, and (key, error) of those that it could not take; null if it took none."""
    done, failed = halved(documents, key, embed, tries)
    errors = documents.select(key).limit(0).withColumn("error", F.lit(""))
    for part, why in failed:
        errors = errors.unionByName(part.select(key, F.lit(why).alias("error")))
    vectors = None
    for _, made in done:
        vectors = made if vectors is None else vectors.unionByName(made)
    return vectors, errors
