"""As-of join: for each request the row of a history that was valid at its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def as_of(requests: DataFrame, history: DataFrame, keys: list[str], at: str, time: str, values: list[str], width_s: int = 30 * 86_400, ties: list[str] | None = None) -> DataFrame:
    """`requests` with the `values` and `time` of the last row of `history` with the same `keys` whose `time` is not after `at`.

    Both are dealt to time buckets of `width_s` seconds, and run through together within a key and bucket; what a bucket
    begins with is the last row of the buckets before, of which there is one row each. So a key's whole history is never
    in one window, however long it is. Of rows of a key and time the last by `ties` is valid. Requests with no such row,
    or with a null in a key or in `at`, get nulls; history rows with nulls there are never valid. Repeated requests stay.
    """
    ties = ties or []
    mark = lambda df, t: df.withColumns({"_at": F.unix_micros(t.cast("timestamp")), "_known": F.lit(False) if df is requests else F.lit(True)})
    asked = F.struct(*requests.columns)
    valid = F.struct(c(time).alias(time), *[c(v) for v in values])
    r = mark(requests, c(at)).select(*keys, "_at", "_known", asked.alias("_asked"), F.lit(None).cast(_kind(history, valid)).alias("_valid"), F.array().cast("array<string>").alias("_ties"))
    usable = c(time).isNotNull() & _all_there(keys)
    h = mark(history.where(usable), c(time)).select(*keys, "_at", "_known", F.lit(None).cast(_kind(requests, asked)).alias("_asked"), valid.alias("_valid"), F.array(*[F.lpad(c(t).cast("string"), 40, " ") for t in ties]).cast("array<string>").alias("_ties"))
    rows = r.unionByName(h).withColumn("_bucket", F.floor(c("_at") / (width_s * 1_000_000)))

    within = Window.partitionBy(*keys, "_bucket").orderBy("_at", F.desc("_known"), "_ties").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_here", F.last("_valid", ignorenulls=True).over(within))
    buckets = rows.groupBy(*keys, "_bucket").agg(F.max_by("_valid", F.when(c("_known"), F.struct("_at", "_ties"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*[c(k).alias(f"_{k}") for k in keys], c("_bucket").alias("_b"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    same = [c(k).eqNullSafe(c(f"_{k}")) for k in keys] + [c("_bucket").eqNullSafe(c("_b"))]
    found = rows.where(~c("_known")).join(carried, _every(same), "left")
    result = F.when(_all_there([*keys, "_at"]), F.coalesce("_here", "_carried"))
    found = found.select("_asked", result.alias("_r"))
    return found.select("_asked.*", *[c(f"_r.{n}").alias(n) for n in (time, *values)])


def _kind(df: DataFrame, column: Column) -> str:
    return df.select(column.alias("x")).schema["x"].dataType.simpleString()


def _all_there(names: list[str]) -> Column:
    return _every([c(n).isNotNull() for n in names])


def _every(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out
