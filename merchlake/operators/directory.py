"""A sorted list for deep pages: written in ranges of its order, with how many rows of each kind every range has.

A page begins at some row; the counts say in which range that is, so one reads that range, and the next where the page
goes over its end, instead of sorting all that comes before.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
#: Rows in a range, about.
RANGE = 65_536


def write(rows: DataFrame, path: str, order: list[Column], kinds: list[str] | None = None, size: int = RANGE) -> None:
    """Writes `rows` in ranges of `order`, which must tell any two rows apart, and the directory: rows of each range by `kinds`.

    `kinds` are columns that a page may ask to be equal to something, such as the brand; the directory has a row for each of
    their combinations in each range.
    """
    ranges = max(1, math.ceil(rows.count() / size))
    placed = rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    placed.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    counts = written.groupBy("_range", *(kinds or [])).agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/directory")
    rows.sparkSession.createDataFrame([(json.dumps({"kinds": kinds or [], "schema": json.loads(placed.schema.json())}),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def page(spark: SparkSession, path: str, order: list[Column], number: int, size: int, **wanted: object) -> DataFrame:
    """Page `number` (from 1, of 1 to 100 rows) of the rows whose columns are as `wanted` says, with total and total_pages on each.

    `order` and the columns of `wanted` are those the list was written for. What comes back from the directory to the
    driver is a count for each range.
    """
    from pyspark.sql.types import StructType

    number, size = max(1, number), min(100, max(1, size))
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if unknown := set(wanted) - set(about["kinds"]):
        raise ValueError(f"the list was not written for {sorted(unknown)}")
    condition = F.lit(True)
    for name, value in wanted.items():
        condition = condition & c(name).eqNullSafe(F.lit(value))
    counts = spark.read.parquet(f"{path}/directory").where(condition).groupBy("_range").agg(F.sum("n").alias("n")).orderBy("_range").collect()
    total, first = sum(r["n"] for r in counts), (number - 1) * size
    before, held, skip = 0, [], 0
    for r in counts:
        if before + r["n"] > first and before < first + size:
            skip = skip if held else first - before
            held.append(r["_range"])
        before += r["n"]
    rows = spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{path}/rows").where(c("_range").isin(held)).where(condition)
    out = rows.orderBy(*order).offset(skip).limit(size).drop("_range")
    return out.withColumns({"total": F.lit(total).cast("long"), "total_pages": F.lit(max(1, -(-total // size))).cast("long")})
