"""Writers: snapshots that are swapped in, upserts, append-only history, failure logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.operators.entities import upsert

c = F.col


def write_documents(docs: DataFrame, path: str) -> None:
    """JSON lines, a document a line, nulls left out."""
    docs.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


class Snapshots:
    """A table kept as numbered snapshots in a folder; the newest that was finished is the table.

    A snapshot is written to a new folder first and renamed when it is whole, so readers never see half of one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def newest(self) -> str | None:
        if not self.fs.exists(self.path(self.root)):
            return None
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(self.root)))
        done = [n for n in names if n.startswith("v")]
        return f"{self.root}/{done[-1]}" if done else None

    def read(self) -> DataFrame | None:
        path = self.newest()
        return self.spark.read.parquet(path) if path else None

    def replace(self, df: DataFrame) -> None:
        """Write `df` as the next snapshot; an error if another writer has made that one in the meantime.

        Renaming a folder is atomic on HDFS and local disks. Object stores have no such rename; keep snapshots elsewhere
        there, or in a table format with commits of its own.
        """
        newest = self.newest()
        number = int(newest.rpartition("/v")[2]) + 1 if newest else 0
        part, final = f"{self.root}/_{uuid.uuid4().hex}", f"{self.root}/v{number:010d}"
        df.write.parquet(part)
        if self.fs.exists(self.path(final)) or not self.fs.rename(self.path(part), self.path(final)):
            self.fs.delete(self.path(part), True)
            raise RuntimeError(f"{final} was written by someone else")

    def merge(self, new: DataFrame, key: str, removed: DataFrame | None = None) -> None:
        """Upserts `new`, after taking out the keys of `removed`."""
        old = self.read()
        if old is None:
            return self.replace(new)
        if removed is not None:
            old = old.join(removed.select(key), key, "left_anti")
        self.replace(upsert(old, new, key))


def append_history(listings: DataFrame, path: str) -> None:
    """Appends listings, partitioned by the day they were read."""
    listings.withColumn("day", F.to_date("scraped_at")).write.mode("append").partitionBy("day").parquet(path)


def log_failures(failed: DataFrame, stage: str, path: str) -> None:
    """Appends (id, stage, error, at) as JSON lines."""
    failed.select("id", F.lit(stage).alias("stage"), "error", F.current_timestamp().alias("at")).write.mode("append").json(path)


def write_array(rows: DataFrame, path: str, indent: bool = False) -> None:
    """One JSON array in one file, for readers that take nothing else; for small tables, as one task writes it."""
    body = rows.select(F.to_json(F.struct("*"), {"pretty": str(indent).lower()}).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("j")), ",\n"), F.lit("]")).alias("value"))
    body.coalesce(1).write.mode("overwrite").text(path)


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """The records of files that hold one JSON array each; any other root is an error."""
    files = spark.read.text(path, wholetext=True)
    wrong = files.where(~F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("ARRAY")), F.lit(False)))
    if bad := wrong.select("_metadata.file_path").take(1):
        raise ValueError(f"{bad[0][0]} does not hold a list of records")
    return spark.read.option("multiLine", True).json(path)


def write_result(products: DataFrame, errors: DataFrame, path: str) -> None:
    """A scrape's products, and its errors in a folder of their own beside them, only if there are any."""
    products.write.mode("overwrite").json(path)
    if not errors.isEmpty():
        errors.write.mode("overwrite").json(f"{path}.errors")


def checked(rows: DataFrame, error: Column, on_error: str = "raise") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and (all columns, error) of the others; with "raise", one such row stops the job.

    `error` is null for a good row. Nothing is lost: with "skip" the caller has the bad rows to write.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError(f"unknown policy {on_error!r}")
    marked = rows.withColumn("error", error)
    if on_error == "raise":
        return marked.where(F.assert_true(c("error").isNull(), F.coalesce("error", F.lit(""))).isNull()).drop("error"), marked.limit(0)
    return marked.where("error is null").drop("error"), marked.where("error is not null")

