"""Listings as a stream: arrival of files, each event once, windows, and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from merchlake.operators.entities import content_hash, diff, keep_first
from merchlake.operators.ingest import doc_hash, to_embed
from merchlake.operators.isolation import embedded
from merchlake.operators.sinks import Snapshots
from merchlake.sources.scratch import kept


def arrivals(spark: SparkSession, path: str, schema: StructType, time: str) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder, with `time` as a timestamp in UTC."""
    return spark.readStream.schema(schema).parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def each_once(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows whose key has not come before, within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, value: str, key: str, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums of each key in tumbling windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends all that is there now to a Parquet folder, and ends."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(batch: DataFrame, table: Snapshots, manifest: Snapshots, key: str, stable: list[str], document: Column | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, vectors: Snapshots | None = None) -> DataFrame:
    """Applies one batch of products: only what changed is written; returns (status, n).

    The manifest has a hash of each product's stable columns, and of its document if that is given; a product is updated
    if either differs. Of rows with the same key the one with the least hash stays. Products that are no longer in the
    batch are removed. With `embed`, a function of (key, text), documents whose hash changed are embedded into `vectors`,
    and those of removed products are deleted there; no others are embedded. Where it fails, the documents that it cannot
    take are found and counted as not_embedded; their hash is left out of the manifest, so the next run tries them again.
    A second run of the same batch finds everything else unchanged and writes nothing, so it can follow a failed run.
    """
    text = F.lit(None).cast("string") if document is None else document
    hashed = batch.withColumns({"content_hash": content_hash(*stable), "doc_text": text}).withColumn("doc_hash", doc_hash(F.col("doc_text")))
    hashed = kept(keep_first(hashed, [key], [F.col("content_hash"), F.col("doc_hash")]))
    old = manifest.read()
    new_manifest = hashed.select(key, "content_hash", "doc_hash")
    status = diff(old, new_manifest, key, ["content_hash", "doc_hash"]) if old is not None else new_manifest.select(key, F.lit("added").alias("status"))
    counts = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if set(counts) - {"unchanged"}:
        removed = status.where("status = 'removed'").select(key)
        changed = hashed.join(status.where("status in ('added', 'updated')").select(key), key, "left_semi")
        table.merge(changed.select(*batch.columns), key, removed=removed)
        if embed is not None and vectors is not None:
            known = old.select(key, "doc_hash") if old is not None else new_manifest.select(key, "doc_hash").limit(0)
            todo, gone = to_embed(hashed.select(key, F.col("doc_text").alias("text")), known, key)
            made, failed = embedded(todo.select(key, "text"), key, embed)
            if made is None:
                made = vectors.read()
                made = None if made is None else made.limit(0)
            if made is not None:
                vectors.merge(made, key, removed=gone)
            if n := failed.count():
                counts["not_embedded"] = n
                without = F.when(F.col("error").isNull(), F.col("doc_hash")).alias("doc_hash")
                new_manifest = new_manifest.join(failed, key, "left").select(key, "content_hash", without)
        manifest.replace(new_manifest)
    return batch.sparkSession.createDataFrame(sorted(counts.items()), "status string, n long")
