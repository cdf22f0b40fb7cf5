"""Tables that change together: laid out in buckets of their keys, of which a batch rewrites those that it touches.

A batch writes new files beside the old ones, and then one small log entry that names the files of every bucket of every
table, and the batch. Renaming that entry into place is the commit of all tables at once; a batch that dies before it has
changed nothing, and one that comes again after it is known by its number and left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from merchlake.operators.ingest import numbered
from merchlake.operators.sinks import Snapshots
from merchlake.sources.scratch import kept

c = F.col
#: What the log says: the files of a bucket (or, without one, appended files), a table's columns, the last batch of a source.
LOG = "kind string, name string, bucket int, value string"


class Tables:
    """The tables under `root`. Those with a key have `buckets` buckets each; choose as many as keep a bucket within a task's memory.

    The log has a row for each bucket, and for each appended part until `compact`, so the driver can read it whole.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.log = Snapshots(spark, f"{self.root}/log")

    def _state(self) -> list[tuple]:
        df = self.log.read()
        return [] if df is None else [tuple(r) for r in df.collect()]

    def parts(self, table: str) -> dict[int | None, list[str]]:
        """The folders of each bucket of a table as it is now; appended ones under None."""
        out: dict[int | None, list[str]] = {}
        for kind, name, bucket, value in self._state():
            if kind == "part" and name == table:
                out.setdefault(bucket, []).append(value)
        return out

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table as it is now, or some of its buckets; null if no batch has had it."""
        state = self._state()
        schema = next((StructType.fromJson(json.loads(v)) for kind, name, _, v in state if kind == "columns" and name == table), None)
        if schema is None:
            return None
        paths = [v for kind, name, bucket, v in state if kind == "part" and name == table and (buckets is None or bucket in buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def last(self, source: str) -> int:
        """The number of the last batch of a source that was committed; -1 before the first."""
        return max([int(v) for kind, name, _, v in self._state() if kind == "batch" and name == source], default=-1)

    def bucketed(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))

    def commit(self, source: str, number: int, upserts: dict[str, tuple[DataFrame, str]] | None = None, removed: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None, written: tuple[str, ...] = ()) -> bool:
        """Applies batch `number` of `source` to all tables at once; false, and nothing, if it has been applied before.

        `upserts` has for each table its new rows and the name of its key: rows of that key are replaced. `removed` has
        keys whose rows go, for tables that `upserts` names. `appended` has rows that are added to tables without a key.
        Rows are read from the files once they are written, so a table may be computed from its own state; new rows of the
        tables that `written` names are read from files already, and are not written twice. Null keys are a key like any other.
        """
        if self.last(source) >= number:
            return False
        state, folder = self._state(), f"{self.root}/data/{uuid.uuid4().hex}"
        columns = {name: v for kind, name, _, v in state if kind == "columns"}
        parts = [x for x in state if x[0] == "part"]
        for table, (rows, key) in (upserts or {}).items():
            columns.setdefault(table, rows.schema.json())
            schema = StructType.fromJson(json.loads(columns[table]))
            new = self.bucketed(rows.select(*schema.names), key)
            new = new if table in written else kept(new)
            keys = new.select("_bucket", key)
            if removed and table in removed:
                keys = keys.unionByName(self.bucketed(removed[table].select(key), key))
            keys = kept(keys.distinct())
            touched = sorted(r[0] for r in keys.select("_bucket").distinct().collect())
            if not touched:
                continue
            old = [v for _, name, bucket, v in parts if name == table and bucket in touched]
            if old:
                before = self.bucketed(self.spark.read.schema(schema).parquet(*old), key)
                same = keys.select(c("_bucket").alias("_b"), c(key).alias("_k"))
                new = before.join(same, (c("_bucket") == c("_b")) & c(key).eqNullSafe(c("_k")), "left_anti").unionByName(new)
            self._dealt(new, key).write.partitionBy("_bucket").parquet(f"{folder}/{table}")
            full = {r[0] for r in self._written(f"{folder}/{table}")}
            parts = [x for x in parts if x[1] != table or x[2] not in touched]
            parts += [("part", table, b, f"{folder}/{table}/_bucket={b}") for b in sorted(full)]
        for table, rows in (appended or {}).items():
            columns.setdefault(table, rows.schema.json())
            rows.write.parquet(f"{folder}/{table}")
            parts.append(("part", table, None, f"{folder}/{table}"))
        batches = {name: v for kind, name, _, v in state if kind == "batch"} | {source: str(number)}
        entries = parts + [("columns", n, None, v) for n, v in columns.items()] + [("batch", n, None, v) for n, v in batches.items()]
        self.log.replace(self.spark.createDataFrame(entries, LOG).coalesce(1))
        return True

    def _dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows in as many parts as Spark shuffles to, buckets in their order: several to a part, or a bucket in several by a hash of the key. No row is read to find borders."""
        parts, share = int(self.spark.conf.get("spark.sql.shuffle.partitions")), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 20)) / float(1 << 20)
        return rows.repartitionById(parts, F.floor((c("_bucket") + share) * (parts / self.buckets)).cast("int"))

    def _written(self, path: str) -> list[tuple[int]]:
        fs, p = self.log.fs, self.log.path
        names = [s.getPath().getName() for s in fs.listStatus(p(path))] if fs.exists(p(path)) else []
        return [(int(n.partition("=")[2]),) for n in names if n.startswith("_bucket=")]

    def compact(self, table: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """Rewrites the parts of an appended table as one, as `change` makes it; a commit of its own, so readers see the old parts or the new one."""
        state = self._state()
        mine = [x for x in state if x[0] == "part" and x[1] == table and x[2] is None]
        if len(mine) > 1:
            path, rows = f"{self.root}/data/{uuid.uuid4().hex}/{table}", self.read(table)
            change(rows).select(*rows.columns).write.parquet(path)
            self.log.replace(self.spark.createDataFrame([x for x in state if x not in mine] + [("part", table, None, path)], LOG).coalesce(1))

    def expire(self, keep: int = 2, older_s: float = 86_400) -> int:
        """Deletes log entries but the newest `keep`, and folders that none of these names; returns how many folders went.

        Folders younger than `older_s` seconds stay, as a batch that is being written has not named its own yet.
        """
        fs, p = self.log.fs, self.log.path
        entries = sorted(s.getPath().getName() for s in fs.listStatus(p(f"{self.root}/log")) if s.getPath().getName().startswith("v"))
        for name in entries[:-keep]:
            fs.delete(p(f"{self.root}/log/{name}"), True)
        named = {r["value"].removeprefix(f"{self.root}/data/").split("/")[0] for name in entries[-keep:] for r in self.spark.read.parquet(f"{self.root}/log/{name}").where("kind = 'part'").select("value").collect()}
        now = self.spark.sparkContext._jvm.System.currentTimeMillis()
        gone = [s.getPath() for s in fs.listStatus(p(f"{self.root}/data")) if s.getPath().getName() not in named and now - s.getModificationTime() >= older_s * 1000]
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def each_batch(tables: Tables, source: str, apply: Callable[[DataFrame], dict]) -> Callable[[DataFrame, int], None]:
    """What `foreachBatch` of a stream takes: every batch is committed once, however often it is run.

    `apply` makes of a batch the arguments of `Tables.commit`, by name.
    """

    def run(batch: DataFrame, number: int) -> None:
        if tables.last(source) < number:
            tables.commit(source, number, **apply(batch))

    return run


def import_listings(tables: Tables, source: str, number: int, listings: DataFrame) -> bool:
    """A scrape's listings into the normalised tables: stores and models are found or created, variants upserted, listings appended.

    All four change in one commit; the same batch again changes nothing. `listings` has store, brand, model, variant_key,
    price, in_stock, product_url, scraped_at.
    """
    if tables.last(source) >= number:
        return False
    spark = tables.spark
    rows = kept(listings)
    old = lambda name, schema: df if (df := tables.read(name)) is not None else spark.createDataFrame([], schema)
    stores, models = old("stores", "name string, store_id long"), old("models", "brand string, model string, model_id long")
    all_stores = kept(numbered(stores, rows.select(c("store").alias("name")), ["name"], "store_id"))
    all_models = kept(numbered(models, rows.select("brand", "model"), ["brand", "model"], "model_id"))
    created = lambda every, before, key: every.join(before.select(key), key, "left_anti")
    variants = rows.select("variant_key", "brand", "model").distinct().join(all_models, ["brand", "model"]).groupBy("variant_key").agg(F.min("model_id").alias("model_id"))
    facts = rows.join(all_stores.withColumnRenamed("name", "store"), "store").select("variant_key", "store_id", "price", "in_stock", "product_url", "scraped_at")
    upserts = {"stores": (created(all_stores, stores, "store_id"), "store_id"), "models": (created(all_models, models, "model_id"), "model_id"), "variants": (variants, "variant_key")}
    return tables.commit(source, number, upserts, appended={"listings": facts})
