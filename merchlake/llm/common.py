"""Helpers shared by the operators: scratch tables on shared storage, names, hashing, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows in one Arrow batch, about; texts may be long.
BATCH_BYTES = 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables: spark.checkpoint.dir of the session; a local one only where that is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="merchlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; `drop` removes one as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write `df` as Parquet and return it reread: it is computed once and survives lost executors."""
        self.count += 1
        path = f"{self.path}/{label}-{self.count}"
        df.write.parquet(path, compression="zstd")
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def free(self) -> None:
        """Let Spark delete the shuffle files of data frames that are no longer referred to, without waiting for memory to run short."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; the same bound for every operator, so it does not matter which one set it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or `name` with underscores before it until no column of `df` is called that (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by repeated contraction, all of it distributed.

    `edges` has columns a and b of one type (rows with nulls or a = b add nothing; repeated rows are fine).
    In each round every node takes the name of its least neighbour, or keeps its own if that is less; edges are
    renamed, loops and repeats go. "Least" is by a hash salted with the round, so that long chains shrink by a
    constant factor. Returns (node, root) for every node that has an edge; nodes of a component share the root.
    Counts and minima are combined before each shuffle, and no round gathers a component in one task.
    """
    live = edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = scratch.keep(live, "edges")
    names = None
    for n in range(max_rounds):
        if live.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(n), c).alias("h"), c.alias("v"))
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank(F.col("a"))).getField("v").alias("to"))
        step = scratch.keep(step, "step")
        a, b = (step.select(F.col("node").alias(k), F.col("to").alias(f"t{k}")) for k in "ab")
        moved = live.join(a, "a").join(b, "b").where("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        old, live = live, scratch.keep(moved, "edges")
        scratch.drop(old)
        if names is None:
            names = step.select("node", F.col("to").alias("root"))
            names.scratch_path = step.scratch_path
        else:
            hop = step.select(F.col("node").alias("root"), "to")
            old, names = names, scratch.keep(names.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "names")
            scratch.drop(old, step)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    scratch.drop(live)
    if names is None:
        kind = edges.schema["a"].dataType
        return spark.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    return names
