"""Tables that are used more than once in a job, written to the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder only where that is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="merchlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """`df`, written once and reread; it survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt to all cores where it is read from fewer files than there are cores; larger tables have a file or more for each."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def fresh_root(spark: SparkSession, name: str) -> str:
    """A folder of its own for the tables of an index."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
