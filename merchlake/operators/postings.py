"""A written index of sparse vectors, searched from its most promising blocks on until nothing left can matter; exact.

Documents of like length and like strongest bucket share a cell. Of each cell and bucket the index has a row: the greatest
and least weight there, and the documents that have the bucket with their weights. The first two, a small part of the
index, bound what any document of a cell can score; only cells whose bound reaches the k-th best score so far are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
#: Documents in a cell, about; folders that buckets are dealt to.
CELL, PARTS = 64, 32
#: Cells that a query reads in its first rounds; after these all that may still matter.
ROUNDS = (2, 8, 32)
#: Scores are rounded to nine places, and sums differ in the last digits by their order: bounds within this count as reached.
MARGIN = 2e-9


def summary(v: Column) -> Column:
    """Where a document stands: by the number of its buckets, in steps of a half power of two, then by its strongest bucket."""
    step = F.floor(2 * F.log2(F.size(v).cast("double"))).cast("int")
    strongest = F.array_max(F.transform(v, lambda x: F.struct(F.abs(x["w"]).alias("w"), x["bucket"].alias("bucket"))))["bucket"]
    return F.struct(step.alias("step"), strongest.cast("int").alias("strongest"))


def write(vectors: DataFrame, path: str, key: str, cell: int = CELL) -> None:
    """Writes postings of (key, v), v being an array of structs of bucket and weight w, under `path`.

    Rows (bucket, cell, most, least, n, posts) in PARTS folders, in order of buckets and cells. Vectors are put in order by what
    `summary` says and cut into cells of about `cell`: a count for each summary, of which there are no more than buckets
    times some forty steps, says where its vectors begin, and a hash of the key where each stands among them. So
    nothing is sorted as a whole. `vectors` is read three times; callers write it first, with the summary as `s` if they have it.
    """
    v = vectors.where(F.size("v") > 0).select(key, "v", c("s") if "s" in vectors.columns else summary(c("v")).alias("s"))
    counted = v.groupBy("s").agg(F.count("*").alias("n"))
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    begins = counted.select("s", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    u = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    placed = v.join(F.broadcast(begins), "s").select(key, "v", F.floor((c("begin") + u * c("n")) / cell).alias("cell"))
    posts = placed.select(key, "cell", F.explode("v").alias("x")).select((c("x.bucket") % PARTS).alias("part"), c("x.bucket").alias("bucket"), "cell", F.struct(c(key).alias("key"), c("x.w").alias("w")).alias("post"))
    # dealt and sorted once by what makes a block: blocks are then runs of rows. Folders are of like size, so none is read to find borders
    tasks, share = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.pmod(F.xxhash64("cell"), F.lit(1 << 20)) / float(1 << 20)
    sorted_ = posts.repartitionById(tasks, F.floor((c("part") + share) * (tasks / PARTS)).cast("int")).sortWithinPartitions("part", "bucket", "cell")
    kind = dict(vectors.dtypes)[key]
    blocks = sorted_.select("part", "bucket", "cell", c("post.key").alias("key"), "post.w").mapInArrow(_blocks, f"part long, bucket long, cell long, most double, least double, n long, posts array<struct<key:{kind},w:double>>")
    blocks.write.mode("overwrite").partitionBy("part").parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of rows with equal bucket and cell, which may go on over batches."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        bucket, cell = rows["bucket"].to_numpy(), rows["cell"].to_numpy()
        first = np.append(0, np.flatnonzero((np.diff(bucket) != 0) | (np.diff(cell) != 0)) + 1)
        held = rows.slice(first[-1])
        if len(first) > 1:
            yield _block(rows.slice(0, first[-1]), first[:-1])
    if held is not None:
        yield _block(held, np.array([0]))


def _block(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    part, bucket, cell, key, w = (x.chunk(0) for x in rows.columns)
    at, begins, ws = pa.array(first), np.append(first, len(rows)), w.to_numpy()
    posts = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.StructArray.from_arrays([key, w], ["key", "w"]))
    out = [part.take(at), bucket.take(at), cell.take(at), pa.array(np.maximum.reduceat(ws, first)), pa.array(np.minimum.reduceat(ws, first)), pa.array(np.diff(begins), pa.int64()), posts]
    return pa.RecordBatch.from_arrays(out, ["part", "bucket", "cell", "most", "least", "n", "posts"])


def load(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """Written postings; `key_type` is that of the documents' keys."""
    return spark.read.schema(f"bucket long, cell long, most double, least double, n long, posts array<struct<key:{key_type},w:double>>, part long").parquet(path)


def of_buckets(postings: DataFrame, buckets: list[int]) -> DataFrame:
    """The postings of some buckets: other folders are not opened, and in these, files and row groups are passed over by their bounds."""
    return postings.where(c("part").isin(sorted({b % PARTS for b in buckets})) & c("bucket").isin(buckets))


def top(postings: DataFrame, asked: DataFrame, key: str, k: int, keep: Callable[[DataFrame], DataFrame], only: DataFrame | None = None, rounds: tuple[int, ...] = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The best `k` documents of each query by dot product, and how much of the index was read for it.

    `asked` has query_id, bucket, weight. Returns (query_id, key, score, rank) with rank from 0 and ties to the smaller key,
    and (query_id, postings_read, postings) with the postings of the query's buckets. Documents that share no bucket with
    a query are not found by it. With `only`, a table of keys, no others are. `keep` writes a table and returns it reread.

    A bound is the sum over the query's buckets of the most a document of the cell can get from each, nothing if it lacks
    the bucket. In each round a query reads its best unread cells that reach its k-th best score; in the last one, all of
    these. What is left then is below it, so the result is that of reading everything.
    """
    asked = keep(asked.select("query_id", "bucket", c("weight").alias("qw")))
    wanted = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # as many as there are buckets, at most
    lists = of_buckets(postings, wanted)
    most = F.greatest(c("qw") * c("most"), c("qw") * c("least"), F.lit(0.0))
    bounds = keep(lists.select("bucket", "cell", "most", "least", "n").join(asked, "bucket").groupBy("query_id", "cell").agg(F.sum(most).alias("bound"), F.sum("n").alias("n")))
    left, best, read = bounds, None, None
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    for cells in (*rounds, math.inf):
        chosen = left
        if cells < math.inf:
            chosen = left.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell"))).where(c("r") <= cells).drop("r")
        chosen = keep(chosen)
        posts = chosen.select("query_id", "cell").join(asked, "query_id").join(lists.select("bucket", "cell", "posts"), ["bucket", "cell"])
        posts = posts.select("query_id", "qw", F.explode("posts").alias("p")).select("query_id", c("p.key").alias("key"), (c("qw") * c("p.w")).alias("part"))
        if only is not None:
            posts = posts.join(only.select(c(key).alias("key")).distinct(), "key", "left_semi")
        scored = posts.groupBy("query_id", "key").agg(F.round(F.sum("part"), 9).alias("score"))
        scored = scored if best is None else scored.unionByName(best.drop("rank"))
        best = keep(scored.withColumn("rank", F.row_number().over(order) - 1).where(c("rank") < k))
        read = chosen if read is None else read.unionByName(chosen)
        worst = best.where(c("rank") == k - 1).select("query_id", (c("score") - MARGIN).alias("least"))
        left = left.join(chosen.select("query_id", "cell"), ["query_id", "cell"], "left_anti").join(worst, "query_id", "left").where(c("least").isNull() | (c("bound") >= c("least"))).drop("least")
        if cells < math.inf:
            left = keep(left)
            if left.isEmpty():
                break
    share = bounds.groupBy("query_id").agg(F.sum("n").alias("postings")).join(read.groupBy("query_id").agg(F.sum("n").alias("postings_read")), "query_id")
    return best.withColumnRenamed("key", key), share.select("query_id", "postings_read", "postings")
