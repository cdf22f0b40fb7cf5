"""Approximate nearest neighbours by collision-counting hashing over single projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.llm.common import small_batches

#: Vectors in one shard, and queries in one block; a task joins one shard with one block.
SHARD_ROWS = 16_384
BLOCK_ROWS = 4_096
PROJECTIONS = 64
#: Share of the projections in which a vector must lie in the query's window to be verified.
THRESHOLD = 0.70
#: Half widths of the windows, in standard deviations of a projection; they widen from one to the next until BETA of
#: the shard (or 4 k, if more) has passed the threshold, and in the end to everything.
WIDTHS = (*(0.4 * 1.12**r for r in range(24)), np.inf)
BETA = 0.10


def _lines(dim: int, seed: int = 6) -> np.ndarray:
    """Directions of the projections: random ones, at right angles to each other as far as there is room."""
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
    return np.concatenate(turns, axis=1)[:, :PROJECTIONS]


def _search(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the best k found for each query in one shard, exactly scored and sorted.

    A further component brings all vectors of the shard to the same length; queries have 0 there. Then those nearest
    by distance are those with the largest inner product. Equal vectors are one entry with several ids, so windows, counts
    and BETA are of different vectors, however many copies there are.
    """
    vectors, queries = vectors.sort_values("vec_id", kind="stable"), queries.sort_values("query_id")
    x = np.stack(vectors["embedding"].to_numpy()).astype(np.float64) + 0.0
    _, first, entry = np.unique(x.view(np.void(x.shape[1] * 8).dtype).ravel(), return_index=True, return_inverse=True)
    members = np.argsort(entry, kind="stable")  # entry by entry, in each by id
    ids, copies = vectors["vec_id"].to_numpy()[members], vectors["copies"].to_numpy()[members]
    start, x = np.searchsorted(entry[members], np.arange(len(first) + 1)), x[first]
    n, squares = len(x), np.einsum("ij,ij->i", x, x)
    lines = _lines(x.shape[1] + 1)
    projections = np.column_stack([x, np.sqrt(squares.max() - squares)]) @ lines
    q = np.stack(queries["embedding"].to_numpy()).astype(np.float64)
    centre = (q * (np.sqrt(squares.max()) / np.linalg.norm(q, axis=1))[:, None]) @ lines[:-1]
    order = np.ascontiguousarray(np.argsort(projections, axis=0, kind="stable").T)
    low, high = (np.empty((PROJECTIONS, len(q), len(WIDTHS)), np.int32) for _ in range(2))
    for j in range(PROJECTIONS):
        column, reach = projections[order[j], j], np.array(WIDTHS) * (projections[:, j].std() + 1e-12)
        low[j] = np.searchsorted(column, centre[:, j, None] - reach, "left")
        high[j] = np.searchsorted(column, centre[:, j, None] + reach, "right")
    # one more entry may be the query's own
    enough, need = min(n, max(4 * k, int(BETA * n)) + 1), int(np.ceil(THRESHOLD * PROJECTIONS))
    usual = 0
    for i, query in enumerate(queries["query_id"].to_numpy()):
        # virtual rehashing: windows begin near the width that the last query came to, and widen until enough pass
        r = max(0, usual - 1)
        counts = np.bincount(np.concatenate([order[j, low[j, i, r] : high[j, i, r]] for j in range(PROJECTIONS)]), minlength=n)
        while (counts >= need).sum() < enough:
            r += 1
            new = [part for j in range(PROJECTIONS) for part in (order[j, low[j, i, r] : low[j, i, r - 1]], order[j, high[j, i, r - 1] : high[j, i, r]])]
            counts += np.bincount(np.concatenate(new), minlength=n)
        usual = r
        found = np.flatnonzero(counts >= need)
        # sums in one order for every row, so equal vectors have equal scores
        scores = np.einsum("ij,j->i", x[found], q[i])
        best = np.argsort(-scores, kind="stable")
        found, scores = found[best], scores[best]
        # entries up to k other ids, with all entries of the last one's score
        least = scores[min(k, len(scores) - 1)]
        found, scores = found[scores >= least], scores[scores >= least]
        size = start[found + 1] - start[found]
        at = np.repeat(start[found] - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
        near, value, times = ids[at], np.repeat(scores, size), np.minimum(copies[at], k)
        other = near != query
        near, value = np.repeat(near[other], times[other]), np.repeat(value[other], times[other])
        best = np.lexsort((near, -value))[:k]
        yield query, near[best], value[best]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding, dim) of the vectors that take part."""
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null and embedding is not null")
    v = v.where(F.forall("embedding", good) & F.exists("embedding", lambda e: e != 0))
    return v.withColumn("dim", F.size("embedding"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for each query, in double precision.

    `is_query` is a condition on vec_id. Candidates are all rows but those with the query's own id. All vectors are dealt
    by a hash to shards of about SHARD_ROWS, queries to blocks of about BLOCK_ROWS, and every block is searched in every
    shard; of each search k rows come out, and the best k of them are kept. In a shard each projection is a sorted
    array; windows around the query widen together until enough vectors lie in THRESHOLD of them, and those are
    scored exactly. Ties go to the smaller vec_id; equal vectors are found together and have equal scores. Rows that agree
    in id and vector are merged before they are dealt, and counted.
    Vectors that are null, empty, zero, or hold null or non-finite components, and null ids, take no part. Vectors are
    compared with those of the same number of components. A repeated id is a candidate as often as it is there, and
    asks once (with its least vector). Other columns play no part; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    usable = _usable(vectors, id_col, vector_col)
    queries = usable.where(is_query).groupBy("dim", F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    sizes = {r["dim"]: (r["n"], r["q"]) for r in usable.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    number = lambda per, at: F.element_at(F.create_map(*[F.lit(x) for dim, s in sizes.items() for x in (dim, max(1, -(-s[at] // per)))]), F.col("dim"))
    shards, blocks = number(SHARD_ROWS, 0), number(BLOCK_ROWS, 1)
    dealt = lambda n, *c: F.pmod(F.xxhash64(*c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    merged = usable.groupBy("dim", "vec_id", "embedding").agg(F.count("*").alias("copies"))
    side_v = merged.select("dim", dealt(shards, "vec_id", "embedding").alias("shard"), every(blocks).alias("block"), "vec_id", "embedding", "copies")
    side_q = queries.select("dim", every(shards).alias("shard"), dealt(blocks, "query_id").alias("block"), "query_id", "embedding")

    def search(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if v.empty or q.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows = [pd.DataFrame({"query_id": query, "vec_id": ids, "score": scores}) for query, ids, scores in _search(v, q, k)]
        return pd.concat(rows) if rows else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ("dim", "shard", "block")
    best = side_v.groupBy(*keys).cogroup(side_q.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
