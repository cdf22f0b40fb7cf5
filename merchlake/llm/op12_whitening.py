"""Whitening of embeddings: a randomised range finder with power passes over all rows, then Rayleigh-Ritz.

The covariance is never sampled: each pass multiplies it, by way of all centred rows, with a thin matrix of directions, which
tasks sum up by themselves; what comes back to the driver is one matrix of dimensions by directions, whatever the number of
rows. Directions start random, more of them than components are wanted; each pass draws them towards the leading ones. Where
residuals say that the components found are not exact yet, and passes would not make them so soon, there are twice as many
directions, up to as many as there are dimensions, where the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import Scratch, small_batches

SCALE, SHIFT = 1024, 100_000
#: Directions beyond the wanted components, and passes before there are more directions.
OVERSAMPLING, PASSES = 10, 4
#: A component is exact if its residual is below EXACT times its eigenvalue's distance from the next, or is rounding, as any
#: method leaves it: ROUNDING times the largest eigenvalue.
EXACT, ROUNDING = 1e-12, 2e-15
#: Entries are held within this, so that differences fit a long.
_FAR = 1 << 61
#: Sums of tasks are added up in so many groups first.
_GROUPS = 32
_SEED = 12


def whole_numbers(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): each entry c of a vector as floor(1024 c) + 100000, where 1024 c is held within 2^61 on either side.

    Rows whose vector is null or empty, or holds null or non-finite entries, go; so do those whose length is not the one that
    most of the rest have (ties: the greater length). Ids are kept as they are, null and repeated ones too.
    """
    rows = docs.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.size("v") > 0).where(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_scaled, f"vec_id {kind}, x array<bigint>")


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        v = rows["v"]
        x = np.clip(np.floor(v.flatten().to_numpy(zero_copy_only=False) * SCALE), -_FAR, _FAR).astype(np.int64) + SHIFT
        lengths = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
        yield pa.record_batch([rows["vec_id"], pa.ListArray.from_arrays(pa.array(lengths), pa.array(x))], ["vec_id", "x"])


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    return rows["x"].flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def _totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums of every dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            x = _matrix(batch)
            n += len(x)
            # high and low parts of entries apart, so that neither sum can leave a long
            total = total + (x >> 20).sum(0).astype(object) * (1 << 20) + (x & ((1 << 20) - 1)).sum(0)
        if n:
            yield pa.record_batch([pa.array(range(-1, len(total)), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["i", "total"])

    found = rows.select("x").mapInArrow(sums, "i int, total string").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    by_dimension = {r["i"]: int(r["total"]) for r in found.collect()}
    return by_dimension.pop(-1, 0), [by_dimension[i] for i in sorted(by_dimension)]


def _added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all batches of rows of `part`, a matrix of fixed shape: within tasks, then within groups of them, then over groups."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(shape), None
        for batch in batches:
            first = first or str(batch["vec_id"][0].as_py())
            total += part(_matrix(batch))
        if first is not None:
            yield pa.record_batch([pa.array([first]), pa.array([total.tobytes()])], ["task", "sum"])

    def of_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("sum", "ascending")])
        total = np.zeros(shape)
        for x in table["sum"]:
            total += np.frombuffer(x.as_py()).reshape(shape)
        return pa.table({"task": [table["task"][0].as_py()], "sum": [total.tobytes()]})

    sums = rows.mapInArrow(of_task, "task string, sum binary").withColumn("group", F.pmod(F.xxhash64("task", "sum"), F.lit(_GROUPS)))
    groups = sums.groupBy("group").applyInArrow(of_group, "task string, sum binary").collect()
    return sum((np.frombuffer(r["sum"]).reshape(shape) for r in sorted(groups)), np.zeros(shape))


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole number and a fraction: taking the first away is exact."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def components(rows: DataFrame, n: int, sums: list[int], most: int = 8, oversampling: int = OVERSAMPLING, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float, list[int]]:
    """Leading eigenvalues and unit eigenvectors (columns) of the covariance of all rows, its trace, and how many directions each pass took.

    At most `most`, and none whose eigenvalue is not above rounding: vectors that do not vary have no component. Signs are
    fixed by making the largest entry of each positive.
    """
    dims = len(sums)
    base, rest = _centre(n, sums)
    random = np.random.default_rng(_SEED)
    wide = min(dims, most + oversampling)
    q, _ = np.linalg.qr(random.standard_normal((dims, wide)))
    taken, since = [], 0
    while True:

        def part(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            c = (x - base) - rest
            return np.column_stack([c.T @ (c @ q), np.einsum("ij,ij->j", c, c)])

        summed = _added(rows, part, (dims, q.shape[1] + 1)) / n
        vq, trace = summed[:, :-1], float(summed[:, -1].sum())
        taken.append(q.shape[1])
        since += 1
        ritz = q.T @ vq
        values, inner = np.linalg.eigh((ritz + ritz.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        vectors = q @ inner
        k = min(most, int((values > dims * np.finfo(float).eps * max(values[0], 0.0)).sum()))
        if q.shape[1] == dims or values[0] <= 0:
            break
        residual = np.linalg.norm(vq @ inner[:, :k] - vectors[:, :k] * values[:k], axis=0)
        apart = np.array([np.delete(np.abs(values - v), i).min() for i, v in enumerate(values[:k])])
        excess = float(np.max(residual / np.maximum(EXACT * apart, ROUNDING * values[0]), initial=0))
        if k == most and excess <= 1:
            break
        slope = values[-1] / max(values[k - 1], 1e-300)  # what a pass leaves of an error
        hopeless = since >= 2 and excess * slope ** (passes - since) > 1
        if k < most or since >= passes or hopeless:
            more = min(dims, 2 * q.shape[1])
            q, _ = np.linalg.qr(np.column_stack([vq @ inner, random.standard_normal((dims, more - q.shape[1]))]))
            since = 0
        else:
            q, _ = np.linalg.qr(vq)
    values, vectors = values[:k], vectors[:, :k]
    if k:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), range(k)] < 0, -1, 1)
    return values, vectors, trace, taken


def _squares(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For each row the sum over dimensions of (n x - S)^2, exact."""
    base = np.array([s // n for s in sums], np.int64)
    over = [s % n for s in sums]
    apart = x - base
    largest = int(np.abs(apart).max(initial=0)) * n + n
    if largest * largest * len(sums) < 1 << 63:
        d = apart * n - np.array(over, np.int64)
        return (d * d).sum(1).tolist()
    d = apart.astype(object) * n - np.array(over, object)
    return (d * d).sum(1).tolist()


def whiten(docs: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", oversampling: int = OVERSAMPLING, passes: int = PASSES) -> DataFrame:
    """Whitened coordinates of every vector along the leading components of the covariance of all.

    One row for each remaining row of `docs` (see `whole_numbers`) and component, numbered from 1 by falling eigenvalue e:
    vec_id, component, n (remaining rows), deviation (sum over dimensions of (n x - S)^2 with sums S; null where that is beyond
    a long), whitened ((x - S/n) along the component, over sqrt(e)), explained (e / trace), identity_error (the largest
    absolute entry of whitened's covariance, made from all rows, minus the identity), deviation_wide (the same sum as
    decimal(38,0), null beyond that). There are at most `most` components, fewer if there are fewer dimensions or vectors
    vary in fewer directions; if they do not vary at all, or there are none, the result is empty. Other columns play no part.
    Components of equal eigenvalue are some basis of their space.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "whiten")
    rows = scratch.keep(whole_numbers(docs, id_col, vector_col))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"
    length = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == length["length"])
    n, sums = _totals(rows)
    values, vectors, trace, _ = components(rows, n, sums, most, oversampling, passes)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    base, rest = _centre(n, sums)
    turn = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        y = ((x - base) - rest) @ turn
        return np.vstack([y.T @ y, y.sum(0)])

    summed = _added(rows, moments, (k + 1, k)) / n
    error = float(np.abs(summed[:-1] - np.outer(summed[-1], summed[-1]) - np.eye(k)).max())
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            y = ((x - base) - rest) @ turn
            m = len(x)
            squares = _squares(x, n, sums)
            each = np.repeat(np.arange(m), k)
            spread = lambda a: a.take(pa.array(each))
            longs = pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())
            wide = pa.array([str(s) if s < 10**38 else None for s in squares], pa.string())
            columns = [spread(batch["vec_id"]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), spread(longs), pa.array(y.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)), spread(wide)]
            yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_wide"])

    out = rows.mapInArrow(project, schema.replace("deviation_wide decimal(38,0)", "deviation_wide string"))
    return out.withColumn("deviation_wide", F.col("deviation_wide").cast("decimal(38,0)"))
