"""Approximate nearest neighbours: recall against brute force, exact scores and order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlake.llm import op6_neighbours as op

SF = "/root/testdata/sf0.1"


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = [(int(i), float(v)) for i, v in zip(ids[keep][order], s[keep][order])]
    return out


def compared(got, want, k):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    assert by.keys() == want.keys()
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert len(rows) == len(want[q])
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & {i for i, _ in want[q]})
        total += len(want[q])
    return hits / total


@pytest.mark.parametrize("shard", [16_384, 700])
def test_recall_on_the_whole_table(spark, monkeypatch, shard):
    monkeypatch.setattr(op, "SHARD_ROWS", shard)
    monkeypatch.setattr(op, "BLOCK_ROWS", 64)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r[0], r[1]) for r in vectors.select("vec_id", "embedding").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = op.nearest(vectors, F.col("vec_id") % 20 == 0, 20).collect()
    assert compared(got, want, 20) >= 0.93
    scores = {(q, i): s for q, hits in want.items() for i, s in hits}
    assert all(abs(scores[r["query_id"], r["vec_id"]] - r["score"]) < 1e-12 for r in got if (r["query_id"], r["vec_id"]) in scores)


def test_lengths_matter_and_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.1, 9)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = op.nearest(docs, F.col("vec_id") % 20 == 0, 20).collect()
    assert compared(got, want, 20) >= 0.9


def test_equal_vectors_come_by_id(spark, monkeypatch):
    rng = np.random.default_rng(8)
    for dim, shard in ((64, 16_384), (64, 200), (13, 16_384)):
        monkeypatch.setattr(op, "SHARD_ROWS", shard)
        same = rng.standard_normal(dim).tolist()
        rows = [(i, same) for i in range(1, 22)] + [(0, [2 * v for v in same])] + [(i, (0.1 * rng.standard_normal(dim)).tolist()) for i in range(100, 480) if i % 20]
        got = op.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 20).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == list(range(1, 21))
        assert len({r["score"] for r in got}) == 1


def test_repeated_rows_and_large_groups_of_copies(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(600)]
    rows += [(7, rows[7][1])] * 3 + [(40, rows[40][1])] * 2 + [(40, rows[41][1])] + [(1000 + i, rows[5][1]) for i in range(600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = [i for i in range(0, 600, 20) if i != 40]
    got = op.nearest(vectors, (F.col("vec_id") % 20 == 0) & (F.col("vec_id") < 600), 20).collect()
    assert compared([r for r in got if r["query_id"] != 40], brute(rows, queries, 20), 20) >= 0.9
    assert all(r["vec_id"] != 40 for r in got if r["query_id"] == 40)
    ask = spark.createDataFrame([(0, rows[7][1])], "vec_id long, embedding array<double>")
    best = op.nearest(vectors.union(ask), F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert len(best) == 5


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (None, [1.0, 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (8, [], 1), (20, [1.0, 1.0], 1), (40, [0.5, 0.5], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op.nearest(docs, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (0, 3, 40, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 40, 1.0), (40, 1, 20, 1.0), (40, 2, 0, 0.5), (40, 3, 1, 0.5)]
    assert op.nearest(docs.limit(0), F.col("vec_id") % 20 == 0, 20).collect() == []
