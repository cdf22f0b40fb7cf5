"""Exact top-k search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from merchlake.llm import op7_search as op

SF = "/root/testdata/sf0.01"


def brute(rows, is_query, k):
    docs = [(d, Counter(re.findall(r"\w+", (t or "").lower()))) for d, t in rows]
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / max(1, len(docs))
    df = Counter(w for _, c in docs for w in c)
    least = {}
    for d, t in rows:
        if d is not None and is_query(d) and t is not None:
            least[d] = min(t, least.get(d, t))
    out = {}
    for q, text in least.items():
        words = set(re.findall(r"\w+", text.lower()))
        scored = []
        for d, c in docs:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in words if c[w])
            if s > 0:
                scored.append((-s, d is not None, d))
        out[q] = [(d, -s) for s, _, d in sorted(scored)[:k]]
    return {q: hits for q, hits in out.items() if hits}


def compare(df, want):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    assert got.keys() == want.keys()
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, len(want[q]) + 1))
        assert all(math.isclose(a[2], b[1], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(hits, want[q], strict=True))
        # documents may differ only where scores are equal up to rounding
        assert all(a[1] == b[0] or any(math.isclose(a[2], c[1], rel_tol=1e-9, abs_tol=1e-9) and c[0] == a[1] for c in want[q]) or math.isclose(a[2], want[q][-1][1], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(hits, want[q], strict=True))


@pytest.mark.parametrize(("shard", "block"), [(24_576, 16), (130, 5)])
def test_whole_table(spark, monkeypatch, shard, block):
    monkeypatch.setattr(op, "SHARD_ROWS", shard)
    monkeypatch.setattr(op, "BLOCKS", block)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    compare(op.search(docs, F.col("doc_id") % 100 == 0), brute(rows, lambda d: d % 100 == 0, 10))


def test_pruning_loses_nothing(monkeypatch):
    monkeypatch.setattr(op, "BLOCKS", 250)
    rng = np.random.default_rng(4)
    drawn = [np.concatenate([rng.zipf(1.3, 40) % 3000, i % 50 * 1000 + rng.integers(0, 30, 6)]).astype(np.uint64) for i in range(2003)]
    terms, counts = zip(*(np.unique(d, return_counts=True) for d in drawn), strict=True)
    index = op.Index(list(terms), list(counts), 46.0)
    df = Counter(t for ts in terms for t in ts.tolist())
    idf_of = {t: math.log(1 + (2003 - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    for q in range(0, 2003, 97):
        asked = set(terms[q].tolist())
        scored = [(-sum(idf_of[t] * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * c.sum() / 46.0)) for t, n in zip(ts.tolist(), c.tolist(), strict=True) if t in asked), d) for d, (ts, c) in enumerate(zip(terms, counts, strict=True))]
        want = sorted(s for s in scored if s[0] < 0)[:5]
        got = index.top(terms[q], np.array([idf_of[t] for t in terms[q].tolist()]), 5)
        assert all(math.isclose(a[0], -b[0], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want, strict=True))
        assert {d for s, d in got if s > got[-1][0] * (1 + 1e-9)} == {d for s, d in want if -s > got[-1][0] * (1 + 1e-9)}


def test_blocks_are_skipped():
    """Documents of another kind are in blocks of their own, and a query for their terms looks into no others."""
    rng = np.random.default_rng(5)
    terms = [np.unique(rng.integers(0, 60, 30) + 1000 * (i % 4)).astype(np.uint64) for i in range(1600)]
    index = op.Index(list(terms), [np.ones(len(t), np.int32) for t in terms], 25.0)
    weights = index.weight
    others = np.flatnonzero(np.isin(index.doc, np.flatnonzero(index.ids % 4 != 1)))
    weights[others] = np.nan  # whoever adds them up finds out
    best = index.top(terms[5], np.ones(len(terms[5])), 3)
    assert best[0][1] == 5
    assert {d % 4 for _, d in best} == {1}
    assert not any(math.isnan(s) for s, _ in best)


@pytest.mark.parametrize("together,long,by_slice", [(1, 4, 2), (7, 50, 64), (64, 10_000, 8)])
def test_long_lists_are_kept_whole_and_added_for_many_queries_at_once(monkeypatch, together, long, by_slice):
    monkeypatch.setattr(op, "TOGETHER", together)
    monkeypatch.setattr(op, "LONG", long)
    monkeypatch.setattr(op, "SLICE", by_slice)
    r = np.random.default_rng(5)
    terms = [np.unique(np.minimum(r.zipf(1.3, 60), 3000)).astype(np.uint64) for _ in range(900)] + [np.zeros(0, np.uint64)]
    counts = [r.integers(1, 4, len(t)).astype(np.int32) for t in terms]
    index = op.Index(list(terms), list(counts), 40.0)
    n = sum(len(t) for t in terms)
    whole = sum(int((m > 0).sum()) for m in index.whole)
    assert whole + len(index.doc) == n and n / 4 < whole and sum(m.size for m in index.whole) <= whole * op.FULL * 2
    df = Counter(t for ts in terms for t in ts.tolist())
    idf = lambda ts: np.array([math.log(1 + (901 - df[t] + 0.5) / (df[t] + 0.5)) for t in ts.tolist()])
    asked = [(t, idf(t)) for t in [*terms[:40], np.array([2**40], np.uint64), np.zeros(0, np.uint64)]]
    found = list(index.tops(asked, 5))
    assert len(found) == len(asked) and found == [index.top(t, w, 5) for t, w in asked]
    norm = [op.K1 * (1 - op.B + op.B * int(c.sum()) / 40.0) for c in counts]
    weight = [{t: w * (op.K1 + 1) / (w + norm[d]) for t, w in zip(ts.tolist(), cs.tolist(), strict=True)} for d, (ts, cs) in enumerate(zip(terms, counts, strict=True))]
    for (t, w), got in zip(asked, found, strict=True):
        scores = [(round(sum(x * mine.get(a, 0.0) for a, x in zip(t.tolist(), w.tolist(), strict=True)), 9), d) for d, mine in enumerate(weight)]
        want = sorted(((-s, d) for s, d in scores if s > 0))[:5]
        assert [d for _, d in got] == [d for _, d in want] and np.allclose([s for s, _ in got], [-s for s, _ in want])


def test_groups_of_equal_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD_ROWS", 500)
    rows = [(7, "the same words")] * 1500 + [(i, "the same words again") for i in range(100, 600)] + [(600, "same " * 300_000 + "end"), (700, "end words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    compare(op.search(docs, F.col("doc_id") % 100 == 0, 4), brute(rows, lambda d: d % 100 == 0, 4))


def test_edge_cases(spark):
    rows = [(0, "red red blue"), (1, "blue"), (1, "blue"), (None, "red"), (100, ""), (200, None), (300, "Red! blue?"), (300, "zzz"), (4, "other words")]
    docs = spark.createDataFrame([(d, t, 0.0) for d, t in rows], "doc_id long, text string, score double")
    compare(op.search(docs, F.col("doc_id") % 100 == 0, 3), brute(rows, lambda d: d % 100 == 0, 3))
    assert op.search(docs.limit(0), F.col("doc_id") % 100 == 0).collect() == []


def test_terms_are_words(monkeypatch):
    """Hashes stand for the words of a regular expression, whatever is hashed together and wherever long texts are cut."""
    texts = ["", None, "Ab ab_1 ab-ab \u00e4\u00c4 \u4f60\u597d\u201cab\u201d \U0001d400 \u0130x", "one two " * 40, "a" * 300 + " b" * 50, "\ud800 x", " ab "]
    counts = [Counter(re.findall(r"\w+", (t or "").lower())) for t in texts]
    word_of = {}
    for piece in (1 << 20, 64, 7):
        monkeypatch.setattr(op, "PIECE", piece)
        got = list(op.term_counts(texts))
        assert [sorted(n.tolist()) for _, n in got] == [sorted(c.values()) for c in counts]
        for word in {w for c in counts for w in c}:
            (h,) = next(op.term_counts([word]))[0].tolist()
            assert word_of.setdefault(word, h) == h
            assert all((dict(zip(t.tolist(), n.tolist(), strict=True)).get(h, 0)) == c[word] for (t, n), c in zip(got, counts, strict=True))
    assert len(set(word_of.values())) == len(word_of)
