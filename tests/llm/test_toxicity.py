"""Toxicity: held-out quality, defined results for odd texts."""

import math
import re
import zlib

import numpy as np

from merchlake.llm import op10_toxicity as op
from merchlake.llm.queries import op10_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = op10_toxicity(spark, SF).join(labels, "doc_id").where("held_out").collect()
    bad, good = (np.array([r["score"] for r in rows if r["toxic"] == k]) for k in (1, 0))
    assert (bad[:, None] > good[None, :]).mean() >= 0.95
    assert (good >= 0.5).mean() <= 0.02 and (bad >= 0.5).mean() >= 0.7
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_weights_are_few_and_odd_texts_have_scores(spark):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 40)) + (" nasty" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = op.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert len(model[0]) < 2000
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "so nasty", 0), (3, "so nasty", 0), (3, "w1 w2 " * 50_000, 0)], "doc_id long, text string, score int")
    got = [(r["doc_id"], round(r["score"], 6), r["predicted"]) for r in op.score(odd, model).collect()]
    assert got[0][1] == got[1][1] < 0.5
    assert got[2][2] == got[3][2] == 1 and got[4][2] == 0
    assert op.score(odd.limit(0), model).collect() == []


def test_missing_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for labels, score in (([(1, 1)], 1), ([(1, 0), (2, None)], 0), ([], None)):
        model = op.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = {round(r["score"], 3) for r in op.score(docs, model).collect()}
        assert got == ({0.5} if score is None else {float(score)})


def test_bound_of_characters_is_kept_by_hash_whatever_the_order(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 40)) + (" nasty" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(900)]
    rows.insert(0, (900, "far too long " * 20_000, 0))
    models = []
    for given in (rows, rows[::-1]):
        docs = spark.createDataFrame(given, "doc_id long, text string, toxic int").coalesce(1)
        models.append(op.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"), sample_chars=80_000))
    assert all(np.array_equal(a, b) for a, b in zip(*models, strict=True))
    asked = spark.createDataFrame([(1, "so nasty"), (2, "w1 w2 w3")], "doc_id long, text string")
    assert [r["predicted"] for r in op.score(asked, models[0]).orderBy("doc_id").collect()] == [1, 0]


def test_bound_of_characters_by_class():
    sizes = [(0, 5, 40), (0, 1, 500), (0, 7, 30), (0, 9, 20), (1, 3, 10), (1, 2, 15)]
    assert sorted(op._fitting(sizes, 100)) == [(0, 5), (0, 7), (1, 2), (1, 3)]
    assert sorted(op._fitting([(0, 1, 500), (0, 2, 300), (1, 3, 10)], 100)) == [(0, 2), (1, 3)]


def plain_score(text, model):
    """Brute force: every word, pair and skip-pair looked up one by one in plain integers."""
    at, weights, bias = model
    weight = dict(zip(at.tolist(), weights.tolist(), strict=True))
    whole = (1 << 64) - 1

    def place(h):
        h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 & whole
        return (h ^ (h >> 29)) & ((1 << op.BITS) - 1)

    words = [zlib.crc32(w.encode()) << 32 | zlib.adler32(w.encode()) for w in re.findall(r"\w+", (text or "").lower())]
    features = {place(w) for w in words}
    for kind, gap in ((1, 1), (2, 2)):
        features |= {place((a * 0x9E3779B97F4A7C15 + b + kind) & whole) for a, b in zip(words, words[gap:])}
    return 1 / (1 + math.exp(-max(-35, min(35, sum(weight.get(f, 0.0) for f in features) + bias))))


def test_scores_are_those_of_the_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    model = op.learn(docs, labels)
    assert len(model[0])
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in op.score(docs, model).collect():
        assert math.isclose(r["score"], plain_score(texts[r["doc_id"]], model), rel_tol=1e-9)


def test_contradicting_labels_teach_nothing(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 200, 30)) + (" nasty" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(600)]
    labels = [(i, y) for i, _, y in rows] + [(i, y) for i, _, y in rows[:50]]
    both = [(i, 1 - y) for i, _, y in rows[100:140]] + [(i, None) for i, _, _ in rows[:5]]
    got = []
    for name, given in (("a", [x for x in labels if not 100 <= x[0] < 140]), ("b", labels + both)):
        spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(given, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got.append(sorted((r["doc_id"], r["score"]) for r in op10_toxicity(spark, f"{tmp_path}/{name}").collect()))
    assert got[0] == got[1]
