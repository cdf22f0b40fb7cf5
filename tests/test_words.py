"""Vectors made from texts taken apart in tasks are those made from rows of tokens, and move little."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from merchlake.functions import words
from merchlake.operators import postings, retrieval
from merchlake.sources.scratch import fresh_root, kept


def texts(n, seed):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(30)] + ["a", "É", "é-x", "co-op", "A_b/C", "x-", "ΟΔΟΣ", "İ2", "Kelvin", "naïve"]
    return [(i, " ".join(r.choices(words, k=r.randint(0, 40))) + f" only{i}" * (i % 3)) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "?!")]


def flat(df, *names):
    return sorted((str(r["doc_id"]), r["bucket"], *[round(r[n], 9) for n in names]) for r in df.collect())


@pytest.mark.parametrize("most", [0, 5, None])
def test_both_weightings(spark, most):
    docs = spark.createDataFrame(texts(150, 1), "doc_id long, text string")
    terms = kept(retrieval.terms(docs, "doc_id"))
    plain, idf = retrieval.vectors(terms, "doc_id"), retrieval.idf(terms, F.lit(docs.count()))
    want = plain.withColumnRenamed("weight", "plain").join(retrieval.vectors(terms, "doc_id", token_idf=idf).withColumnRenamed("weight", "by_token"), ["doc_id", "bucket"])
    got = flat(retrieval.weightings(docs, kept, most=most), "plain", "by_token")
    assert got == flat(want, "plain", "by_token") and len(got) > 1000


def test_texts_of_one_key_are_one_document(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "two three"), (None, "four"), (None, "five five"), (2, "one")], "doc_id long, text string")
    got = {r["doc_id"]: sorted(r["text"].split()) for r in retrieval.one_each(docs, "doc_id").collect()}
    assert got == {1: ["one", "three", "two", "two"], None: ["five", "five", "four"], 2: ["one"]}
    want = retrieval.vectors(retrieval.terms(docs, "doc_id"), "doc_id").groupBy("doc_id").count()
    assert {tuple(r) for r in retrieval.weightings(docs, kept, most=1).groupBy("doc_id").count().collect()} == {tuple(r) for r in want.collect()}


def test_no_row_is_made_of_a_common_token(spark):
    """Of tokens that many documents have none is shuffled with its document: only those that tasks do not know are."""
    docs = spark.createDataFrame([(i, "the of and " * 5 + f"own{i}") for i in range(300)], "doc_id long, text string")
    made = []
    retrieval.weightings(docs, lambda df: made.append(kept(df)) or made[-1], most=3)
    assert [r["token"] for r in made[1].select(F.explode("rare.token").alias("token")).collect() if not re.match("own", r["token"])] == []
    assert made[1].select(F.explode("rare")).count() == 300


def test_texts_are_taken_apart_once(spark):
    """The vectors of both ways are the same, and what explodes them has one step in Python, not one more for a filter."""
    docs = spark.createDataFrame(texts(120, 2), "doc_id long, text string")
    terms = kept(retrieval.terms(docs, "doc_id"))
    buckets = kept(retrieval.bucket_idf(retrieval.idf(terms, F.lit(docs.count()))).where("bucket % 5 != 0"))
    made = retrieval.one_each(docs, "doc_id").select("doc_id", words.vectors(F.col("text"), retrieval.means_of(buckets)).alias("x")).select("doc_id", "x.*")
    rows = made.select("doc_id", F.inline("v"))
    assert rows._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].count("ArrowEvalPython") == 1
    assert flat(rows, "w") == flat(retrieval.vectors(terms, "doc_id", buckets), "weight")
    assert made.where(F.size("v") > 0).where(F.col("s") != postings.summary(F.col("v"))).count() == 0


def test_blocks_go_on_over_batches():
    rows = [(b % 2, b, cell, 10 * i + cell, float((7 * i + b) % 11)) for b in range(3) for cell in range(4) for i in range(b + 1)]
    names = ["part", "bucket", "cell", "key", "w"]
    for size in (1, 2, 5, 100):
        cut = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + size]]) for i in range(0, len(rows), size)]
        got = [tuple(x.values()) for batch in postings._blocks(iter(cut)) for x in batch.to_pylist()]
        want = []
        for b in range(3):
            for cell in range(4):
                own = [r for r in rows if r[1:3] == (b, cell)]
                want.append((b % 2, b, cell, max(r[4] for r in own), min(r[4] for r in own), len(own), [{"key": r[3], "w": r[4]} for r in own]))
        assert got == want
    assert list(postings._blocks(iter([]))) == []


def test_terms_of_an_index_and_their_scores(spark):
    docs = spark.createDataFrame(texts(80, 3), "doc_id long, text string")
    root, asked = fresh_root(spark, "index"), spark.createDataFrame([(1, "word1 word2 é-x"), (2, "nothing")], "query_id int, text string")
    retrieval.build_index(docs, root)
    index = retrieval.load_index(spark, root)
    terms = retrieval.terms(docs, "doc_id")
    assert {tuple(r) for r in index["terms"].collect()} == {tuple(r) for r in terms.select("doc_id", "token", "tf").collect()}
    found = docs.select(F.lit(1).alias("query_id"), "doc_id").unionByName(docs.where("doc_id < 3").select(F.lit(2).alias("query_id"), "doc_id"))
    scores = retrieval.bm25(found, index["terms"], retrieval.terms(asked, "query_id"), index["vocabulary"], "doc_id")
    tf = {(r["doc_id"], r["token"]): r["tf"] for r in terms.collect()}
    idf = {r["token"]: r["idf"] for r in index["vocabulary"].collect()}
    size = lambda d: sum(n for (i, _), n in tf.items() if i == d) or 1
    want = {}
    for q, own, asks in ((1, [r["doc_id"] for r in docs.collect()], ["word1", "word2", "é-x"[2:]]), (2, [0, 1, 2], ["nothing"])):
        mean = sum(map(size, own)) / len(own)
        for d in own:
            want[q, d] = pytest.approx(sum(idf[t] * tf[d, t] * 2.5 / (tf[d, t] + 1.5 * (0.25 + 0.75 * size(d) / mean)) for t in asks if (d, t) in tf), abs=2e-9)
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in scores.collect()} == want
