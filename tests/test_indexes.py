"""Written indexes give what reading everything gives, and read less."""

import random
import re

import pytest
from pyspark.sql import functions as F

from merchlake.operators import deltas, directory, retrieval
from merchlake.operators import names as N
from merchlake.operators import postings
from merchlake.operators.commits import Tables
from merchlake.sources.scratch import fresh_root, kept

SF = "/root/testdata/sf0.01"


def sparse(n, buckets, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        own = r.sample(range(buckets), min(buckets, r.choice((2, 3, 5, 30))))
        w = {b: round(r.uniform(-1, 1), 2) for b in own}
        size = sum(x * x for x in w.values()) ** 0.5 or 1.0
        out.append((i, [(b, x / size) for b, x in w.items()]))
    return out


def brute(docs, queries, k, only=None):
    out = set()
    for q, words in queries.items():
        scored = []
        for i, v in docs:
            shared = [x * words[b] for b, x in v if b in words]
            if shared and (only is None or i in only):
                scored.append((-round(sum(shared), 9), i))
        out |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(scored)[:k])}
    return out


QUERIES = {1: {0: 0.9, 5: -0.3, 7: 0.2}, 2: {11: -1.0}, 3: {i: (-1) ** i * 0.2 for i in range(40)}, 4: {999: 1.0}}


def searched(spark, docs, k, only=None, **kw):
    root = fresh_root(spark, "postings")
    df = spark.createDataFrame(docs, "doc_id long, v array<struct<bucket:long,w:double>>")
    postings.write(df, root, "doc_id", **kw)
    asked = spark.createDataFrame([(q, b, w) for q, words in QUERIES.items() for b, w in words.items()], "query_id int, bucket long, weight double")
    keys = None if only is None else spark.createDataFrame([(i,) for i in only], "doc_id long")
    found, share = postings.top(postings.load(spark, root), asked, "doc_id", k, kept, keys)
    return {(r["query_id"], r["doc_id"], r["rank"]) for r in found.collect()}, {r["query_id"]: (r["postings_read"], r["postings"]) for r in share.collect()}


def test_postings_find_what_all_vectors_give(spark):
    docs = sparse(1500, 60, 1) + [(5000 + i, [(0, 0.6), (5, -0.8)]) for i in range(40)]  # a group of equal vectors: ties by key
    for k in (1, 12):
        got, share = searched(spark, docs, k, cell=16)
        assert got == brute(docs, QUERIES, k)
        assert all(read < every for read, every in share.values())


def test_postings_when_fewer_match_than_wanted(spark):
    """Then documents that only lower the score count too, and all is read."""
    docs = sparse(60, 60, 2)
    got, share = searched(spark, docs, 50, cell=4)
    assert got == brute(docs, QUERIES, 50)
    assert share[3][0] <= share[3][1]
    assert searched(spark, [], 5) == (set(), {})


def test_postings_among_some_documents_only(spark):
    docs, only = sparse(600, 60, 3), set(range(0, 600, 7))
    got, _ = searched(spark, docs, 5, only, cell=16)
    assert got == brute(docs, QUERIES, 5, only)


def test_postings_of_other_buckets_are_not_opened(spark):
    root = fresh_root(spark, "postings")
    postings.write(spark.createDataFrame(sparse(50, 10, 4), "doc_id long, v array<struct<bucket:long,w:double>>"), root, "doc_id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = postings.of_buckets(postings.load(spark, root), [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan and "PushedFilters: [In(bucket" in plan
    assert postings.load(spark, root).select("bucket").distinct().count() == 10


def plain_resolve(asked, products, order):
    """The product of each name by looking at every product in every stage."""
    slug = lambda t: "-".join("".join(x if x.isascii() and x.isalnum() else " " for x in t.lower()).split())
    out = {}
    for name_id, name in asked:
        name = name.strip(" ")
        ns, head = slug(name), name.lower().split(" ")[0]
        if not ns:
            continue
        words = [w for w in slug(name.partition(" ")[2]).split("-") if len(w) > 1] if " " in name else []
        best = None
        for p in products:
            ps = slug(p["name"])
            hits = sum(w in ps for w in words)
            tests = {"slug": ps == ns, "brand": p["brand"].lower() == name.lower(), "name_part": name.lower() in p["name"].lower(), "slug_part": ns in ps, "tokens": p["brand"].lower() == head and hits > 0}
            stage = next((i + 1 for i, kind in enumerate(N.STAGES[order]) if tests[kind]), None)
            if stage:
                rank = (stage, -hits if N.STAGES[order][stage - 1] == "tokens" else 0, p["price"] is None, -(p["price"] or 0), p["id"])
                best = min(best or rank, rank)
        if best:
            out[name_id] = (name, best[-1], best[0])
    return out


@pytest.mark.parametrize("order", ["lookup", "compare"])
def test_names_find_what_looking_at_every_product_gives(spark, order, monkeypatch):
    monkeypatch.setattr(N, "FIRST", 8)
    monkeypatch.setattr(N, "GROWTH", 4)
    r = random.Random(7)
    words = ["ultra", "pro", "max", "note", "5g", "z", "flip", "a5", "é", "plus+"]
    products = [{"id": i, "brand": r.choice(["Samsung", "Acme", "Zed"]), "name": " ".join(r.choices(words, k=r.randint(1, 4))), "price": r.choice([None, 10.0, 20.0, 20.0, float(i)])} for i in range(300)]
    asked = [(i, " ".join(r.choices([*words, "samsung", "Acme", "zed", "nothing", "(pro)"], k=r.randint(1, 4)))) for i in range(200)]
    asked += [(900, ""), (901, "  "), (902, "z"), (903, "a"), (904, "5G "), (905, "é"), (906, "o n"), (907, "samsung"), (908, "SAMSUNG pro pro"), (909, "acme x"), (910, "lus"), (911, "qqq")]
    phones = spark.createDataFrame([(p["id"], p["brand"], p["name"], p["price"]) for p in products], "id long, brand string, name string, price_min double")
    names = spark.createDataFrame(asked, "name_id int, name string")
    want = plain_resolve(asked, products, order)
    root = fresh_root(spark, "names")
    N.write_index(phones, root)
    for index in (None, N.load_index(spark, root)):
        got = {x["name_id"]: (x["name"], x["id"], x["stage"]) for x in N.resolve(names, phones, order, index).collect()}
        assert got == want
    assert {s for *_, s in want.values()} >= {1, 2, 3}


def test_names_are_resolved_without_a_nested_loop(spark, monkeypatch):
    plans = []
    from merchlake.operators import names

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(names, "kept", watched)
    phones = spark.read.parquet(f"{SF}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price_min"))
    asked = phones.select(F.col("id").alias("name_id"), F.substring("name", 3, 9).alias("name"))
    out = N.resolve(asked, phones)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == asked.count() and not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def test_levels_hold_the_dearest_first(spark, monkeypatch):
    monkeypatch.setattr(N, "FIRST", 10)
    monkeypatch.setattr(N, "GROWTH", 5)
    rows = spark.range(300).select("id", F.when(F.col("id") % 50 != 0, F.col("id").cast("double")).alias("price"))
    by = {r["level"]: r for r in N.with_level(rows, "price").groupBy("level").agg(F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi")).collect()}
    assert sorted(by) == [0, 1, 2, 3] and 8 <= by[0]["n"] <= 13 and all(by[i]["lo"] > by[i + 1]["hi"] for i in range(3))
    assert N.with_level(rows.limit(0), "price").count() == 0


def test_bounds_of_levels_are_made_of_few_counts(spark, monkeypatch):
    """Quantile sketches of all partitions would go to the driver; counts by step are as many for any number of rows."""
    monkeypatch.setattr(N, "FIRST", 1000)
    monkeypatch.setattr(type(spark.range(1)), "approxQuantile", lambda *_: pytest.fail("a sketch of every partition goes to the driver"))
    rows = spark.range(60_000).select((F.col("id") + 10**9).alias("id"))
    for falling in (True, False):
        by = {r["level"]: r for r in N.with_level(rows, "id", falling).groupBy("level").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
        assert sorted(by) == [0, 1, 2] and 1000 <= by[0]["n"] <= 1010 and 15_000 <= by[1]["n"] <= 15_060
        assert all((by[i]["lo"] > by[i + 1]["hi"]) if falling else (by[i]["hi"] < by[i + 1]["lo"]) for i in (0, 1))
    assert [r[0] for r in N.with_level(rows.select(F.lit(1).alias("p")), "p").distinct().select("level").collect()] == [0]


def test_grams_and_probes(spark):
    df = spark.createDataFrame([("abcab",), ("ab",), ("",)], "t string")
    assert [sorted(r[0]) for r in df.select(N.grams(F.col("t"))).collect()] == [sorted({"a", "b", "c", "ab", "bc", "ca", "abc", "bca", "cab"}), ["a", "ab", "b"], []]
    assert [r[0] for r in df.where("t != ''").select(N.probes(F.col("t"))).collect()] == [["abc", "bca", "cab"], ["ab"]]


def test_look_ups_of_many_texts(spark, monkeypatch):
    monkeypatch.setattr(N, "FIRST", 4)
    monkeypatch.setattr(N, "GROWTH", 3)
    r = random.Random(3)
    texts = ["".join(r.choices("abcd ", k=r.randint(0, 12))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "id long, text string")
    asked = ["a", "AB", " abc ", "dcba", "", "  ", "zz", "a b", None, "abcd"]
    got = {(x["query_id"], x["rank"], x["id"]) for x in N.holding(rows, spark.createDataFrame(list(enumerate(asked)), "query_id int, text string"), 3).collect()}
    want = {(q, n + 1, i) for q, a in enumerate(asked) if a is not None for n, i in enumerate([i for i, t in enumerate(texts) if a.strip().lower() in t][:3])}
    assert got == want


def test_a_deep_page_reads_one_or_two_ranges(spark, tmp_path):
    rows = spark.range(2000).select("id", (F.col("id") * 7919 % 300).alias("p"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("b"), F.col("id") % 3)).alias("brand"))
    order, path = [F.desc("p"), F.col("id")], str(tmp_path / "list")
    directory.write(rows, path, order, ["brand"], size=150)
    every = sorted(((-r["p"], r["id"], r["brand"]) for r in rows.collect()))
    for wanted in ({}, {"brand": "b1"}, {"brand": None}):
        mine = [i for _, i, b in every if not wanted or b == wanted["brand"]]
        for n in (1, 2, 14, -(-len(mine) // 33), 10_000):
            df = directory.page(spark, path, order, n, 33, **wanted)
            got = df.collect()
            assert [r["id"] for r in got] == mine[(n - 1) * 33 : n * 33]
            assert all((r["total"], r["total_pages"]) == (len(mine), -(-len(mine) // 33)) for r in got)
            assert len(ranges_read(df)) <= (2 if not wanted else 3)
    with pytest.raises(ValueError, match="not written for"):
        directory.page(spark, path, order, 1, 10, p=3)


def ranges_read(df):
    """The ranges that the plan's scan is left with."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"\d+", "".join(re.findall(r"_range#\d+ IN \(([\d,]+)\)|\(_range#\d+ = (\d+)\)", plan)[0])) if "LocalRelation" not in plan else []


def test_only_vectors_whose_buckets_moved_are_made_again(spark):
    t = Tables(spark, fresh_root(spark, "deltas"), buckets=4)
    docs = spark.createDataFrame([(i, f"word{i % 40} word{i % 7} other{i % 90}") for i in range(200)], "doc_id long, text string")
    deltas.apply(t, "s", 0, docs)
    first, n = deltas.refresh(t)
    assert n == 200
    # the same document again: nothing moves
    deltas.apply(t, "s", 1, docs.where("doc_id = 5"))
    second, n = deltas.refresh(t, first)
    assert n == 0
    # a token gives way to one that the same number of documents has: the number of documents stays, two buckets move
    deltas.apply(t, "s", 2, spark.createDataFrame([(5, "word5 word5 word5 other5 fresh")], "doc_id long, text string"))
    third, n = deltas.refresh(t, second)
    assert 1 <= n < 200
    once = retrieval.terms(docs.where("doc_id != 5").unionByName(spark.createDataFrame([(5, "word5 word5 word5 other5 fresh")], "doc_id long, text string")), "doc_id")
    want = retrieval.doc_vectors(once, "doc_id", retrieval.bucket_idf(retrieval.idf(once, F.lit(200))))
    flat = lambda df: {(r["doc_id"], x["bucket"], round(x["w"], 9)) for r in df.collect() for x in r["v"]}
    assert flat(third["vectors"]) == flat(want)
    deltas.apply(t, "s", 3, docs.limit(0), docs.where("doc_id >= 100").select("doc_id"))
    fourth, _ = deltas.refresh(t, third)
    assert fourth["vectors"].count() == 100 and {r["df"] for r in fourth["vocabulary"].where("token = 'word3'").collect()} == {16}


def test_dense_queries_in_lots(spark, monkeypatch):
    r = random.Random(2)
    v = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)], "vec_id long, embedding array<double>")
    q = v.where("vec_id < 23").selectExpr("vec_id as query_id", "embedding as q")
    rows = lambda: {tuple(x) for x in retrieval.dense_topk(v, q, 3).collect()}
    want = rows()
    monkeypatch.setattr(retrieval, "QUERIES", 5)
    assert rows() == want and len(want) == 69


def test_vectors_of_terms_as_they_come_shuffle_texts_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 40} word{i % 7} other{i % 90}") for i in range(200)], "doc_id long, text string")
    terms = retrieval.terms(docs, "doc_id")
    buckets = kept(retrieval.bucket_idf(retrieval.idf(terms, F.lit(200))))
    dealt = retrieval.doc_vectors(terms, "doc_id", buckets, dealt=True)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan.partition("Initial Plan")[0])) == 1
    flat = lambda df: {(r["doc_id"], x["bucket"], round(x["w"], 9)) for r in df.collect() for x in r["v"]}
    assert flat(dealt) == flat(retrieval.doc_vectors(kept(terms), "doc_id", buckets))


def test_documents_are_rows_of_an_index_by_deltas(spark):
    t = Tables(spark, fresh_root(spark, "deltas"), buckets=3)
    docs = spark.createDataFrame([(i, f"word{i % 40} word{i % 7} other{i % 90}") for i in range(60)] + [(60, "- !"), (61, None), (None, "no key at all")], "doc_id long, text string")
    deltas.apply(t, "s", 0, docs)
    assert t.read("documents").count() == 63 and set(t.read("documents").columns) == {"doc_id", "tokens", "tf", "buckets", "print"}
    first, n = deltas.refresh(t, searched=False)
    assert n == 63 and "postings" not in first
    again = docs.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" and more")))
    deltas.apply(t, "s", 1, again, docs.where("doc_id is null or doc_id = 7").select("doc_id"))
    index, n = deltas.refresh(t, first)
    assert n == 60  # the number of documents is in every idf; one of the 61 has no token
    left = kept(docs.where("doc_id is not null and doc_id != 7 and doc_id % 3 != 0").unionByName(again))
    once = retrieval.terms(left, "doc_id")
    buckets = retrieval.bucket_idf(retrieval.idf(once, F.lit(61)))
    want = {(r["doc_id"], x["bucket"], round(x["w"], 9)) for r in retrieval.doc_vectors(once, "doc_id", buckets).collect() for x in r["v"]}
    assert {(r["doc_id"], x["bucket"], round(x["w"], 9)) for r in index["vectors"].collect() for x in r["v"]} == want
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "token", "tf").collect())
    assert rows(index["terms"]) == rows(once)


def test_buckets_are_dealt_without_looking_for_borders(spark):
    t = Tables(spark, fresh_root(spark, "dealt"), buckets=2)
    dealt = t._dealt(t.bucketed(spark.range(4000), "id"), "id")
    assert "rangepartitioning" not in dealt._jdf.queryExecution().executedPlan().toString()
    parts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("_bucket").alias("b"), F.count("*").alias("n")).collect()
    assert len(parts) == 4 and all(r["b"] == 1 and r["n"] > 700 for r in parts)
