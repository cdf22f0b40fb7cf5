"""Queries on retrieval over documents and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.functions import words
from merchlake.operators import deltas, postings
from merchlake.operators import retrieval as R
from merchlake.operators.catalog import where
from merchlake.operators.commits import Tables
from merchlake.sources.catalog import table
from merchlake.sources.scratch import fresh_root, kept

QUERIES, ORACLE_SQL = {}, {}
c = F.col
_ASKED = [(1, "that the thonou, and entther was inly"), (2, "oninth anshe of the handre"), (3, "de la queción los"), (4, "not-a-word-here zzz")]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


_RX = "[A-Za-z0-9]+(?:[-_/][A-Za-z0-9]+)*"
_TOKENS = lambda src, key: f"SELECT {key}, t.pos - 1 AS pos, t.tok AS token FROM (SELECT {key}, unnest(list_transform(list_filter(regexp_extract_all(lower(coalesce(text, '')), '{_RX}', 0), lambda x: length(x) > 1), lambda x, i: {{'pos': i, 'tok': x}})) AS t FROM {src})"
_HASH = lambda x, seed: f"('0x' || substr(sha1('{seed}:' || {x}), 1, 8))::BIGINT"
_BASE = f"""WITH tok AS ({_TOKENS('documents', 'doc_id')}), idf AS (SELECT token, count(DISTINCT doc_id) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(DISTINCT doc_id))) + 1 AS idf FROM tok GROUP BY token),
bidf AS (SELECT {_HASH('token', 0)} % 384 AS bucket, avg(idf) AS idf FROM idf GROUP BY 1)"""
_VEC = lambda src, key: f"(SELECT {key}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM (SELECT {key}, bucket, sign * (1 + ln(tf)) * coalesce(idf, 1.0) AS w FROM (SELECT {key}, {_HASH('token', 0)} % 384 AS bucket, count(*) AS tf, arg_max(CASE WHEN {_HASH('token', 1)} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END, pos) AS sign FROM {src} GROUP BY ALL) LEFT JOIN bidf USING (bucket)))"
_Q = f"asked AS (SELECT unnest([{', '.join(str(i) for i, _ in _ASKED)}]) AS query_id, unnest([{', '.join(repr(t) for _, t in _ASKED)}]) AS text), qtok AS ({_TOKENS('asked', 'query_id')})"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.terms(_docs(spark, sf_dir), "doc_id")


def _idf(spark: SparkSession, sf_dir: str, terms: DataFrame) -> DataFrame:
    return R.idf(terms, F.lit(_docs(spark, sf_dir).count()))


def _asked(spark: SparkSession) -> DataFrame:
    return R.terms(spark.createDataFrame(_ASKED, "query_id int, text string"), "query_id")


@query(_BASE + " SELECT doc_id, count(*) AS tokens, count(DISTINCT token) AS vocabulary FROM tok GROUP BY doc_id")
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).groupBy("doc_id").agg(F.sum("tf").alias("tokens"), F.count("*").alias("vocabulary"))


@query(_BASE + " SELECT token, df, round(idf, 9) AS idf FROM idf")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _idf(spark, sf_dir, _terms(spark, sf_dir)).select("token", "df", F.round("idf", 9).alias("idf"))


@query(_BASE + " SELECT bucket, round(idf, 9) AS idf FROM bidf")
def bucket_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bucket_idf(_idf(spark, sf_dir, _terms(spark, sf_dir))).select("bucket", F.round("idf", 9).alias("idf"))


@query(_BASE + f" SELECT doc_id, bucket, round(weight, 9) AS weight FROM {_VEC('tok', 'doc_id')}")
def hash_vectors_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir)[2].select("doc_id", F.inline("v")).select("doc_id", "bucket", F.round("w", 9).alias("weight"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The vocabulary with idf, the mean idf of buckets, and the documents' vectors (doc_id, v, s)."""
    docs = _docs(spark, sf_dir)
    texts = R.one_each(docs, "doc_id")
    idf = kept(R.with_idf(R.vocabulary(texts), F.lit(docs.count())))
    buckets = kept(R.bucket_idf(idf))
    return idf, buckets, texts.select("doc_id", words.vectors(c("text"), R.means_of(buckets)).alias("x")).select("doc_id", "x.*")


def _nearest(spark: SparkSession, buckets: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    entries = vectors.select("doc_id", F.inline("v")).withColumnRenamed("w", "weight")
    return R.top(R.cosine(kept(R.vectors(_asked(spark), "query_id", buckets)), entries, "doc_id"), "doc_id", k)


_MODES = f"""{_BASE}, r AS (SELECT doc_id, {_HASH('token', 0)} % 384 AS bucket, count(*) AS tf, arg_max(CASE WHEN {_HASH('token', 1)} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END, pos) AS sign, max(idf) AS t_idf FROM tok JOIN idf USING (token) GROUP BY ALL),
w AS (SELECT doc_id, bucket, sign * (1 + ln(tf)) AS plain, sign * (1 + ln(tf)) * t_idf AS by_token FROM r)"""


@query(f"{_MODES} SELECT doc_id, bucket, round(plain / sqrt(sum(plain * plain) OVER d), 9) AS plain, round(by_token / sqrt(sum(by_token * by_token) OVER d), 9) AS by_token FROM w WINDOW d AS (PARTITION BY doc_id)")
def hash_vectors_weightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by counts alone, and by the idf of tokens."""
    return R.weightings(_docs(spark, sf_dir), kept).select("doc_id", "bucket", F.round("plain", 9).alias("plain"), F.round("by_token", 9).alias("by_token"))


_COS = f"dv AS {_VEC('tok', 'doc_id')}, qv AS {_VEC('qtok', 'query_id')}, cs AS (SELECT query_id, doc_id, round(sum(dv.weight * qv.weight), 9) AS score FROM dv JOIN qv USING (bucket) GROUP BY ALL), cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM cs QUALIFY rank < 25)"
_BM = "bm AS (SELECT query_id, doc_id, round(coalesce(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean_len))), 0), 9) AS score FROM (SELECT c.query_id, c.doc_id, len, avg(len) OVER (PARTITION BY c.query_id) AS mean_len FROM cand c JOIN (SELECT doc_id, greatest(count(*), 1) AS len FROM tok GROUP BY doc_id) USING (doc_id)) s LEFT JOIN (SELECT query_id, t.doc_id, t.token, any_value(idf) AS idf, count(*) AS tf FROM tok t JOIN (SELECT DISTINCT query_id, token FROM qtok) q USING (token) JOIN idf USING (token) GROUP BY ALL) USING (query_id, doc_id) GROUP BY query_id, doc_id)"


@query(f"{_BASE}, {_Q}, {_COS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM cand WHERE rank < 10")
def cosine_topk_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, buckets, vectors = _vectors(spark, sf_dir)
    return _nearest(spark, buckets, vectors, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(ORACLE_SQL["cosine_topk_sparse"])
def postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a written index of postings, of which only cells that can still matter are read."""
    found, _ = _from_postings(spark, sf_dir, 10)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _from_postings(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    _, buckets, vectors = _vectors(spark, sf_dir)
    root = fresh_root(spark, "postings")
    postings.write(kept(vectors), root, "doc_id")
    return postings.top(postings.load(spark, root), R.vectors(_asked(spark), "query_id", buckets), "doc_id", k, kept)


@query(f"{_BASE}, {_Q} SELECT query_id, count(*) AS postings, true AS below FROM (SELECT DISTINCT doc_id, {_HASH('token', 0)} % 384 AS bucket FROM tok) JOIN (SELECT DISTINCT query_id, {_HASH('token', 0)} % 384 AS bucket FROM qtok) USING (bucket) GROUP BY query_id")
def postings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many postings each query's buckets have, and whether fewer were read than that to find its best document."""
    _, share = _from_postings(spark, sf_dir, 1)
    return share.select("query_id", "postings", (c("postings_read") < c("postings")).alias("below"))


@query(f"{_BASE}, {_Q}, {_COS}, {_BM} SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    idf, buckets, vectors = _vectors(spark, sf_dir)
    found = kept(_nearest(spark, buckets, vectors, 25).select("query_id", "doc_id"))
    # only candidates are taken apart into tokens
    terms = R.terms(_docs(spark, sf_dir).join(found, "doc_id", "left_semi"), "doc_id")
    found = R.bm25(found, terms, _asked(spark), idf, "doc_id")
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"))


_MM = lambda x: f"(CASE WHEN max({x}) OVER w - min({x}) OVER w < 1e-9 THEN 0.0::DOUBLE ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END)"


@query(f"{_BASE}, {_Q}, {_COS}, {_BM}, h AS (SELECT query_id, doc_id, round(0.5::DOUBLE * {_MM('cand.score')} + 0.5::DOUBLE * {_MM('bm.score')}, 6) AS score FROM cand JOIN bm USING (query_id, doc_id) WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM h QUALIFY rank < 5")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(_ASKED, "query_id int, text string")
    return R.search(_docs(spark, sf_dir), asked, kept, fresh_root(spark, "index")).select("query_id", "doc_id", "score", "rank")


@query(ORACLE_SQL["hybrid_search"])
def index_built_and_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that is fitted, written, loaded and searched gives what a search over the documents gives."""
    root = fresh_root(spark, "index")
    R.build_index(_docs(spark, sf_dir), root)
    asked = spark.createDataFrame(_ASKED, "query_id int, text string")
    return R.search_index(R.load_index(spark, root), asked, kept).select("query_id", "doc_id", "score", "rank")


@query(ORACLE_SQL["hybrid_search"])
def index_after_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that has come about by three batches, with documents that changed and went, gives what one fitted at once gives."""
    docs, tables = _docs(spark, sf_dir).select("doc_id", "text"), Tables(spark, fresh_root(spark, "deltas"), buckets=8)
    other = docs.where("doc_id % 4 = 0").withColumn("text", F.concat(F.lit("altogether otherwise "), F.upper("text")))
    wrong = docs.where("doc_id % 5 = 0").select((-1 - c("doc_id")).alias("doc_id"), "text")
    deltas.apply(tables, "docs", 0, docs.where("doc_id % 3 != 0 and doc_id % 4 != 0").unionByName(other))
    deltas.apply(tables, "docs", 1, docs.where("doc_id % 3 = 0 and doc_id % 4 != 0").unionByName(wrong))
    first, _ = deltas.refresh(tables, searched=False)
    for _ in range(2):
        deltas.apply(tables, "docs", 2, docs.where("doc_id % 4 = 0"), wrong.select("doc_id"))
    deltas.compact(tables)
    index, _ = deltas.refresh(tables, first)
    asked = spark.createDataFrame(_ASKED, "query_id int, text string")
    return R.search_index(index, asked, kept).select("query_id", "doc_id", "score", "rank")


_SOME = "(SELECT * FROM tok WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars <= 3000 AND lang <> 'es' AND contains(text, 'the')))"


@query(f"{_BASE}, {_Q}, {_COS.replace(_VEC('tok', 'doc_id'), _VEC(_SOME, 'doc_id'))}, {_BM}, h AS (SELECT query_id, doc_id, round(0.3::DOUBLE * {_MM('cand.score')} + 0.7::DOUBLE * {_MM('bm.score')}, 6) AS score FROM cand JOIN bm USING (query_id, doc_id) WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM h QUALIFY rank < 3")
def hybrid_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search among documents that meet conditions on metadata and text."""
    asked = spark.createDataFrame(_ASKED, "query_id int, text string")
    some = where(R.parsed_where(["n_chars<=3000", "lang != 'es'"]))
    return R.search(_docs(spark, sf_dir), asked, kept, fresh_root(spark, "index"), where=some, where_document=F.contains("text", F.lit("the")), k=3, alpha=0.3).select("query_id", "doc_id", "score", "rank")


def _dense(spark: SparkSession, sf_dir: str, metric: str, where_: dict | None = None) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id < 5").select(c("vec_id").alias("query_id"), c("embedding").alias("q"))
    return R.dense_topk(v.where(where(where_ or {})), q, 5, metric).select("query_id", "vec_id", "score", "rank")


_DOT = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_DENSE = lambda score, cond="true": f"WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id < 5), s AS (SELECT query_id, vec_id, round({score}, 6) + 0.0::DOUBLE AS score FROM embeddings, q WHERE {cond}) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM s QUALIFY rank < 5"
_COSINE = f"{_DOT('embedding', 'q')} / sqrt({_DOT('embedding', 'embedding')} * {_DOT('q', 'q')})"


@query(_DENSE(_COSINE))
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "cosine")


@query(_DENSE(_COSINE, "(label >= 2 AND label < 7 AND vec_id <> 100) AND (label = 3 OR vec_id < 300)"))
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "cosine", {"$and": [{"label": {"$gte": 2, "$lt": 7}}, {"vec_id": {"$ne": 100}}, {"$or": [{"label": 3}, {"vec_id": {"$lt": 300}}]}]})


@query(_DENSE("-list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - q[i]::DOUBLE) * (embedding[i]::DOUBLE - q[i]::DOUBLE)))"))
def vector_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "l2")


@query(_DENSE(f"{_DOT('embedding', 'q')} - 1"))
def vector_topk_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, "ip")


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_FIRST = rf"coalesce(nullif(regexp_extract({_FLAT}, '^(.*?[.!?])\s', 1), ''), {_FLAT})"


@query(rf"SELECT doc_id, CASE WHEN length({_FLAT}) <= 280 THEN {_FLAT} ELSE rtrim(regexp_replace({_FLAT}[:280], '\s\S*$', '')) || '…' END AS snippet, CASE WHEN length({_FIRST}) <= 140 THEN {_FIRST} ELSE rtrim({_FIRST}[:139]) || '…' END AS sentence FROM documents")
def snippet_first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.snippet(c("text")).alias("snippet"), T.first_sentence(c("text")).alias("sentence"))
