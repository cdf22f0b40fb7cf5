"""Hybrid retrieval: inverse document frequencies, sparse hashed vectors, cosine and BM25 scores, blending; dense vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.functions import words
from merchlake.operators import postings
from merchlake.sources.scratch import spread

c = F.col
DIM = words.DIM
K1, B = 1.5, 0.75
#: Dense queries that are broadcast at once, about.
QUERIES = 1000
#: Tokens that tasks know the number of documents of, at most, and steps of a power of two in which that number is counted to choose them.
COMMON, STEPS = 1 << 17, 16
#: Bytes of texts in one Arrow batch, about.
BATCH_BYTES = 8 << 20


def token_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, token), a row for each token. Texts are dealt by their key, so what is grouped by it then moves no token."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(key, text).repartition(tasks, key).select(key, F.posexplode(T.tokens(c(text))).alias("pos", "token"))


def terms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, tf, last, bucket, sign), a row for each different token of a document.

    This is what everything else here is made from. Rows come dealt by key; written and read again they are not.
    """
    t = token_rows(docs, key, text).groupBy(key, "token").agg(F.count("*").alias("tf"), F.max("pos").alias("last"))
    return t.withColumns({"bucket": bucket_of(c("token")), "sign": F.when(T.token_hash(c("token"), 1) % 2 == 0, 1.0).otherwise(-1.0)})


def one_each(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text): lower-case texts, one for each key. Where keys tell documents apart, which the keys alone show, no text moves; texts of one key are one document."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    texts = docs.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    if docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return spread(texts)
    return texts.groupBy(key).agg(F.array_join(F.collect_list("text"), "\n").alias("text"))


def taken_apart(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, tokens, tf, buckets, print), a row for each document: what `words.counted` makes of it, and a hash of that."""
    made = one_each(docs, key, text).select(key, words.counted(c("text")).alias("x"))
    return made.select(key, "x.*", F.xxhash64("x.tokens", "x.tf", "x.buckets").alias("print"))


def terms_of(apart: DataFrame, key: str) -> DataFrame:
    """(key, token, tf), a row for each different token, of what `taken_apart` gives."""
    split = lambda n: F.split(n, " ")
    pairs = F.arrays_zip(split("tokens").alias("token"), F.transform(split("tf"), lambda n: n.cast("long")).alias("tf"))
    return apart.where("tokens != ''").select(key, F.inline(pairs))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(token, df) of what `one_each` gives."""
    return texts.select(F.explode(F.array_distinct(T.tokens(c("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def with_idf(vocab: DataFrame, documents: Column) -> DataFrame:
    """A vocabulary with the bucket and smoothed idf of each token."""
    return vocab.withColumns({"bucket": bucket_of(c("token")), "idf": F.log((1 + documents) / (1 + c("df"))) + 1})


def common_tokens(vocab: DataFrame, most: int | None = None) -> dict[str, int]:
    """The tokens that most documents have, `most` (COMMON) at most, with that number; how many have it is counted first, so no more than those are gathered."""
    step = F.floor(F.log2("df") * STEPS)
    least, n = None, 0
    for r in sorted(vocab.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # a few hundred
        n += r["count"]
        if n > (COMMON if most is None else most):
            break
        least = r["step"]
    return {} if least is None else {r["token"]: r["df"] for r in vocab.where(step >= least).select("token", "df").collect()}


def weightings(docs: DataFrame, keep: Callable[[DataFrame], DataFrame], key: str = "doc_id", most: int | None = None) -> DataFrame:
    """(key, bucket, plain, by_token): vectors of length 1 by counts alone, and by counts times the greatest idf of a bucket's tokens.

    The greatest idf is that of the token which fewest documents have. Tasks know this number for the COMMON tokens, so
    of most tokens no row is made; rows of the others, of which none has many documents, meet the vocabulary.
    """
    texts, n = one_each(docs, key), F.lit(docs.count())
    vocab = keep(vocabulary(texts))
    made = keep(texts.select(key, words.apart_by_rarity(c("text"), common_tokens(vocab, most)).alias("x")).select(key, "x.*"))
    rare = made.select(key, F.inline("rare")).join(vocab, "token").groupBy(key, "bucket").agg(F.min("df").alias("df"))
    rare = rare.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "df"))).alias("rarer"))
    own = made.select(c(key).alias("_key"), key, "buckets")
    every = own.join(rare.withColumnRenamed(key, "_of"), c("_key").eqNullSafe(c("_of")), "left")
    weight = lambda x: x["sign"] * (1 + F.log(x["tf"].cast("double")))
    idf_ = lambda df: F.log((1 + n) / (1 + df)) + 1
    v = F.transform("buckets", lambda x: F.struct(x["bucket"].alias("bucket"), weight(x).alias("plain"), (weight(x) * idf_(F.least(x["df"], F.try_element_at("rarer", x["bucket"])))).alias("by_token")))
    return every.select(key, F.inline(_unit(v, ["plain", "by_token"])))


def means_of(buckets: DataFrame) -> dict[int, float]:
    """The mean idf of buckets, DIM at most, for the tasks that make vectors."""
    return {r["bucket"]: r["idf"] for r in buckets.collect()}


def idf(term_df: DataFrame, documents: Column) -> DataFrame:
    """(token, df, idf): ln((1 + N) / (1 + df)) + 1, smoothed; terms have each token of a document once."""
    seen = term_df.groupBy("token", "bucket").agg(F.count("*").alias("df"))
    return seen.withColumn("idf", F.log((1 + documents) / (1 + c("df"))) + 1)


def bucket_of(token: Column) -> Column:
    return T.token_hash(token) % DIM


def bucket_idf(idf_df: DataFrame) -> DataFrame:
    """(bucket, idf): the mean over the vocabulary."""
    return idf_df.groupBy("bucket").agg(F.avg("idf").alias("idf"))


def doc_vectors(term_df: DataFrame, key: str, buckets: DataFrame | None = None, token_idf: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """(key, v): sparse signed vectors of length 1, v being an array of structs of bucket and weight w.

    A bucket's weight is (1 + ln of its tokens), times the bucket's mean idf if `buckets` (DIM rows at most) is given, or
    times the greatest idf of its tokens if `token_idf` is; without either the count alone weighs. Its sign is that of the
    last token in it. `dealt` says that the terms are as `terms` makes them, not reread: then no row is shuffled here.
    """
    if token_idf is not None:
        term_df = term_df.join(token_idf.select("token", c("idf").alias("t_idf")), "token", "left")
    weight = F.max("t_idf").alias("t_idf") if token_idf is not None else F.lit(None).cast("double").alias("t_idf")
    raw = _by_bucket(term_df, key, weight, dealt and token_idf is None)
    raw = raw.join(F.broadcast(buckets), "bucket", "left") if buckets is not None else raw.withColumn("idf", F.lit(None).cast("double"))
    w = c("sign") * (1 + F.log("tf")) * F.coalesce("t_idf", "idf", F.lit(1.0))
    every = raw.groupBy(key).agg(F.collect_list(F.struct("bucket", w.alias("w"))).alias("v"))
    return every.select(key, _unit(c("v"), ["w"]).alias("v"))


def _by_bucket(term_df: DataFrame, key: str, weight: Column, dealt: bool) -> DataFrame:
    """(key, bucket, tf, sign, and what `weight` makes); dealt by documents once, so no grouping by them moves a row again."""
    rows = term_df if dealt else term_df.repartition(key)
    return rows.groupBy(key, "bucket").agg(F.sum("tf").alias("tf"), F.max_by("sign", "last").alias("sign"), weight)


def _unit(v: Column, names: list[str]) -> Column:
    """Entries of v with each of the named weights brought to length 1."""
    norm = lambda n: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x[n] * x[n]))
    # lengths are made once for each vector: as plain columns they would be put into the inner expression, and made for each entry
    unit = lambda of: F.transform(v, lambda x: F.struct(x["bucket"].alias("bucket"), *[(x[n] / of[n]).alias(n) for n in names]))
    return F.transform(F.array(F.struct(*[norm(n).alias(n) for n in names])), unit)[0]


def vectors(term_df: DataFrame, key: str, buckets: DataFrame | None = None, token_idf: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """(key, bucket, weight): `doc_vectors`, a row for each bucket."""
    return doc_vectors(term_df, key, buckets, token_idf, dealt).select(key, F.explode("v").alias("x")).select(key, "x.bucket", c("x.w").alias("weight"))


def top(scored: DataFrame, key: str, k: int, by: str = "score") -> DataFrame:
    """The best k of each query, numbered from 0."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), key)
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(c("rank") < k)


def cosine(query_vectors: DataFrame, doc_vectors: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score): dot products over shared buckets."""
    q = query_vectors.withColumnRenamed("weight", "qw")
    return doc_vectors.join(q, "bucket").groupBy("query_id", key).agg(F.round(F.sum(c("weight") * c("qw")), 9).alias("score"))


def bm25(candidates: DataFrame, term_df: DataFrame, query_terms: DataFrame, idf_df: DataFrame, key: str) -> DataFrame:
    """(query_id, key, score) of the candidates (query_id, key); lengths are compared with the mean of the query's candidates."""
    # terms are read once: of a candidate's, those that the query has come out as a list, and all add to its length
    asked = query_terms.select("query_id", "token").join(idf_df.select("token", "idf"), "token")
    chosen = term_df.select(key, "token", "tf").join(candidates.select(key).distinct(), key, "left_semi")
    met = candidates.join(chosen, key).join(asked, ["query_id", "token"], "left")
    met = met.groupBy("query_id", key).agg(F.sum("tf").alias("len"), F.collect_list(F.when(c("idf").isNotNull(), F.struct("idf", "tf"))).alias("words"))
    sized = candidates.join(met, ["query_id", key], "left").withColumn("len", F.coalesce("len", F.lit(1))).withColumn("mean_len", F.avg("len").over(Window.partitionBy("query_id")))
    part = lambda x: x["idf"] * x["tf"] * (K1 + 1) / (x["tf"] + K1 * (1 - B + B * c("len") / c("mean_len")))
    return sized.select("query_id", key, F.round(F.coalesce(F.aggregate("words", F.lit(0.0), lambda s, x: s + part(x)), F.lit(0.0)), 9).alias("score"))


def min_max(name: str) -> Column:
    """A score brought to 0..1 among the candidates of its query; 0 for all if they are the same."""
    w = Window.partitionBy("query_id")
    low, high = F.min(name).over(w), F.max(name).over(w)
    return F.when(high - low < 1e-9, F.lit(0.0)).otherwise((c(name) - low) / (high - low))


def hybrid(cosines: DataFrame, bm25s: DataFrame, key: str, alpha: float = 0.5, k: int = 5) -> DataFrame:
    """The best k candidates of each query by alpha of the normalised cosine and the rest of the normalised BM25."""
    both = cosines.select("query_id", key, c("score").alias("cosine")).join(bm25s.select("query_id", key, c("score").alias("bm25")), ["query_id", key])
    blended = both.withColumn("score", F.round(alpha * min_max("cosine") + (1 - alpha) * min_max("bm25"), 6))
    return top(blended, key, k)


def dense_topk(vecs: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, vec_id, score, rank): exact nearest vectors of `queries` (query_id, q).

    Queries are broadcast, QUERIES at a time; each lot goes through all vectors. Scores are 1 - distance for cosine, and minus the distance for l2 (squared) and ip (1 - inner product).
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v, q = c("embedding"), c("q")
    apart = F.aggregate(F.zip_with(v, q, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    score = {"cosine": dot(v, q) / F.sqrt(dot(v, v) * dot(q, q)), "ip": dot(v, q) - 1, "l2": -apart}[metric]
    lots = -(-queries.count() // QUERIES)
    best = None
    for n in range(max(1, lots)):
        lot = queries if lots <= 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(lots)) == n)
        found = top(vecs.join(F.broadcast(lot)).select("query_id", "vec_id", (F.round(score, 6) + 0.0).alias("score")), "vec_id", k)
        best = found if best is None else best.unionByName(found)
    return best


def build_index(docs: DataFrame, root: str, key: str = "doc_id") -> None:
    """Fits an index and writes it under `root`: terms, vocabulary with idf, mean idf of buckets, vectors, their postings, and metadata.

    Metadata are the columns of `docs` besides key and text, where they are not null.
    """
    spark = docs.sparkSession
    written = {}

    def write(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        written[name] = spark.read.schema(df.schema).parquet(f"{root}/{name}")

    texts = one_each(docs, key)
    write("vocabulary", with_idf(vocabulary(texts), F.lit(docs.count())))
    write("buckets", bucket_idf(written["vocabulary"]))
    # terms and vectors come out of one walk over the texts
    write("terms", texts.select(key, words.vectors(c("text"), means_of(written["buckets"]), with_terms=True).alias("x")).select(key, "x.*"))
    postings.write(written["terms"].select(key, "v", "s"), f"{root}/postings", key)
    meta = [n for n in docs.columns if n not in (key, "text")]
    pairs = F.array(F.struct(F.lit("").alias("k"), F.lit(None).cast("string").alias("v")), *[F.struct(F.lit(n).alias("k"), c(n).cast("string").alias("v")) for n in meta])
    write("metadata", docs.select(key, F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull())).alias("metadata")))


def load_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a written index by name."""
    index = {n: spark.read.parquet(f"{root}/{n}") for n in ("terms", "vocabulary", "buckets", "metadata")}
    key, made = index["terms"].columns[0], index["terms"]
    index |= {"terms": made.select(key, F.inline("terms")), "vectors": made.where(F.size("v") > 0).select(key, "v")}
    return index | {"postings": postings.load(spark, f"{root}/postings", index["vectors"].dtypes[0][1])}


def search_index(index: dict[str, DataFrame], requests: DataFrame, keep: Callable[[DataFrame], DataFrame], key: str = "doc_id", only: DataFrame | None = None, k: int = 5, candidates: int = 25, alpha: float = 0.5) -> DataFrame:
    """(query_id, key, score, rank): the best k documents for each request (query_id, text) by vectors, then words, over a written index.

    With `only`, a table of keys, other documents are no candidates, while idf is that of all.
    """
    asked = keep(terms(requests, "query_id"))
    found, _ = postings.top(index["postings"], vectors(asked, "query_id", index["buckets"]), key, max(candidates, k), keep, only)
    return hybrid(found, bm25(found.select("query_id", key), index["terms"], asked, index["vocabulary"], key), key, alpha, k)


def search(docs: DataFrame, requests: DataFrame, keep: Callable[[DataFrame], DataFrame], root: str, key: str = "doc_id", where: Column | None = None, where_document: Column | None = None, k: int = 5, candidates: int = 25, alpha: float = 0.5) -> DataFrame:
    """`search_index` over documents that have no index yet: one is built under `root`.

    `where` is a condition on the columns of `docs` and `where_document` one on its text; only such documents are candidates.
    """
    build_index(docs, root, key)
    only = docs
    for condition in (where, where_document):
        only = only if condition is None else only.where(condition)
    only = None if where is None and where_document is None else only.select(key)
    return search_index(load_index(docs.sparkSession, root), requests, keep, key, only, k, candidates, alpha)


# Operators of a condition text, the longest first
COMPARISONS = [("<=", "$lte"), (">=", "$gte"), ("!=", "$ne"), ("<", "$lt"), (">", "$gt"), ("=", "$eq")]


def parsed_value(text: str) -> int | float | str:
    """A value of a condition: an int, else a float, else the text without its quotes."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text.strip("\"'")


def parsed_where(conditions: list[str]) -> dict:
    """Conditions such as price<=30000 or brand=Samsung as a filter for `catalog.where`; several are joined by $and."""
    out = []
    for text in conditions:
        for sign, name in COMPARISONS:
            field, found, value = text.partition(sign)
            if found and field.strip():
                out.append({field.strip(): parsed_value(value.strip()) if name == "$eq" else {name: parsed_value(value.strip())}})
                break
        else:
            raise ValueError(f"no comparison in {text!r}")
    return out[0] if len(out) == 1 else {"$and": out} if out else {}
