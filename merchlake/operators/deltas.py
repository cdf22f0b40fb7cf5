"""A search index that is kept up: batches of new, changed and removed documents add to its counts, nothing is fitted anew.

What is kept: a row for every document, in buckets of its key, with its terms and all that its vector needs but the idf of
buckets; and signed counts of tokens and documents, a part for each batch. Reading adds the counts up. A bucket's idf moves
when its tokens' counts or the number of documents do; vectors are normalised again for documents that have such a bucket,
without their texts or terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlake.functions import words
from merchlake.operators import postings, retrieval
from merchlake.operators.commits import Tables
from merchlake.sources.scratch import fresh_root, kept

c = F.col


def _among(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """A semi or anti join by the key, null being a key like any other."""
    return rows.join(keys.select(c(key).alias("_k")), c(key).eqNullSafe(c("_k")), how)


def apply(tables: Tables, source: str, number: int, docs: DataFrame, removed: DataFrame | None = None, key: str = "doc_id") -> bool:
    """One batch: documents (key, text) that are new or have changed, and keys of those that go; each batch counts once.

    Rows of a key that is in both are taken as changed. A document that comes again as it was changes no count.
    """
    if tables.last(source) >= number:
        return False
    new = kept(retrieval.taken_apart(docs, key))
    gone = new.select(key) if removed is None else kept(new.select(key).unionByName(removed.select(key)).distinct())
    known = tables.read("documents")
    tokens = lambda rows, d: rows.where("tokens != ''").select(F.explode(F.split("tokens", " ")).alias("token"), F.lit(d).alias("d"))
    counted, n = tokens(new, 1), new.select(F.lit(1).alias("d"))
    if known is not None:
        counted = counted.unionByName(tokens(_among(known.select(key, "tokens"), gone, key, "left_semi"), -1))
        n = n.unionByName(_among(known.select(key), gone, key, "left_semi").select(F.lit(-1).alias("d")))
    counts = counted.groupBy("token").agg(F.sum("d").alias("df")).where("df != 0")
    total = n.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n"))
    return tables.commit(source, number, {"documents": (new, key)}, {"documents": gone}, {"counts": counts, "numbers": total}, written=("documents",))


def vocabulary(tables: Tables) -> DataFrame:
    """(token, bucket, df, idf) of all batches together."""
    n = tables.read("numbers").agg(F.sum("n")).first()[0]
    df = tables.read("counts").groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
    return retrieval.with_idf(df, F.lit(n)).select("token", "bucket", "df", "idf")


def compact(tables: Tables) -> None:
    """Adds the parts of the counts up to one; the sums are those of before."""
    for name, sums in (("counts", lambda df: df.groupBy("token").agg(F.sum("df").alias("df")).where("df != 0")), ("numbers", lambda df: df.agg(F.sum("n").alias("n")))):
        tables.compact(name, sums)


def refresh(tables: Tables, index: dict[str, DataFrame] | None = None, key: str = "doc_id", searched: bool = True) -> tuple[dict[str, DataFrame], int]:
    """The index as of all batches, for `retrieval.search_index`, and how many vectors had to be normalised.

    With the `index` that an earlier call gave, vectors are taken over where neither the document's terms nor the idf of
    any of its buckets has changed. Where the idf of all buckets has, nothing is taken over, and no vector moves.
    An index that is not to be `searched`, but given to a later call, has no postings.
    """
    docs, vocab = tables.read("documents"), kept(vocabulary(tables))
    buckets = kept(retrieval.bucket_idf(vocab))
    prints, means = kept(docs.select(key, "print")), retrieval.means_of(buckets)
    vector = lambda rows: rows.select(key, words.weighted(c("buckets"), means).alias("x")).select(key, "x.*")
    if index is None:
        made, n = vector(docs), prints.count()
    else:
        before = retrieval.means_of(index["buckets"])
        moved = [b for b, idf in means.items() if before.get(b) != idf]
        touched = words.has_any(c("buckets"), moved)
        old = index["prints"].select(c(key).alias("_k"), c("print").alias("_p"))
        changed = kept(prints.join(old, c(key).eqNullSafe(c("_k")) & (c("print") == c("_p")), "left_anti").select(key))
        if len(moved) == len(means):
            made = vector(docs)
            n = docs.where(F.length("buckets") > 0).count() + _among(docs.where(F.length("buckets") == 0).select(key), changed, key, "left_semi").count()
        else:
            stale = kept(docs.where(touched).select(key).unionByName(changed).distinct())
            n = stale.count()
            same = _among(_among(index["vectors"], stale, key, "left_anti"), prints, key, "left_semi")
            made = vector(_among(docs, stale, key, "left_semi")).unionByName(same)
    vectors, root = kept(made), fresh_root(docs.sparkSession, "postings")
    found = {"terms": retrieval.terms_of(docs, key), "vocabulary": vocab, "buckets": buckets, "vectors": vectors, "prints": prints}
    if not searched:
        return found, n
    postings.write(vectors, root, key)
    return found | {"postings": postings.load(docs.sparkSession, root, dict(vectors.dtypes)[key])}, n
