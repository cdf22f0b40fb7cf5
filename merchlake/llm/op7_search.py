"""Exact top-k BM25 search: an inverted index per shard with block-max WAND pruning, merged by global statistics."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.llm.common import Scratch, small_batches

K1, B = 1.5, 0.75
#: Documents and words in a shard, about; its index is all that a task holds.
SHARD_ROWS = 16_384
SHARD_WORDS = 6_000_000
#: Blocks of a shard; for each term and block the index keeps the largest weight.
BLOCKS = 16
#: Blocks that are scored together at most, before the threshold is looked at again.
STEP = 8
#: Lists of so many postings are cursors' lists, looked into where a block's bound asks for it; shorter ones are added as they are.
LONG = 1024
#: Stretches of so many postings are added slice by slice, shorter ones all at once by their places.
SLICE = 64
#: A list that holds one in so many documents of a block, and this many at least, is kept whole there, with noughts for the others.
FULL, FULL_LEAST = 6, 8
#: Queries for which whole lists are added up at once.
TOGETHER = 64
#: Terms, the most common ones of a shard, by which its documents are put in order.
ORDER_TERMS = 256
#: Characters that are hashed at once, about.
PIECE = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    """For every code point whether it belongs to words: letters, digits and _, as for \\w of regular expressions."""
    return np.fromiter((ch.isalnum() or ch == "_" for ch in map(chr, range(0x110000))), bool, 0x110000)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2 ** 64."""
    up, down = np.full(n, _MULTIPLIER, np.uint64), np.full(n, pow(_MULTIPLIER, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, and their 64-bit hashes, by sums over the whole text at once."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = _word_characters()[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    up, down = _powers(max(2 * PIECE, 1 << len(points).bit_length()))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mix((points.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER)) * up[: len(points)], out=sums[1:])
    return begin, _mix((sums[end] - sums[begin]) * down[begin])


def term_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its terms, as 64-bit hashes of lower-case words, sorted, and how often each is there.

    Many short texts are hashed at once, and long ones in pieces that end between words.
    """
    held: list[str] = []
    size = 0
    for text in texts:
        low = (text or "").lower()
        if size and size + len(low) > PIECE:
            yield from _counted(held)
            held, size = [], 0
        if len(low) > PIECE:
            yield _long(low)
        else:
            held.append(low)
            size += len(low) + 1
    if held:
        yield from _counted(held)


def _counted(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    begin, h = _hashed("\n".join(texts))
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(begin, starts)
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield _distinct(h[a:b])


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(np.append(first, len(h)))


def _long(text: str) -> tuple[np.ndarray, np.ndarray]:
    found, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end += 1
        found.append(_hashed(text[at:end])[1])
        at = end
    return _distinct(np.concatenate(found))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents, tokens) of rows (text), summed within the task; a null term stands for all documents."""
    docs, tokens, found, size = 0, 0, [], 0

    def summed() -> pa.RecordBatch:
        t, n = _distinct(np.concatenate(found))
        return pa.record_batch({"term": pa.array(t.view(np.int64)), "docs": pa.array(n), "tokens": pa.array(np.zeros(len(t), np.int64))})

    for batch in batches:
        for t, n in term_counts(batch.column(0).to_pylist()):
            docs += 1
            tokens += int(n.sum())
            found.append(t)
            size += len(t)
        if size > 4_000_000:
            yield summed()
            found, size = [], 0
    if size:
        yield summed()
    yield pa.record_batch({"term": pa.array([None], pa.int64()), "docs": pa.array([docs], pa.int64()), "tokens": pa.array([tokens], pa.int64())})


class Index:
    """The inverted index of one shard: a list of postings for each term, by document, cut at the borders of blocks.

    A block is so many neighbouring documents, the same ones in every list; for each term and block the index has the
    largest weight, and where the block's postings begin. Where a block's list is long, it is kept whole, a weight for every
    document: these are the rows of a matrix for each block, and what they add to the documents of a block is a product
    for many queries at once. Documents are given in the order of their ids, which settles ties.
    """

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], mean_length: float):
        """Takes `terms` and `counts` (of each document) out of their lists, so that they are not there twice."""
        sizes = np.array([len(t) for t in terms], np.int64)
        length = np.array([c.sum() for c in counts], np.int64)
        flat = np.concatenate([*terms, np.zeros(0, np.uint64)])
        terms.clear()
        by = np.argsort(flat, kind="stable")
        flat = flat[by]
        new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
        self.terms, number = flat[new], np.empty(len(flat), np.int32)
        number[by] = np.cumsum(new, dtype=np.int32) - 1
        del flat, by, new
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.ids = _order(number, of, length, len(self.terms))
        place = np.empty(len(sizes), np.int32)
        place[self.ids] = np.arange(len(sizes), dtype=np.int32)
        self.doc = place[of]
        by = np.lexsort((self.doc, number))
        self.doc, cell, of = self.doc[by], number[by].astype(np.int64) * BLOCKS, of[by]
        tf = np.concatenate([*counts, np.zeros(0, np.int32)])[by].astype(np.float64)
        counts.clear()
        self.weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[of] / max(mean_length, 1e-9)))
        del tf, of, by, number
        self.rows = max(1, -(-len(sizes) // BLOCKS))
        cell += self.doc // self.rows
        cell = self._keep_whole(cell)
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        # bounds are a little above the weights, as they are kept in half the bits
        self.bound = np.zeros((len(self.terms), BLOCKS), np.float32)
        if len(cell):
            self.bound.ravel()[cell[edge]] = np.maximum.reduceat(self.weight, edge) * (1 + 1e-6)
        starts = np.zeros(len(self.terms) * BLOCKS + 1, np.int32)
        np.cumsum(np.bincount(cell, minlength=len(self.terms) * BLOCKS), out=starts[1:])
        self.start = starts
        self.weighed = np.zeros(len(self.terms), bool)
        # where the postings of a query are laid together; made once, as fresh memory for each query costs more than the sums
        self.docs, self.weights = np.zeros(0, np.int64), np.zeros(0)

    def _keep_whole(self, cell: np.ndarray) -> np.ndarray:
        """Moves the long lists of blocks out of the postings into `whole`; returns the cells of those that stay.

        `full` numbers the terms that have such a list, and `row` says where it stands in the matrix of each block, -1 where there is none.
        """
        many = np.flatnonzero(np.bincount(cell, minlength=len(self.terms) * BLOCKS) >= max(FULL_LEAST, self.rows // FULL))
        terms = np.unique(many // BLOCKS)
        self.full = np.full(len(self.terms), -1, np.int32)
        self.full[terms] = np.arange(len(terms), dtype=np.int32)
        self.row = np.full((len(terms), BLOCKS), -1, np.int32)
        self.whole = []
        at = np.full(len(self.terms) * BLOCKS, -1, np.int32)
        for b in range(BLOCKS):
            mine = many[many % BLOCKS == b]
            at[mine] = self.row[self.full[mine // BLOCKS], b] = np.arange(len(mine), dtype=np.int32)
            self.whole.append(np.zeros((len(mine), max(0, min(self.rows, len(self.ids) - b * self.rows)))))
        at = at[cell]
        moved = np.flatnonzero(at >= 0)
        for b in range(BLOCKS):
            own = moved[cell[moved] % BLOCKS == b]
            self.whole[b][at[own], self.doc[own] - b * self.rows] = self.weight[own]
        stay = at < 0
        self.doc, self.weight = self.doc[stay], self.weight[stay]
        return cell[stay]

    def _added(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What whole lists add to the score of each document, for each query (places of terms, idf)."""
        of = np.repeat(np.arange(len(queries)), [len(at) for at, _ in queries])
        n = self.full[np.concatenate([at for at, _ in queries])]
        idf = np.concatenate([idf for _, idf in queries])[n >= 0]
        of, n = of[n >= 0], n[n >= 0]
        scores = np.zeros((len(queries), len(self.ids)))
        for b, lists in enumerate(self.whole):
            if lists.size:
                row = self.row[n, b]
                here = row >= 0
                asked = np.zeros((len(queries), len(lists)))
                asked[of[here], row[here]] = idf[here]
                scores[:, b * self.rows : b * self.rows + lists.shape[1]] = asked @ lists
        return scores

    def _weigh(self, at: np.ndarray, idf: np.ndarray) -> None:
        """Multiply the postings and bounds of terms by their idf, when the first query brings it."""
        new = np.flatnonzero(~self.weighed[at])
        self.weighed[at[new]] = True
        self.bound[at[new]] *= (idf[new, None] * (1 + 1e-6)).astype(np.float32)
        for t, w in zip(at[new].tolist(), idf[new].tolist(), strict=True):
            self.weight[self.start[t * BLOCKS] : self.start[(t + 1) * BLOCKS]] *= w

    def _laid(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and weights of stretches of postings, laid together: slice by slice, or by their places where a stretch is short."""
        by_slice = last - first >= SLICE
        runs = [slice(a, b) for a, b in zip(first[by_slice].tolist(), last[by_slice].tolist(), strict=True)]
        places = _ranges(first[~by_slice], last[~by_slice])
        n = int((last - first).sum())
        if n > len(self.docs):
            self.docs, self.weights = np.zeros(2 * n, np.int64), np.zeros(2 * n)
        docs = np.concatenate([*(self.doc[r] for r in runs), self.doc[places]], out=self.docs[:n])
        return docs, np.concatenate([*(self.weight[r] for r in runs), self.weight[places]], out=self.weights[:n])

    def top(self, terms: np.ndarray, idf: np.ndarray, k: int) -> list[tuple[float, int]]:
        """`tops` of one query."""
        return next(self.tops([(terms, idf)], k))

    def tops(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[list[tuple[float, int]]]:
        """The best k (score, number of document) of each query (terms, idf), exactly, by block-max WAND; ties go to the lesser number.

        A term's idf is the same for all queries. What whole lists add is made for TOGETHER queries at once.
        """
        for first in range(0, len(queries), TOGETHER):
            placed = []
            for terms, idf in queries[first : first + TOGETHER]:
                at = np.searchsorted(self.terms, terms)
                here = self.terms[np.minimum(at, len(self.terms) - 1)] == terms if len(self.terms) else np.zeros(len(terms), bool)
                placed.append((at[here], idf[here]))
            for (at, idf), added in zip(placed, self._added(placed), strict=True):
                self._weigh(at, idf)
                yield self._top(at, added, k)

    def _top(self, at: np.ndarray, added: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The best k of one query, by the places of its terms; `added` is what whole lists add to each document.

        Short lists are added to that at once, by their places. Every other term has a cursor in its list. As blocks have
        the same borders in all lists, the pivot is the next block where the largest weights of these terms, and the most
        that one of its documents has already, add up to the threshold, the k-th best score so far. All cursors jump to its
        beginning; blocks between are never looked into. Up to STEP pivots are scored together, and the block with the
        highest bound comes first, so that the threshold is high from the start. Scores are rounded to 9 places, which
        makes them the same whatever the order of sums.
        """
        if not len(self.ids):
            return []
        first, last = self.start[at * BLOCKS], self.start[(at + 1) * BLOCKS]
        long = last - first >= LONG
        docs, weights = self._laid(first[~long], last[~long])
        added = added + np.bincount(docs, weights, len(self.ids))
        bound = self.bound[at[long]].sum(0, dtype=np.float64)
        borders = np.arange(0, len(self.ids), self.rows)
        bound[: len(borders)] += np.maximum.reduceat(added, borders)
        long = at[long] * BLOCKS
        found, best, threshold = np.zeros(0, np.int64), np.zeros(0), 0.0
        pivots, after = np.argmax(bound)[None], 0
        while len(pivots):
            cut = np.flatnonzero(np.diff(pivots) > 1) + 1
            goods, scores = [found], [best]
            for begin, end in zip(pivots[np.concatenate([[0], cut])], pivots[np.concatenate([cut - 1, [-1]])] + 1, strict=True):
                score = added[begin * self.rows : end * self.rows]
                first, last = self.start[long + begin], self.start[long + end]
                if last.sum() > first.sum():
                    docs, weights = self._laid(first, last)
                    docs -= begin * self.rows
                    score = score + np.bincount(docs, weights, len(score))
                good = np.flatnonzero((score > 0) & (score >= threshold * (1 - 1e-9)))
                if len(good) > k:
                    good = good[score[good] >= np.partition(score[good], -k)[-k] * (1 - 1e-9)]
                goods.append(self.ids[good + begin * self.rows])
                scores.append(np.round(score[good], 9))
            found, best = np.concatenate(goods), np.concatenate(scores)
            kept = np.lexsort((found, -best))[:k]
            found, best = found[kept], best[kept]
            threshold = best[-1] if len(best) == k else 0.0
            bound[pivots] = 0
            pivots = after + np.flatnonzero((bound[after:] > 0) & (bound[after:] >= threshold * (1 - 1e-9)))[:STEP]
            after = pivots[-1] + 1 if len(pivots) else after
        return list(zip(best.tolist(), found.tolist(), strict=True))


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each start up to its end."""
    n = (end - start).astype(np.int64)
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())


def _order(number: np.ndarray, of: np.ndarray, length: np.ndarray, terms: int) -> np.ndarray:
    """Documents in an order that puts like ones into the same blocks, which keeps the bounds of blocks close.

    They are grouped by the signs of the first three principal components over the most common terms, which tell
    languages apart, and then sorted by length.
    """
    common = np.argsort(-np.bincount(number, minlength=terms), kind="stable")[:ORDER_TERMS]
    column = np.full(terms, -1, np.int32)
    column[common] = np.arange(len(common), dtype=np.int32)
    hit = column[number]
    has = np.zeros((len(length), len(common)), np.float32)
    has[of[hit >= 0], hit[hit >= 0]] = 1
    has /= np.maximum(np.linalg.norm(has, axis=1, keepdims=True), 1e-9)
    has -= has.mean(0) if len(has) else 0
    axes = np.linalg.eigh(has.T @ has)[1][:, -3:]
    side = (has @ axes > 0) @ (1 << np.arange(axes.shape[1]))
    return np.lexsort((length, side))


def _search(batches: Iterator[pa.RecordBatch], k: int, mean_length: float) -> Iterator[pa.RecordBatch]:
    """(query_id, doc_id, score) from rows (shard, is_query, id, body, terms, idf) sorted by shard, documents first, by id and body.

    Rows that agree in id and body are one document of the index, which comes up as often as it is there.
    """
    unzip = zstandard.ZstdDecompressor()
    shard, index = None, None
    ids, copies, held, last = [], [], ([], []), None
    for batch in batches:
        queries, docs, scores, asked = [], [], [], []

        def answer() -> None:
            for (key, *_), found in zip(asked, index.tops([q[1:] for q in asked], k) if asked else (), strict=True):
                for score, doc in found:
                    for _ in range(min(k, copies[doc])):
                        queries.append(key)
                        docs.append(ids[doc])
                        scores.append(score)
            asked.clear()

        lists = [batch.column(i) for i in (4, 5)]
        new = term_counts(unzip.decompress(z.as_py()).decode() for z in batch.column(3).drop_null())
        for i, (s, is_query, key, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
            if s != shard:
                answer()
                shard, index = s, None
                ids, copies, held, last = [], [], ([], []), None
            if not is_query:
                t, n = next(new)
                if last == (key, body):
                    copies[-1] += 1
                else:
                    last = (key, body)
                    ids.append(key)
                    copies.append(1)
                    held[0].append(t)
                    held[1].append(n.astype(np.int32))
                continue
            if index is None:
                index = Index(*held, mean_length)
            t, idf = (c[i].values.to_numpy(zero_copy_only=False) for c in lists)
            asked.append((key, t.view(np.uint64), idf))
        answer()
        kind = batch.column(2).type
        yield pa.record_batch({"query_id": pa.array(queries, kind), "doc_id": pa.array(docs, kind), "score": pa.array(scores, pa.float64())})


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [t for t, _ in term_counts(batch.column(1).to_pylist())]
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
        yield pa.record_batch({"query_id": ids, "term": pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))})


def search(docs: DataFrame, is_query: Column, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k best rows of `docs` by BM25 for the whole text of each query row.

    A query is the set of words of a row for which `is_query` (a condition on doc_id) holds; the row itself is a
    candidate like all others. The inverse document frequency is ln(1 + (N - n + 0.5) / (n + 0.5)) over all rows. Ties
    go to the smaller doc_id. Rows that share no word with the query do not come up, so a query may have fewer than k
    rows, and a text without words none. Null ids are candidates but ask nothing; a repeated id asks once, with its
    least text, and is a candidate as often as it is there. Other columns play no part; an empty table gives an empty
    result.

    Documents are dealt to shards of a bounded size, one a task; every shard is searched for every query, queries being
    streamed past its index, and the best k of each shard are merged. Statistics are global, so the result does not
    depend on the shards. Rows that agree in id and text are spread over shards by the partition they come from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "search")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.select("text").mapInArrow(_statistics, "term long, docs long, tokens long")
    counted = scratch.keep(counted.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), "terms")
    total = counted.where("term is null").first()
    n, tokens = (total["docs"], total["tokens"]) if total else (0, 0)
    asked = rows.where(is_query).where("doc_id is not null").groupBy(F.col("doc_id").alias("query_id")).agg(F.min("text").alias("text"))
    terms = asked.mapInArrow(_query_terms, f"query_id {kind}, term long")
    idf = F.log(1 + (F.lit(float(n)) - F.col("docs") + 0.5) / (F.col("docs") + 0.5))
    weighted = terms.join(counted.where("term is not null"), "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", idf.alias("idf")))).alias("t"))
    # hashes are compared as unsigned numbers in the index: any order will do that is always the same
    queries = scratch.keep(weighted.select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf")), "queries")
    scratch.drop(counted)
    shards = max(1, -(-n // SHARD_ROWS), -(-tokens // SHARD_WORDS))

    @F.pandas_udf("binary")
    def zipped(texts):
        c = zstandard.ZstdCompressor(level=1)
        return texts.map(lambda t: c.compress((t or "").encode()))

    parts = rows.select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"), F.col("doc_id").alias("id"), zipped("text").alias("body"), F.lit(None).cast("array<long>").alias("terms"), F.lit(None).cast("array<double>").alias("idf"))
    asks = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"), F.col("query_id").alias("id"), F.lit(None).cast("binary").alias("body"), "terms", "idf")
    dealt = parts.unionAll(asks).repartitionById(shards, "shard").sortWithinPartitions("shard", "is_query", "id", "body")
    mean = tokens / max(1, n)
    best = dealt.mapInArrow(lambda it: _search(it, k, mean), f"query_id {kind}, doc_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
