"""Repeated passages by paragraph MinHash banding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchlake.llm.common import Scratch, connected_components, small_batches

SHINGLE = 5
SIMILARITY = 0.8
#: Bands of one MinHash value each; two paragraphs at the least similarity share none with probability 0.2 ** BANDS.
BANDS = 4
#: The words of a run of repeated paragraphs from which `repeated_passages` keeps it.
RUN_WORDS = 25
#: A paragraph: a stretch of a line up to a full stop, question mark or exclamation mark with white space after it.
_PARAGRAPH = re.compile(r"\S[^\n.!?]*(?:[.!?](?!\s|$)[^\n.!?]*)*[.!?]*")
#: Kinds of units. They are kept apart by a salt, so no unit is linked with a part of itself.
UNITS = ("sentence", "piece", "short")
_APART = np.array([0, 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D], np.uint64)
#: Sentences of more words are cut into pieces too: of two broken ones that a passage of 50 words lies in, one is that long.
LONG = 24
#: A piece begins where a shingle's hash is the least of those up to REACH words before and behind it.
REACH = 6
#: The words of a piece, at most: where no hash is the least (the same words over and over), it is cut by number.
PIECE = 64
#: Letters of scripts without spaces (Thai, Lao, Burmese, Khmer, kana, Chinese), which count as words in pieces.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_IS_DENSE = re.compile(f"[{_DENSE}]")
_TOKEN = re.compile(f"[{_DENSE}]|[^\\s{_DENSE}]+")
_WORD = re.compile(r"\S+")
_SALTS = np.random.default_rng(33).integers(1, 2**63, BANDS, dtype=np.uint64) | np.uint64(1)
_BAND = np.arange(BANDS, dtype=np.uint64)
#: The different paragraphs of a larger band are dealt to groups; which of them are found similar does not hang on it.
HOT = 1000
#: In such a band, paragraphs of more different shingles are grouped by their number, others by their rarest shingles.
WIDE = 64
#: Shingles are counted in so many buckets to tell rare from common ones; that many numbers come to the driver, at most.
RARITY_BITS = 18
_PLACE = np.random.default_rng(35).integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
#: Words whose hashes a task remembers, and bytes of text that it takes apart at once, about; a longer text is taken by itself.
KNOWN, AT_ONCE = 300_000, 2 << 20
_UNITS = "rid long, doc_id {0}, unit int, pos int, words int, start long, end long, k long, " + ", ".join(f"b{n} long" for n in range(BANDS)) + ", body string"


class _Hashes(dict):
    """64-bit hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > KNOWN:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _rolled(h: np.ndarray) -> np.ndarray:
    """The hash of the shingle that begins at each of the word hashes `h`; the last ones are of fewer words."""
    out = np.zeros(len(h), np.uint64)
    for i in range(min(SHINGLE, len(h))):
        out[: len(h) - i] += h[i:] * _PLACE[i]
    return _mix(out)


def _fewer(h: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hashes of units of fewer words than a shingle: `size` words from `at`."""
    out = np.zeros(len(at), np.uint64)
    for i in range(SHINGLE - 1):
        has = size > i
        out[has] += h[at[has] + i] * _PLACE[i]
    return _mix(out) ^ size.astype(np.uint64)


def _least(h: np.ndarray) -> np.ndarray:
    """Where a hash is the least of those up to REACH before and behind it, and the first such of them."""
    low = np.ones(len(h), bool)
    low[:REACH] = low[max(0, len(h) - REACH) :] = False
    for i in range(1, min(REACH, len(h) - 1) + 1):
        low[i:] &= h[i:] < h[:-i]
        low[:-i] &= h[:-i] <= h[i:]
    return np.flatnonzero(low)


def _pieces(cuts: list[int], words: int) -> list[tuple[int, int]]:
    """Pieces (from, to) of a stretch of words, cut at `cuts`, which are alike wherever the words around them are the same."""
    out, at = [], 0
    for to in [*cuts, words]:
        while to - at > PIECE:
            out.append((at, at + PIECE // 2))
            at += PIECE // 2
        out.append((at, to))
        at = to
    return out


def _sentences(texts: list[str | None], known: _Hashes) -> tuple[list[tuple], list[str], np.ndarray]:
    """(text number, unit, start, end, where its words begin, how many) of sentences and short ones; all words and their hashes.

    A long sentence with letters of scripts without spaces comes once more, as unit -1, with these as words: pieces of it only.
    """
    found, words = [], []
    for i, text in enumerate(texts):
        plain = not text or text.isascii()
        for m in _PARAGRAPH.finditer(text or ""):
            part = m[0]
            w = part.lower().split()
            found.append((i, 2 if len(w) < SHINGLE else 0, *m.span(), len(words), len(w)))
            words += w
            if not plain and _IS_DENSE.search(part):
                w = [t.lower() for t in _TOKEN.findall(part)]
                if len(w) > LONG:
                    found.append((i, -1, *m.span(), len(words), len(w)))
                    words += w
    return found, words, known.of(words)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about AT_ONCE bytes of text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)) // AT_ONCE
        edges = np.flatnonzero(np.diff(sizes)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of rows (rid, doc_id, text), numbered within their kind.

    k identifies the set of shingles. Sets of fewer than 4 shingles are as similar as SIMILARITY only if equal, so they
    have no bands and no body.
    """
    known = _Hashes()
    for batch in _parts(batches):
        texts = batch.column(2).to_pylist()
        found, words, hashes = _sentences(texts, known)
        rolled, units = _rolled(hashes), []
        low = _least(rolled)
        for n, (i, unit, start, end, at, size) in enumerate(found):
            if unit >= 0:
                units.append((i, unit, start, end, at, size))
            dense = unit < 0
            if unit == 2 or size <= LONG or (not dense and n + 1 < len(found) and found[n + 1][1] < 0):
                continue
            spans = [(start + t.start(), start + t.end()) for t in (_TOKEN if dense else _WORD).finditer(texts[i][start:end])]
            inside = low[np.searchsorted(low, at + REACH) : np.searchsorted(low, at + size - SHINGLE + 1 - REACH)]
            for a, b in _pieces((inside - at).tolist(), size):
                units.append((i, 1, spans[a][0], spans[b - 1][1], at + a, b - a))
        if not units:
            continue
        of, kind, start, end, at, size = (np.array(c, np.int64) for c in zip(*units, strict=True))
        count = np.maximum(1, size - SHINGLE + 1)
        first = np.cumsum(count) - count
        unit_of = np.repeat(np.arange(len(units)), count)
        h = rolled[np.repeat(at - first, count) + np.arange(len(unit_of))]
        # a short unit ends before its shingle does, so it is hashed by itself
        few = np.flatnonzero(size < SHINGLE)
        h[first[few]] = _fewer(hashes, at[few], size[few])
        # by unit, then by hash: units' numbers stand before the hashes' first bits in one key, which is much faster to sort
        bits = np.uint64(len(units).bit_length())
        order = np.argsort((unit_of.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits))
        h, unit_of = h[order], unit_of[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (unit_of[1:] != unit_of[:-1])])
        h, unit_of = h[new], unit_of[new]
        first = np.searchsorted(unit_of, np.arange(len(units)))
        different = np.diff(np.append(first, len(h)))
        keys = _mix(np.add.reduceat(_mix(h * _PLACE[0]), first) + different.astype(np.uint64) * _PLACE[1]) ^ _APART[kind]
        long = (different >= 4) & (size >= SHINGLE)
        bands = [pa.array((np.minimum.reduceat(h * salt, first) ^ n ^ _APART[kind]).view(np.int64), mask=~long) for salt, n in zip(_SALTS, _BAND, strict=True)]
        body = [" ".join(words[a : a + n]) if keep else None for a, n, keep in zip(at.tolist(), size.tolist(), long.tolist(), strict=True)]
        # numbers within kind and text: units of a text come in the order of their starts
        group = np.lexsort((np.arange(len(units)), kind, of))
        edge = np.concatenate([[True], (of[group][1:] != of[group][:-1]) | (kind[group][1:] != kind[group][:-1])])
        pos = np.empty(len(units), np.int32)
        pos[group] = np.arange(len(units)) - np.maximum.accumulate(np.where(edge, np.arange(len(units)), 0))
        take = pa.array(of)
        yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(kind.astype(np.int32)), pa.array(pos), pa.array(size.astype(np.int32)), pa.array(start), pa.array(end), pa.array(keys.view(np.int64)), *bands, pa.array(body, pa.string())], names=["rid", "doc_id", "unit", "pos", "words", "start", "end", "k", *(f"b{n}" for n in range(BANDS)), "body"])


def _sets(bodies: list[str], known: _Hashes) -> Iterator[np.ndarray]:
    """The different shingle hashes of each body, sorted."""
    words = [body.split(" ") for body in bodies]
    ends = np.cumsum([len(w) for w in words]).tolist()
    rolled = _rolled(known.of([x for w in words for x in w]))
    for w, end in zip(words, ends, strict=True):
        s = np.sort(rolled[end - len(w) : end - SHINGLE + 1])
        yield s[np.concatenate([[True], s[1:] != s[:-1]])]


def _first(rank: np.ndarray) -> np.ndarray:
    """Places of a set's first shingles, in the order of their ranks: as many as two sets so similar cannot both do without one of."""
    return np.argsort(rank, kind="stable")[: len(rank) - int(np.ceil(SIMILARITY * len(rank))) + 1]


def _prefixes(members: dict[int, np.ndarray]) -> dict[int, list[int]]:
    """The first shingles of every set, those first that fewest of the sets have; what a single set has meets nothing and is left out."""
    if len(members) <= 32:  # any order does; this is the cheapest
        return {k: s[: len(s) - int(np.ceil(SIMILARITY * len(s))) + 1].tolist() for k, s in members.items()}
    sizes = np.cumsum([len(s) for s in members.values()])[:-1]
    _, number, count = np.unique(np.concatenate(list(members.values())), return_inverse=True, return_counts=True)
    out = {}
    for k, own in zip(members, np.split(number, sizes), strict=True):
        first = own[_first(count[own] * len(count) + own)]
        out[k] = first[count[first] > 1].tolist()
    return out


def _similar(members: dict[int, np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among paragraphs (k: shingles), each link verified by exact Jaccard similarity.

    Sets so similar share one of the first shingles, in any fixed order, of a fifth of each and one; rare ones come first,
    so what a template gives to all of them brings none together. Only members that share one are compared, and only if
    no link joins them yet: those that links join stand together and are passed over.
    """
    up: dict[int, int] = {}

    def top(k: int) -> int:
        while up.setdefault(k, k) != k:
            up[k] = k = up[up[k]]
        return k

    sets, index, prefixes = {}, {}, _prefixes(members)
    for k in sorted(members):
        a = sets[k] = set(members[k].tolist())
        for e in prefixes[k]:
            groups = index.setdefault(e, {})
            for root in list(groups):
                if (now := top(root)) != root:
                    groups.setdefault(now, []).extend(groups.pop(root))
            for root, others in list(groups.items()):
                if top(k) == top(root):
                    continue
                for other in others:
                    b = sets[other]
                    both = len(a & b) if SIMILARITY * len(b) <= len(a) <= len(b) / SIMILARITY else 0
                    if both >= SIMILARITY * (len(a) + len(b) - both):
                        up[top(k)] = top(other)
                        yield k, other
                        break
            groups.setdefault(top(k), []).append(k)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links found in rows (band, k, body) sorted by band; one band value's different paragraphs are held at a time."""
    band, members, known = None, {}, _Hashes()
    for batch in batches:
        out: list[tuple[int, int]] = []
        sets = _sets(batch.column(2).to_pylist(), known)
        for b, k, s in zip(*(c.to_pylist() for c in batch.columns[:2]), sets, strict=True):
            if b != band:
                if len(members) > 1:
                    out += _similar(members)
                band, members = b, {}
            members[k] = s
        yield pa.record_batch({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
    if len(members) > 1:
        out = list(_similar(members))
        yield pa.record_batch({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): how often shingles of bodies fall into each bucket of their hashes."""
    known, seen = _Hashes(), np.zeros(1 << RARITY_BITS, np.int64)
    for batch in batches:
        if batch.num_rows:
            every = np.concatenate(list(_sets(batch.column(0).to_pylist(), known)))
            seen += np.bincount((every >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(seen))
    bucket = np.flatnonzero(seen)
    yield pa.record_batch([pa.array(bucket), pa.array(seen[bucket])], names=["bucket", "n"])


def _grouped(rarity: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes of rows (band, k, body, hot) rows (band, k, body), those of hot bands under narrower ones, so that similar ones still meet.

    Two sets so similar share one of their first shingles in any fixed order; the order is that of `rarity`, so most of
    them are in small groups. Sets of more than WIDE shingles would have many of these: they are put together by the
    number of their shingles, which for similar sets lies within a quarter; sets that may be similar to either kind are
    in both.
    """

    def bands(band: np.uint64, s: np.ndarray) -> np.ndarray:
        out = []
        if len(s) <= WIDE:
            rank = rarity[s >> np.uint64(64 - RARITY_BITS)]
            out.append(_mix(band * _PLACE[3] + s[_first(rank)]))
        if len(s) > SIMILARITY * WIDE:
            step = int(np.log(len(s)) / -np.log(SIMILARITY))
            out.append(_mix(band * _PLACE[2] + np.arange(step, step + 2, dtype=np.uint64)))
        return np.concatenate(out)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            hot = batch.column(3).to_numpy(zero_copy_only=False)
            band = batch.column(0).to_numpy().view(np.uint64)
            sets = _sets(batch.column(2).filter(pa.array(hot)).to_pylist(), known)
            with np.errstate(over="ignore"):
                own = [bands(b, next(sets)) if h else b[None] for b, h in zip(band, hot.tolist(), strict=True)]
            take = pa.array(np.repeat(np.arange(len(hot)), [len(x) for x in own]))
            yield pa.record_batch([pa.array(np.concatenate(own).view(np.int64)), batch.column(1).take(take), batch.column(2).take(take)], names=["band", "k", "body"])

    return narrow


def repeated_passages(docs: DataFrame, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Long repeated passages of `docs`: the sentences of `repeated_paragraphs` in runs of `run_words` words or more.

    A filter for callers that want long passages only; documents without such a run have no row.
    """
    found = repeated_paragraphs(docs, id_col, text_col)
    return found.where((F.col("unit") == "sentence") & (F.col("run_words") >= run_words)).drop("unit", "run_words")


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated paragraphs of `docs`: doc_id, unit, paragraph, start, end, words, component, component_doc_id, removed, run_words.

    There are three kinds of units. Each `sentence` with a full shingle is one, so passages are found inside longer
    lines too. Those above LONG words are also cut into a `piece` after the other, at places that only the words around
    settle, so passages are found that begin or end inside a sentence, or have no stops; letters of scripts without
    spaces count as words there. Sentences shorter than a shingle are `short`.
    Equal sets of shingles are merged first; of the others, those of one kind that share a band are verified by exact
    Jaccard similarity and linked (short ones are equal or not); components follow links. A unit is repeated if its
    component has two or more occurrences; each such one has a row: its number in the document among its kind, its place
    in code points, `component` (an identifier), the least doc_id in the component, whether it is removed (all but the
    first by doc_id, row and number are), and the words of the unbroken run of repeated units of its kind and row that
    it stands in.
    Null texts have none. Null ids come first, and are a component's id only if all its ids are null. Repeated rows
    are occurrences of their own. Other columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "paragraphs")
    # a number for each row; units are written, so it stays the same
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    units = scratch.keep(rows.mapInArrow(_units, _UNITS.format(kind)), "units")

    # one band after the other, so that only one of them is on its way at a time. Bands of several paragraphs are written
    # first: the join then stands right on two shuffles, so a very common band can be split among tasks
    # all bands of a paragraph go through one shuffle, by which copies are one
    bands = [f"b{n}" for n in range(BANDS)]
    different = scratch.keep(units.where("b0 is not null").groupBy("k").agg(*[F.min(b).alias(b) for b in bands]), "different")
    scratch.free()
    met = []
    for band in bands:
        banded = different.select("k", F.col(band).alias("band"))
        shared = scratch.keep(banded.groupBy("band").count().where("count > 1"), "shared")
        met.append(scratch.keep(banded.join(shared, "band").select("band", "k", (F.col("count") > HOT).alias("hot")), "met"))
        scratch.drop(shared)
        del banded, shared
        scratch.free()
    scratch.drop(different)
    del different
    meetings = met
    met = reduce(DataFrame.unionAll, meetings)
    wanted = met.select("k").distinct()
    # half of the paragraphs after the other: all bodies go through this shuffle, which is the largest
    halves = []
    for n in range(2):
        half = lambda df, n=n: df.where(F.pmod("k", F.lit(2)) == n)
        half_bodies = half(units).where("body is not null").select("k", "body").join(half(wanted), "k").groupBy("k").agg(F.min("body").alias("body"))
        halves.append(scratch.keep(half_bodies, "bodies"))
        del half_bodies
        scratch.free()
    bodies = halves[0].union(halves[1])
    hot = bodies.join(met.where("hot").select("k").distinct(), "k", "left_semi").select("body")
    counts = hot.mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    rarity = np.zeros(1 << RARITY_BITS, np.int64)
    rarity[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    pairs = met.join(bodies, "k").select("band", "k", "body", "hot").mapInArrow(_grouped(rarity), "band long, k long, body string")
    edges = pairs.repartition("band").sortWithinPartitions("band", "k").mapInArrow(_links, "a long, b long")
    roots = connected_components(spark, edges, scratch)
    scratch.drop(*meetings, *halves)

    place = F.struct("doc_id", "rid", "pos")
    same = units.groupBy("k").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.min(place).alias("first"))
    named = same.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("root", "k"))
    named = scratch.keep(named.where("n > 1 or root is not null").select("k", "component", "n", "least", "first"), "named")
    scratch.free()
    groups = named.groupBy("component").agg(F.sum("n").alias("n"), F.min("least").alias("component_doc_id"), F.min("first").alias("first")).where("n > 1")
    flags = scratch.keep(named.select("k", "component").join(groups.drop("n"), "component"), "flags")
    scratch.drop(named)
    del same, named, groups
    scratch.free()
    hits = scratch.keep(units.drop(*(f"b{n}" for n in range(BANDS)), "body").join(flags, "k").withColumn("removed", place != F.col("first")).drop("k", "first"), "hits")
    scratch.drop(units, flags)
    del flags
    scratch.free()
    run = hits.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("rid", "unit").orderBy("pos")))
    in_run = F.sum("words").over(Window.partitionBy("rid", "unit", "run"))
    return run.select("doc_id", F.get(F.array(*[F.lit(u) for u in UNITS]), F.col("unit")).alias("unit"), F.col("pos").alias("paragraph"), "start", "end", "words", "component", "component_doc_id", "removed", in_run.alias("run_words"))
