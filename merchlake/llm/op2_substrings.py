"""Removal of repeated byte strings: a depth-limited radix sort of suffixes, by hashed digits.

Every position of every text starts a suffix, of which the first `window` bytes count. A position is removed with its
window if those bytes also start elsewhere. Sorting all positions would move hundreds of bytes for each, so:

* Positions are bundled by their window's least gram (the gram of `gram` bytes with the least hash, leftmost on ties).
  Equal windows have their least gram at the same place, so they are in bundles with the same gram: the first digit.
* A bundle is a run of neighbouring positions, and its windows together are one string. Bundles that are alone with their
  gram hold no repeated window. If all bundles with a gram are the same string, all their windows repeat. Otherwise one of
  each different string goes on to the next pass, as all others of it are settled by it.
* The next passes do the same with blocks of BLOCK neighbouring positions (digit: the bytes all their windows share), then
  with single positions, whose digit is the whole window. Equal groups of the last pass are exactly the repeated windows.

So a pass takes only what the pass before could not settle, near the ends of repeated passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import Scratch, small_batches

WINDOW = 200
GRAM = 48
#: Neighbouring positions that the second pass takes together.
BLOCK = 16
#: Bytes that are hashed at once; longer texts are cut into such segments, which overlap by a window.
SEGMENT = 1 << 21
_MULTIPLIER = 0x9E3779B97F4A7C15
#: A row: n neighbouring positions from `at` of text `rid`. mark: how far the first is before its gram, and, times MARK, behind its bundle's start.
_ROWS = "digit long, whole long, rid long, at long, n int, mark int"
MARK = 1 << 15
_STRINGS = "rid long, home long, back int, lo int, hi int, string binary"
_STRING_NAMES = ["rid", "home", "back", "lo", "hi", "string"]
_STRING_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())


class _Grams:
    """Hashes of all grams of a buffer, by a polynomial over a table of random values."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.table = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
        size = 2 * SEGMENT + window
        with np.errstate(over="ignore"):
            up, down = np.full(size, _MULTIPLIER, np.uint64), np.full(size, pow(_MULTIPLIER, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)

    def bundles(self, data: bytes, starts: list[int], ends: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text starts[i]..ends[i] of the buffer: i, first and last position, place and hash of the gram, of each bundle."""
        if len(data) < self.window:
            return
        x = self.table[np.frombuffer(data, np.uint8)]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.up[: len(x)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.down[: len(x) - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << 23) - 1)  # places in the buffer
        best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, have = self.window - self.gram + 1, 1
        n = len(best) - width + 1
        while 2 * have <= width:
            best = np.minimum(best[:-have], best[have:])
            have *= 2
        if have < width:
            best = np.minimum(best[:n], best[width - have : width - have + n])
        place = (best & low).astype(np.int64)
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            if b - a >= self.window:
                p = place[a : b - self.window + 1]
                cut = np.flatnonzero(np.diff(p)) + 1
                first = np.concatenate([[0], cut])
                yield i, first + a, np.concatenate([cut, [len(p)]]) - 1 + a, p[first], h[p[first]].view(np.int64)


def _bundled(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The rows of the first pass from rows (rid, zipped text)."""
    grams = _Grams(window, gram)

    def rows(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        data = b"".join(p for _, _, p in parts)
        ends = np.cumsum([len(p) for _, _, p in parts]).tolist()
        starts = [0, *ends[:-1]]
        out: list[list] = [[], [], [], [], [], []]
        for i, first, last, place, h in grams.bundles(data, starts, ends):
            rid, base, _ = parts[i]
            out[0].append(h)
            out[1].append(np.array([xxhash.xxh3_64_intdigest(data[a : b + window], p - a) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)], dtype=np.uint64).view(np.int64))
            out[2].append(np.full(len(h), rid))
            out[3].append(first - starts[i] + base)
            out[4].append((last - first + 1).astype(np.int32))
            out[5].append((place - first).astype(np.int32))
        kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
        return pa.record_batch([pa.array(np.concatenate(c) if c else np.zeros(0, k)) for c, k in zip(out, kinds, strict=True)], names=["digit", "whole", "rid", "at", "n", "mark"])

    parts, size, unzip = [], 0, zstandard.ZstdDecompressor()
    for batch in batches:
        for rid, z in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = unzip.decompress(z.as_py())
            for base in range(0, max(1, len(text) - window + 1), SEGMENT):
                parts.append((rid, base, text[base : base + SEGMENT + window - 1]))
                size += len(parts[-1][2])
                if size >= SEGMENT:
                    yield rows(parts)
                    parts, size = [], 0
    if parts:
        yield rows(parts)


def _strings(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(rid, home, back, lo, hi, string) of open bundles, from rows (rid, zipped text, bundles)."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for rid, z, bundles in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            text = unzip.decompress(z)
            for b in bundles:
                for column, value in zip(out, (rid, b["at"], b["mark"], 0, b["n"] - 1, text[b["at"] : b["at"] + b["n"] - 1 + window]), strict=True):
                    column.append(value)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, _STRING_KINDS, strict=True)], names=_STRING_NAMES)


def _split(batches: Iterator[pa.RecordBatch], window: int, block: int) -> Iterator[pa.RecordBatch]:
    """The rows of a later pass: parts of bundles, from rows (rid, home, back, lo, hi, string).

    `home` is where the bundle starts, and that is `back` before its gram. lo..hi are the positions of the bundle that
    are still open, counted from it. A part takes positions that are equally far before the gram, by // block. Its
    digit is what all their windows share, its whole is what they span.
    """
    seed = lambda k: k & 0xFFFFFFFF
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for rid, home, back, lo, hi, string in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            while lo <= hi:
                top = back - lo  # how far before the gram the first open position is
                k = top // block
                last = min(hi, back - k * block)
                if block == 1:
                    d = xxhash.xxh3_128_digest(string[lo : lo + window], seed(k))
                    digit, whole = (int.from_bytes(d[i : i + 8], "little", signed=True) for i in (0, 8))
                else:
                    shared = string[max(0, back - k * block) : back - k * block - block + 1 + window]
                    digit = xxhash.xxh3_64_intdigest(shared, seed(k))
                    whole = xxhash.xxh3_64_intdigest(string[lo : last + window], seed(top))
                    digit, whole = (x - (1 << 64) if x >> 63 else x for x in (digit, whole))
                for column, value in zip(out, (digit, whole, rid, home + lo, last - lo + 1, top + MARK * lo), strict=True):
                    column.append(value)
                lo = last + 1
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["digit", "whole", "rid", "at", "n", "mark"])


def _pass(rows: DataFrame, scratch: Scratch, final: bool = False) -> tuple[DataFrame, DataFrame]:
    """Settled rows (rid, at, n), all of whose windows repeat, and open rows (rid, at, n, mark).

    Counts and extremes per digit are combined before the shuffle; the joins have one row a digit on one side, so a
    very common digit's rows can be split among tasks.
    """
    by = rows.groupBy("digit").agg(F.count("*").alias("c"), F.min("whole").alias("w0"), F.max("whole").alias("w1"))
    by = scratch.keep(by.where("c > 1").select("digit", (F.col("w0") != F.col("w1")).alias("mixed")), "digits")
    hit = scratch.keep(rows.join(by, "digit"), "hit")
    settled = hit.where("not mixed").select("rid", "at", "n")
    mixed = hit.where("mixed")
    wholes = mixed.groupBy("digit", "whole").agg(F.count("*").alias("c"), F.min(F.struct("rid", "at", "n", "mark")).alias("one"))
    wholes = scratch.keep(wholes, "wholes")
    scratch.free()
    again = mixed.join(wholes.where("c > 1").select("digit", "whole"), ["digit", "whole"]).select("rid", "at", "n")
    settled = scratch.keep(settled.unionAll(again), "settled")
    open_rows = None if final else scratch.keep(wholes.select("one.*"), "open")
    scratch.drop(hit, wholes)
    return settled, open_rows


def _zip(text: str) -> Column:
    @F.pandas_udf("binary")
    def compress(texts: pd.Series) -> pd.Series:
        c = zstandard.ZstdCompressor(level=1)
        return texts.map(lambda t: c.compress((t or "").encode()))

    return compress(text)


def _on_strings(rows: DataFrame, window: int, block: int) -> DataFrame:
    return rows.select(*_STRING_NAMES).mapInArrow(lambda it: _split(it, window, block), _ROWS)


def repeated_spans(rows: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(rid, at, n): runs of positions of `rows` (rid, z: the zipped text) whose windows repeat; together, all such positions.

    rid is another one for each row, so a text that is there many times is that many texts, and none gathers in a task.
    """
    bundles = scratch.keep(rows.mapInArrow(lambda it: _bundled(it, window, gram), _ROWS), "bundles")
    settled, todo = _pass(bundles, scratch)
    scratch.drop(bundles)
    scratch.free()
    lists = todo.groupBy("rid").agg(F.collect_list(F.struct("at", "n", "mark")).alias("todo"))
    zipped = rows.join(lists, "rid")
    strings = scratch.keep(zipped.mapInArrow(lambda it: _strings(it, window), _STRINGS), "strings")
    by_block, todo = _pass(scratch.keep(_on_strings(strings, window, BLOCK), "blocks"), scratch)
    lo = F.floor(F.col("mark") / MARK).cast("int")
    ranges = todo.select("rid", (F.col("at") - lo).alias("home"), lo.alias("lo"), (lo + F.col("n") - 1).alias("hi"))
    single = _on_strings(strings.drop("lo", "hi").join(ranges, ["rid", "home"]), window, 1)
    by_position, _ = _pass(scratch.keep(single, "positions"), scratch, final=True)
    del lists, zipped, ranges, single
    scratch.free()
    return settled.unionAll(by_block).unionAll(by_position)


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """What is left of each text, from rows (ids..., rid, z, spans)."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for z, spans in zip(batch.column("z").to_pylist(), batch.column("spans"), strict=True):
            text, runs = unzip.decompress(z), []
            if spans.is_valid and len(spans.values):
                at = spans.values.field("at").to_numpy()
                end = at + spans.values.field("n").to_numpy() - 1 + window
                order = np.argsort(at, kind="stable")
                at, reach = at[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.concatenate([[True], at[1:] > reach[:-1]]))
                runs = list(zip(at[new].tolist(), reach[np.concatenate([new[1:] - 1, [len(at) - 1]])].tolist(), strict=True))
            edges = [0, *(x for run in runs for x in run), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            for column, value in zip(out, (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        made = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        yield pa.record_batch([batch.column("doc_id"), *made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left over) for each row of `docs`.

    Texts are UTF-8 bytes, null counts as empty. Each byte in a string of `window` bytes that also starts anywhere
    else, in the same text or another, is removed; strings are judged on the input. n_spans counts maximal removed
    runs. Rows that agree in id and text are separate texts, so each is a repeat of the other. Null ids are ids like
    any other; other columns play no part; an empty table gives an empty result. Texts of any length are taken in
    segments. Strings are told apart by 128 bits of hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "substrings")
    # written before they are read again, so a row keeps its number
    rows = scratch.keep(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), _zip(text_col).alias("z")), "texts")
    found = repeated_spans(rows.select("rid", "z"), scratch, window, gram)
    spans = found.groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    zipped = rows.join(spans, "rid", "left").select("doc_id", "z", "spans")
    kind = zipped.schema["doc_id"].dataType.simpleString()
    return zipped.mapInArrow(lambda it: _kept(it, window), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
