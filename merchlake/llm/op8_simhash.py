"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import Scratch, connected_components, small_batches

#: Words in a shingle, and differing bits up to which two fingerprints are linked.
SHINGLE = 3
RADIUS = 3
#: The bits are cut into three parts: (first bit, number of bits).
PARTS = ((0, 21), (21, 21), (42, 22))
_PIECE = 1 << 16


def fingerprint_of(text: str | None) -> int:
    """The 64-bit fingerprint of a text, unsigned: a bit is 1 if set in over half the shingles' XXH64 (seed 42)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), _PIECE):
        h = np.array([hashed(whole[a:b], 42) for a, b in zip(starts[i : i + _PIECE], ends[i : i + _PIECE], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """Fingerprints of a text column as signed longs; null texts count as empty."""

    @F.pandas_udf("long")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64))

    return compute(text)


def _variants(fp: Column) -> Column:
    """Keys under which fingerprints at most RADIUS bits apart are sure to meet.

    Of three differing bits, leaving out one of the three parts removes one at least for some part, which leaves two:
    half the radius from either side. So each fingerprint emits, for every part left out, what remains and all its
    variants with one bit turned; 43 remaining bits keep chance meetings rare even for billions of fingerprints.
    """
    out = []
    for n, (first, count) in enumerate(PARTS):
        low = F.lit((1 << first) - 1)
        rest = fp.bitwiseAND(low).bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, first + count), first)) if first + count < 64 else fp.bitwiseAND(low)
        tagged = rest.bitwiseOR(F.lit(n << 61))
        turns = [0, *(1 << b for b in range(64 - count))]
        out.append(F.array(*[tagged.bitwiseXOR(F.lit(t)) for t in turns]))
    return F.concat(*out)


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, by breadth-first search; memory is linear in them."""
    left, out = fps, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                out += [(x, y) for y in found]
                front += list(found)
                left = left[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links found in rows (key, fp) sorted by key; only the current key's rows are held over a batch's end."""
    kept_k = kept_f = np.zeros(0, np.int64)

    def scan(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(k)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
        size = ends - starts
        two = starts[size == 2]
        x, y = f[two].view(np.uint64), f[two + 1].view(np.uint64)
        near = np.bitwise_count(x ^ y) <= radius
        pairs = [np.stack([x[near], y[near]], 1)]
        for i in np.flatnonzero(size > 2):
            found = _forest(np.unique(f[starts[i] : ends[i]]).view(np.uint64), radius)
            if found:
                pairs.append(np.array(found, dtype=np.uint64))
        e = np.concatenate(pairs).view(np.int64)
        e = np.unique(np.sort(e, axis=1), axis=0)
        return pa.record_batch({"a": pa.array(e[:, 0]), "b": pa.array(e[:, 1])})

    for batch in batches:
        k = np.concatenate([kept_k, batch.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([kept_f, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(k) == 0:
            continue
        whole = int(np.searchsorted(k, k[-1]))
        if whole:
            yield scan(k[:whole], f[:whole])
        kept_k, kept_f = k[whole:], f[whole:]
    if len(kept_k):
        yield scan(kept_k, kept_f)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identity: Column | None = None) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id for each row of `docs`.

    If `identity`, a column over `docs`, is given, it comes back too, with `root`, which tells components apart even where
    a doc_id is repeated.

    Fingerprints at most RADIUS bits apart are linked; a component is what links reach, and its id the smallest doc_id
    in it. Equal fingerprints are merged first, so groups of exact copies cost one fingerprint however large they are.
    Rows without a word (null, empty, white space) have fingerprint 0, which is linked like any other. Null ids take
    part but are no component's id unless all its ids are null. Repeated rows come back repeated; other columns play
    no part; an empty table gives an empty result. Texts are hashed whole, in pieces, whatever their length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "simhash")
    extra = [] if identity is None else [identity.alias("identity")]
    rows = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp"), *extra), "rows")
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    # a small table makes many rows: as many tasks as the shuffle has partitions
    spread = distinct.select("fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    keys = spread.select(F.explode(_variants(F.col("fp"))).alias("key"), "fp")
    met = keys.repartition("key").sortWithinPartitions("key")
    edges = met.mapInArrow(lambda it: _links(it, RADIUS), "a long, b long")
    roots = connected_components(spark, edges, scratch)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = scratch.keep(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rows.join(named.select("fp", "root").join(least, "root"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *(["identity", "root"] if extra else []))
