"""Texts taken apart, whole Arrow batches of them at a time: tokens with their counts, and the buckets that tokens hash to.

A hash costs far more than a count, and a word comes again in many texts; a task that remembers the words it has hashed does
that once for each, where a column does it for each word of each text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from merchlake.functions import text as T

DIM = 384
#: Words that a task remembers; then it begins anew.
REMEMBERED = 300_000

TERMS = "array<struct<token:string,tf:bigint>>"
VECTOR = "array<struct<bucket:bigint,w:double>>"
SUMMARY = "struct<step:int,strongest:int>"
BUCKETS = "array<struct<bucket:bigint,tf:bigint,sign:double,df:bigint>>"
RARE = "array<struct<bucket:bigint,token:string>>"


class _Hashes(dict):
    """Bucket and sign of a token as one number, -1 - bucket for sign -1; made once for each token and kept."""

    def __missing__(self, token: str) -> int:
        at = lambda seed: int.from_bytes(hashlib.sha1(f"{seed}:{token}".encode()).digest()[:4], "big")
        bucket = at(0) % DIM
        self[token] = out = bucket if at(1) % 2 == 0 else -1 - bucket
        return out


_HASHES = _Hashes()
_find = re.compile(T.TOKEN).findall


def _counted(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different tokens of all texts, one text after the other: tokens, counts, last places, hashes; and where each text's begin."""
    tokens, counts, last, begins = [], [], [], [0]
    for text in texts.to_pylist():
        found = [t for t in _find(text or "") if len(t) > 1]
        seen = Counter(found)
        tokens += seen
        counts += seen.values()
        last += dict(zip(found, range(len(found)), strict=True)).values()
        begins.append(len(tokens))
    if len(_HASHES) > REMEMBERED:
        _HASHES.clear()
    hashes = np.fromiter(map(_HASHES.__getitem__, tokens), np.int64, len(tokens))
    return tokens, np.array(counts, np.int64), np.array(last, np.int32), hashes, np.array(begins, np.int32)


def _list(begins: np.ndarray, **columns: object) -> pa.Array:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()]
    return pa.ListArray.from_arrays(pa.array(begins), pa.StructArray.from_arrays(arrays, list(columns)))


def _groups(begins: np.ndarray, bucket: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by text, bucket and place; where groups of text and bucket begin and end in it; where each text's groups begin."""
    of = np.repeat(np.arange(len(begins) - 1), np.diff(begins)) * DIM + bucket
    order = np.lexsort((last, of))
    of = of[order]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    ends = np.append(first[1:], len(of)) - 1
    return order, first, ends, np.searchsorted(of[first], np.arange(len(begins)) * DIM).astype(np.int32)


def _reduced(how: np.ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return how.reduceat(values, first) if len(first) else values[:0]


def vectors(text: Column, means: dict[int, float], with_terms: bool = False) -> Column:
    """A struct of `v`, the signed vector of a lower-case text, of length 1; of where it stands in an index, `s`; and of `terms`, its different tokens and how many there are of each, if asked for.

    A bucket weighs (1 + ln of its tokens), times its value in `means` (1 if it has none), with the sign of its last token. `s` is as
    `postings.summary` makes it.
    """
    mean = np.array([means.get(b, 1.0) for b in range(DIM)])

    @F.arrow_udf(f"struct<v:{VECTOR},s:{SUMMARY}{',terms:' + TERMS if with_terms else ''}>")
    def taken(texts: pa.Array) -> pa.Array:
        tokens, tf, last, h, begins = _counted(texts)
        starts, bucket, sums = _sums(begins, tf, last, h)
        out = _unit(starts, bucket, sums, mean)
        if with_terms:
            out["terms"] = _list(begins, token=pa.array(tokens, pa.string()), tf=tf)
        return pa.StructArray.from_arrays(list(out.values()), list(out))

    return taken.asNondeterministic()(text)  # or a filter on what comes out would take every text apart a second time


def _sums(begins: np.ndarray, tf: np.ndarray, last: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's buckets begin; buckets; and how many tokens are in each, below 0 where the last one's sign is."""
    bucket = np.where(h < 0, -1 - h, h)
    order, first, ends, starts = _groups(begins, bucket, last)
    return starts, bucket[order][first], np.where(h[order][ends] < 0, -1, 1) * _reduced(np.add, tf[order], first)


def _unit(starts: np.ndarray, bucket: np.ndarray, sums: np.ndarray, mean: np.ndarray) -> dict[str, pa.Array]:
    """Vectors `v` of length 1 from what `_sums` gives, and `s`, where they stand in an index."""
    w = np.sign(sums) * (1 + np.log(np.abs(sums))) * mean[bucket]
    some, sizes = np.diff(starts) > 0, np.diff(starts)
    per_text = lambda how, x: _reduced(how, x, starts[:-1][some])
    back = lambda x: np.repeat(x, sizes[some])
    w = w / np.sqrt(back(per_text(np.add, w * w)))
    strongest = np.zeros(len(sizes), np.int32)
    strongest[some] = per_text(np.maximum, np.where(np.abs(w) == back(per_text(np.maximum, np.abs(w))), bucket, -1))
    step = np.floor(2 * np.log2(np.maximum(sizes, 1))).astype(np.int32)
    return {"v": _list(starts, bucket=bucket, w=w), "s": pa.StructArray.from_arrays([pa.array(step), pa.array(strongest)], ["step", "strongest"])}


def counted(text: Column) -> Column:
    """A struct of `tokens`, the different ones of a lower-case text, and `tf`, how many there are of each, both parted by spaces; and of `buckets`, all that its vector needs but values of buckets.

    `buckets` has pairs of 32-bit integers: a bucket, and how many tokens are in it, below 0 where the last one's sign is. Rows
    of flat columns are written and shuffled far faster than lists of structs.
    """

    @F.arrow_udf("struct<tokens:string,tf:string,buckets:binary>")
    def taken(texts: pa.Array) -> pa.Array:
        tokens, tf, last, h, begins = _counted(texts)
        starts, bucket, sums = _sums(begins, tf, last, h)
        joined = lambda words: pa.array([" ".join(words[a:b]) for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False)], pa.string())
        pairs = np.stack([bucket, sums], 1).astype("<i4")
        packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(starts * np.int32(8)), pa.py_buffer(pairs.tobytes())])
        return pa.StructArray.from_arrays([joined(tokens), joined(list(map(str, tf.tolist()))), packed], ["tokens", "tf", "buckets"])

    return taken.asNondeterministic()(text)  # or a filter on what comes out would take every text apart a second time


def _pairs(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's pairs begin in all pairs, and these."""
    at = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    flat = np.frombuffer(packed.buffers()[2] or b"", "<i4", int(at[-1] - at[0]) // 4, int(at[0]))
    return (at - at[0]) // np.int32(8), flat.reshape(-1, 2).astype(np.int64)


def weighted(buckets: Column, means: dict[int, float]) -> Column:
    """`v` and `s` as `vectors` makes them, from the buckets that `counted` gives."""
    mean = np.array([means.get(b, 1.0) for b in range(DIM)])

    @F.arrow_udf(f"struct<v:{VECTOR},s:{SUMMARY}>")
    def made(packed: pa.Array) -> pa.Array:
        if not len(packed):
            return pa.array([], pa.struct([("v", pa.list_(pa.struct([("bucket", pa.int64()), ("w", pa.float64())]))), ("s", pa.struct([("step", pa.int32()), ("strongest", pa.int32())]))]))
        starts, flat = _pairs(packed)
        out = _unit(starts, flat[:, 0], flat[:, 1], mean)
        return pa.StructArray.from_arrays(list(out.values()), list(out))

    return made.asNondeterministic()(buckets)  # or a filter on what comes out would make every vector a second time


def has_any(buckets: Column, some: list[int]) -> Column:
    """Whether one of `some` is among the buckets that `counted` gives."""
    wanted = np.isin(np.arange(DIM), some)

    @F.arrow_udf("boolean")
    def found(packed: pa.Array) -> pa.Array:
        if not len(packed):
            return pa.array([], pa.bool_())
        starts, flat = _pairs(packed)
        sums = np.append(0, np.cumsum(wanted[flat[:, 0]]))
        return pa.array(sums[starts[1:]] > sums[starts[:-1]])

    return found(buckets)


def apart_by_rarity(text: Column, common: dict[str, int]) -> Column:
    """A struct of `buckets`: of each bucket of a lower-case text how many tokens are in it, the sign of the last, and the least number of documents that `common` has for one of them, or null; and of `rare`, the tokens that are not in `common`, with their buckets."""
    most = int(np.iinfo(np.int64).max)

    @F.arrow_udf(f"struct<buckets:{BUCKETS},rare:{RARE}>")
    def taken(texts: pa.Array) -> pa.Array:
        tokens, tf, last, h, begins = _counted(texts)
        bucket = np.where(h < 0, -1 - h, h)
        order, first, ends, starts = _groups(begins, bucket, last)
        df = np.fromiter((common.get(t, most) for t in tokens), np.int64, len(tokens))
        rare, least = df == most, _reduced(np.minimum, df[order], first)
        buckets = _list(starts, bucket=bucket[order][first], tf=_reduced(np.add, tf[order], first), sign=np.where(h[order][ends] < 0, -1.0, 1.0), df=pa.array(least, mask=least == most))
        at = np.append(0, np.cumsum(rare))[begins].astype(np.int32)
        return pa.StructArray.from_arrays([buckets, _list(at, bucket=bucket[rare], token=pa.array([tokens[i] for i in np.flatnonzero(rare)], pa.string()))], ["buckets", "rare"])

    return taken.asNondeterministic()(text)  # or a filter on what comes out would take every text apart a second time
