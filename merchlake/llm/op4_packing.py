"""Best-fit packing of tokenised documents by large-item matching."""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from merchlake.llm.common import Scratch, small_batches

CAPACITY = 2048
#: Pieces in a group, about, in which pieces of a size are numbered.
GROUP_ROWS = 16_384
END_ID = 0
_LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """text -> token ids (numpy), by the vocabulary file at `path`, without special tokens.

    The file is read by `tokenizers`. Where it is byte-level BPE with the usual splitting, the same ids are had
    several times faster from `tiktoken` with the ranks of the same file; texts that hold a special token's string, or
    a very long run without white space or of white space alone, always go through `tokenizers`.
    """
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    spec = json.loads(own.to_str())
    special = [t["content"] for t in spec.get("added_tokens", [])]
    exact = lambda text: own.encode(text, add_special_tokens=False).ids
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return exact
    # ByteLevel writes printable Latin-1 bytes as themselves and the others, in order, as characters from U+0100
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    probe = "It's the thing, isn't it?  Zwölf  Ärzte\n\n\tniño 12345 !!! 你好 \U0001f600 x"
    if exact(probe) != fast.encode_ordinary(probe):
        return exact
    return lambda text: exact(text) if any(s in text for s in special) or _LONG_RUN.search(text) else fast.encode_ordinary(text)


def pieces_of(text: Column, tokenizer: str, capacity: int = CAPACITY) -> Column:
    """The pieces of a text: an array of structs of piece, start, length and ids_crc32."""
    kind = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"

    @F.pandas_udf(kind)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(tokenizer)
        for texts in batches:
            out = []
            for text in texts:
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                first = len(ids) % capacity or capacity
                at = [0, *range(first, len(ids) + 1, capacity)]
                out.append([{"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())} for i, (a, b) in enumerate(zip(at, at[1:], strict=False))])
            yield pd.Series(out)

    return cut(text)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """How to pack `counts[size]` pieces of each size: rows (size, first, last, per_sequence, sequence, offset).

    Pieces first..last (numbered from 0) of a size go to sequences from `sequence` on, `per_sequence` into each, one
    after another from `offset`. Large pieces (above a third of the capacity) pair at most twice a sequence: the
    largest first, each with the largest partner that still fits. Smaller ones, largest first, go into the smallest
    gap that takes them. All of a size are placed together, so the work and the plan depend on the number of sizes, at
    most the capacity, not on the number of pieces: a sequence that has taken one piece of a size is the best fit for
    the next while it has room, so whole groups of like sequences are filled at a stroke.
    """
    left, used = {s: n for s, n in sorted(counts.items(), reverse=True) if n}, dict.fromkeys(counts, 0)
    gaps: dict[int, list[list]] = {}  # room left: groups of [number of sequences, [(size, per sequence), ...]]

    def put(room: int, n: int, content: list) -> None:
        if n:
            gaps.setdefault(room, []).append([n, content])

    large = [s for s in left if 3 * s > capacity]
    for s in large:
        while left[s]:
            fits = [t for t in large if t <= min(s, capacity - s) and left[t] > (t == s)]
            if not fits:
                put(capacity - s, left[s], [(s, 1)])
                left[s] = 0
                break
            t = fits[0]
            n = left[s] // 2 if t == s else min(left[s], left[t])
            put(capacity - s - t, n, [(s, 2)] if t == s else [(s, 1), (t, 1)])
            left[s] -= n
            left[t] -= n
    for s in (s for s in left if 3 * s <= capacity):
        while left[s]:
            room = min((g for g in gaps if g >= s), default=None)
            if room is None:
                put(capacity, -(-left[s] // (capacity // s)), [])
                room = capacity
            n, content = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
            each = room // s
            full, rest = min(n, left[s] // each), 0
            if full < n:
                rest = left[s] - full * each
            put(room - each * s, full, [*content, (s, each)])
            if rest:
                put(room - rest * s, 1, [*content, (s, rest)])
            put(room, n - full - bool(rest), content)
            left[s] -= full * each + rest
    rows, sequence = [], 0
    for room in sorted(gaps):
        for n, content in gaps[room]:
            if not content:
                continue
            offset = 0
            for s, each in content:
                rows.append((s, used[s], used[s] + n * each - 1, each, sequence, offset))
                used[s] += n * each
                offset += s * each
            sequence += n
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each row of `docs` goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and one END_ID. Longer ones than the capacity are cut into pieces of it; the first piece
    may be shorter. Sizes are counted (at most `capacity` counts come to the driver), `plan` packs the counts, and each
    piece is placed by its size and its number among the pieces of that size. Numbers come from counts per size and
    group and a running number within each. Groups are a hash of a number that each written piece has, and as many as the
    pieces ask for; so no size, however common, and no document, however often it is there, is gathered in one task.
    Null texts count as empty: one piece of length 1. Null and repeated ids are kept as rows of their own; other
    columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "pack")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(pieces_of(F.col(text_col), tokenizer, capacity)).alias("p")).select("doc_id", "p.*")
    rows = scratch.keep(rows.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    groups = max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // GROUP_ROWS))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int"))
    in_group = scratch.keep(rows.groupBy("length", "grp").agg(F.count("*").alias("n")), "counts")
    counts = {int(r["length"]): r["n"] for r in in_group.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    firsts = in_group.select("length", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "grp").orderBy("rid")
    numbered = rows.withColumn("r", F.row_number().over(order)).join(firsts, ["length", "grp"]).withColumn("number", F.col("base") + F.col("r") - 1)
    kind = "size long, first long, last long, each long, sequence long, base_offset long"
    steps = spark.createDataFrame(plan(counts, capacity), kind)
    at = F.col("number") - F.col("first")
    placed = numbered.join(F.broadcast(steps), (F.col("length") == F.col("size")) & F.col("number").between(F.col("first"), F.col("last")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(at / F.col("each"))).alias("sequence_id"), (F.col("base_offset") + at % F.col("each") * F.col("length")).alias("offset"))
