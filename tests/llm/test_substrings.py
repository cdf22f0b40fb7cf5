"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest
import zstandard

from merchlake.llm import op2_substrings as op

SF = "/root/testdata/sf0.01"


def brute(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(hash(t[i : i + window]) for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        reach = 0
        for i in range(len(t) - window + 1):
            if seen[hash(t[i : i + window])] > 1:
                for j in range(max(i, reach), i + window):
                    gone[j] = 1
                reach = i + window
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(d), len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(op.remove_repeats(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 200)


@pytest.mark.parametrize(("window", "gram", "block", "seed"), [(12, 5, 3, 1), (20, 8, 4, 2), (9, 9, 2, 3), (24, 4, 16, 4)])
def test_texts_of_few_letters(spark, monkeypatch, window, gram, block, seed):
    """Few letters make repeats of every length, overlapping others in all ways; small segments cut texts."""
    monkeypatch.setattr(op, "BLOCK", block)
    rng = random.Random(seed)
    words = ["".join(rng.choices("abé", k=rng.randint(3, 25))) for _ in range(40)]
    rows = [(i, "".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(150)]
    rows += [(150 + i, "".join(rng.choices("ab", k=60))) for i in range(40)]
    rows += [(200 + i, f"{i:x}" * 7 + rows[3][1] + f"{i * 7:x}") for i in range(60)]
    rows += [(300, "a" * 400), (301, "ab" * 100), (302, None), (302, None), (303, ""), (304, "xyz" * 30), (304, "xyz" * 30), (None, words[0] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(op.remove_repeats(docs, window, gram)) == brute(rows, window)


def test_long_texts_are_cut_into_segments():
    """A segment's end changes bundles, not positions."""
    import pyarrow as pa

    rng = random.Random(9)
    text = "".join(rng.choices("abcdefgh ", k=3000))
    whole = pa.record_batch([pa.array([1]), pa.array([zstandard.ZstdCompressor().compress(text.encode())])], names=["rid", "z"])

    def positions(segment):
        old, op.SEGMENT = op.SEGMENT, segment
        try:
            return sorted(a + i for b in op._bundled(iter([whole]), 50, 20) for a, n in zip(b["at"].to_pylist(), b["n"].to_pylist(), strict=True) for i in range(n))
        finally:
            op.SEGMENT = old

    assert positions(700) == positions(1 << 21) == list(range(3000 - 49))


def test_edge_tables(spark):
    docs = spark.createDataFrame([(1, "short", "x")], "doc_id long, text string, kept string")
    assert result(op.remove_repeats(docs)) == brute([(1, "short")], 200)
    assert op.remove_repeats(docs.limit(0)).collect() == []


def test_many_equal_rows_and_long_texts(spark):
    rng = random.Random(12)
    long = "".join(rng.choices("abcdefgh ", k=3_000_000))
    part = long[1_500_000:1_500_900]
    rows = [(7, part)] * 5000 + [(8, long), (9, long[2_097_000:2_097_600] + "z"), (10, part + "tail"), (11, "x" + long[-700:])]
    got = {r[0]: r[1:] for r in result(op.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))}
    empty = hashlib.sha256(b"").hexdigest()
    assert got["7"] == (900, 900, 1, empty) and got["9"] == (601, 600, 1, hashlib.sha256(b"z").hexdigest())
    assert got["10"] == (904, 900, 1, hashlib.sha256(b"tail").hexdigest()) and got["11"] == (701, 700, 1, hashlib.sha256(b"x").hexdigest())
    kept = long[:1_500_000] + long[1_500_900:2_097_000] + long[2_097_600:-700]
    assert got["8"] == (3_000_000, 2200, 3, hashlib.sha256(kept.encode()).hexdigest())
