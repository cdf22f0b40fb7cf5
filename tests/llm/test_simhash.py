"""SimHash near-duplicates against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from merchlake.llm.op8_simhash import fingerprint_of, near_duplicates

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [fp for _, fp in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted((str(d), f"{fp:016x}", least.get(top(i))) for i, (d, fp) in enumerate(rows))


def result(df):
    return sorted((str(r[0]), r[1], r[2]) for r in df.collect())


def test_fingerprint_matches_brute_force(spark):
    texts = [None, "", " \n", "a", "A b", "The cat SAT on\x0bthe mat", "é À ß x y", "x " * 300]
    texts += [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    assert [fingerprint_of(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r[0], fingerprint_of(r[1])) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs)) == brute_components(rows)


def test_every_link_within_the_radius_is_found(spark, monkeypatch):
    """Fingerprints planted as numbers: chains, stars and hot groups of close ones."""
    import merchlake.llm.op8_simhash as op

    rng = np.random.default_rng(5)
    fps = []
    for _ in range(25):
        x = int(rng.integers(0, 2**63)) * 2 + 1
        fps.append(x)
        for _ in range(12):
            y = fps[-1] if rng.random() < 0.5 else x
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    hot = int(rng.integers(0, 2**62))
    fps += [hot ^ (1 << i) ^ (1 << j) for i in range(0, 40) for j in range(i)]
    monkeypatch.setattr(op, "fingerprint", lambda c: F.conv(c, 16, -10).cast("long"))
    signed = [fp - 2**64 if fp >= 2**63 else fp for fp in fps]
    docs = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long").select("doc_id", F.hex("fp").alias("text"))
    assert result(near_duplicates(docs)) == brute_components(list(enumerate(fps)))


def test_edge_cases(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "one two three four", 9), (3, "one two three four", 9), (None, "one two three four", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = result(near_duplicates(docs))
    assert got == brute_components([(d, fingerprint_of(t)) for d, t, _ in rows])
    assert near_duplicates(docs.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, "a b c")], "doc_id long, text string")
    assert result(near_duplicates(nulls)) == [("None", f"{fingerprint_of('a b c'):016x}", None)]


@pytest.mark.parametrize("words", [70_000])
def test_very_long_text(words):
    t = " ".join(f"w{i % 977}" for i in range(words))
    assert fingerprint_of(t) == brute_fingerprint(t)


def test_variants_meet_within_the_radius_and_differ_otherwise(spark):
    from merchlake.llm.op8_simhash import _variants

    rng = np.random.default_rng(8)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    rows = []
    for i, x in enumerate(fps):
        y = x
        for b in rng.choice(64, i % 4, replace=False):
            y ^= 1 << int(b)
            y = y - 2**64 if y >= 2**63 else y
        rows.append((i % 4, x, y, fps[i - 1]))
    df = spark.createDataFrame(rows, "d int, x long, y long, other long")
    got = df.select(F.arrays_overlap(_variants(F.col("x")), _variants(F.col("y"))), F.arrays_overlap(_variants(F.col("x")), _variants(F.col("other"))), F.size(_variants(F.col("x")))).collect()
    assert all(near and not far and n == 131 for near, far, n in got)
