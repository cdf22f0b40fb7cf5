"""Mixing sources: targets and the mixture against brute force, and against SQL."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from merchlake.llm.op5_mixing import mix
from merchlake.llm.queries import OP5_SQL, op5_mixing

SF = "/root/testdata/sf0.01"


def brute(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing the excess again until none is above; the mixture by a loop over all passes."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, sizes, strict=True):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, budget = {}, share * sum(total.values())
    while True:
        free = [s for s in names if s not in target]
        left = budget - sum(target.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] >= most * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: most * total[s] for s in over}
    passes = []
    for s in names:
        own = sorted((hashlib.md5(str("" if d is None else d).encode()).hexdigest(), d or -1, n, i) for i, ((d, _, x), n) in enumerate(zip(rows, sizes, strict=True)) if x == s)
        run = 0
        ends = {}
        for key, d, n, _ in own:
            run += n
            ends[key, d, n] = run
        for key, d, n, i in own:
            for p in (0, 1):
                finish = (ends[key, d, n] + p * total[s]) / target[s] if target[s] > 0 else 0.0
                passes.append((finish, hashlib.md5(f"{s or ''}:{key}:{n}:{p}".encode()).hexdigest(), n, i))
    passes.sort(key=lambda x: x[:2])
    taken, run, at = [0] * len(rows), 0, 0
    while at < len(passes):
        end = at
        while end < len(passes) and passes[end][:2] == passes[at][:2]:
            end += 1
        run += sum(p[2] for p in passes[at:end])
        if run > budget:
            break
        for p in passes[at:end]:
            taken[p[3]] += p[2]
        at = end
    return sorted((str(d), n, total[s], round(target[s], 6), t) for (d, _, s), n, t in zip(rows, sizes, taken, strict=True))


def result(df):
    return sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    got = result(mix(docs))
    assert got == brute([tuple(r) for r in docs.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted((str(r[0]), r[1], r[2], round(r[3], 6), r[4]) for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({OP5_SQL})").fetchall())
    assert result(op5_mixing(spark, SF)) == got


@pytest.mark.parametrize("seed", range(3))
def test_small_sources_and_odd_rows(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 40]))), rng.choice(["a", "a", "a", "b", "é", "z", None, ""])) for i in range(200)]
    rows += [(None, "x y", "a"), (None, None, None), (7, "same same", "b"), (7, "same same", "b"), (8, "\x0b \t", "only empty")]
    docs = spark.createDataFrame([(d, t, s, 1) for d, t, s in rows], "doc_id long, text string, source string, target int")
    assert result(mix(docs)) == brute(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert result(mix(docs)) == [("1", 0, 0, 0.0, 0), ("2", 0, 0, 0.0, 0)]
    assert mix(docs.limit(0)).collect() == []
