"""Repeated passages against brute force."""

import itertools
import re
import time
from collections import defaultdict

import numpy as np

from merchlake.llm import op3_paragraphs as op
from merchlake.llm.op3_paragraphs import repeated_passages

SF = "/root/testdata/sf0.01"


def brute(rows, run_words=25):
    """Rows of repeated paragraphs, by comparing all paragraphs that share a shingle."""
    units = []
    for n, (doc, text) in enumerate(rows):
        at = 0
        for m in re.finditer(r"\S(?:[^\n.!?]|[.!?](?!\s|$))*[.!?]*", text or ""):
            w = m[0].lower().split()
            if len(w) >= 5:
                units.append((n, doc, at, len(w), m.start(), m.end(), frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))))
                at += 1
    up = list(range(len(units)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    by = defaultdict(list)
    for i, u in enumerate(units):
        for s in u[6]:
            by[s].append(i)
    for group in by.values():
        for i, j in itertools.combinations(group, 2):
            if top(i) != top(j) and len(units[i][6] & units[j][6]) >= 0.8 * len(units[i][6] | units[j][6]):
                up[top(i)] = top(j)
    members = defaultdict(list)
    for i in range(len(units)):
        members[top(i)].append(i)
    repeated = {i for m in members.values() if len(m) > 1 for i in m}
    out = []
    for n in range(len(rows)):
        own = [i for i, u in enumerate(units) if u[0] == n]
        for flag, run in itertools.groupby(own, key=lambda i: i in repeated):
            run = list(run)
            if flag and sum(units[i][3] for i in run) >= run_words:
                out += [(str(units[i][1]), units[i][2], units[i][4], units[i][5], units[i][3], min((units[j][1] for j in members[top(i)] if units[j][1] is not None), default=None)) for i in run]
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["paragraph"], r["start"], r["end"], r["words"], r["component_doc_id"]) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got, want = set(result(repeated_passages(docs))), set(brute([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    assert len(got & want) >= 0.995 * len(got | want)


def test_near_and_inline_copies(spark):
    words = [f"w{i}" for i in range(60)]
    long = " ".join(words) + "."
    near = " ".join(words[:30] + ["edit"] + words[31:]) + "."
    inline = "Some other words here before it. " + long + " And some more words behind it."
    rows = [(1, long), (2, near), (3, inline), (4, "A short line that is the same."), (5, "A short line that is the same."), (6, "Nothing is shared by this one at all.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeated_passages(docs).collect()
    assert result(spark.createDataFrame(got)) == brute(rows)
    assert sorted((r["doc_id"], r["removed"]) for r in got) == [(1, False), (2, True), (3, True)]
    assert len({r["component"] for r in got}) == 1


def test_edge_cases(spark):
    t = " ".join(f"x{i}" for i in range(30)) + "!"
    rows = [(None, t), (1, t), (1, t), (2, None), (3, ""), (4, "\n . ! ?"), (5, t + "\n" + t)]
    docs = spark.createDataFrame([(d, x, "c") for d, x in rows], "doc_id long, text string, component string")
    assert result(repeated_passages(docs)) == brute(rows)
    assert repeated_passages(docs.limit(0)).collect() == []
    assert repeated_passages(spark.createDataFrame([(None, t), (None, t)], "doc_id long, text string")).count() == 2


def test_short_runs_have_rows(spark):
    """Repeated paragraphs outside long runs are reported too, with the length of their run."""
    from merchlake.llm.op3_paragraphs import repeated_paragraphs

    own = lambda n: f"Words of number {n} only, namely a{n} b{n} c{n}."
    rows = [(n, f"{own(n)} A short line that is the same. {own(n + 10)} Again one that both of them hold. And a second right behind it.") for n in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeated_paragraphs(docs).collect()
    assert result(spark.createDataFrame(got)) == brute(rows, 1)
    assert sorted((r["doc_id"], r["paragraph"], r["run_words"], r["removed"]) for r in got) == [(n, p, w, n == 2) for n in (1, 2) for p, w in ((1, 7), (3, 13), (4, 13))]
    assert repeated_passages(docs).count() == 0


def test_pieces_and_short_units(spark):
    """Passages inside long sentences and in scripts without spaces are found; units under a shingle join by equality."""
    from merchlake.llm.op3_paragraphs import repeated_paragraphs

    passage = " ".join(f"p{i}" for i in range(60))
    inside = [" ".join(f"{c}{i}" for i in range(90)) + f" {passage} " + " ".join(f"{c}{i}" for i in range(90, 180)) + "." for c in "ab"]
    chinese = "".join(chr(0x4E00 + 37 * i) for i in range(60))
    dense = [chr(0x8000 + n) * 3 + "".join(chr(0x9000 + 100 * n + i) for i in range(40)) + chinese + chr(0x8100 + n) for n in (0, 1)]
    rows = [(1, inside[0]), (2, inside[1]), (3, dense[0]), (4, dense[1]), (5, "Only here."), (6, "All rights reserved.\nSome more words that are in here only."), (7, "All rights reserved."), (8, "same " * 500), (9, "none " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, got = dict(rows), repeated_paragraphs(docs).collect()
    at = lambda n: [texts[n][r["start"] : r["end"]] for r in got if r["doc_id"] == n]
    for n, m, whole in ((1, 2, passage), (3, 4, chinese)):
        assert len(at(n)) == len(at(m)) and all(len(set(part) & set(whole)) >= 0.8 * len(set(part)) for part in at(n) + at(m))
        assert min(sum(map(len, at(n))), sum(map(len, at(m)))) >= len(whole) / 3
    assert at(6) == at(7) == ["All rights reserved."] and at(5) == at(9) == []
    assert {(r["doc_id"], r["unit"], r["removed"]) for r in got if r["doc_id"] < 8} == {(n, u, n in (2, 4, 7)) for n, u in ((1, "piece"), (2, "piece"), (3, "piece"), (4, "piece"), (6, "short"), (7, "short"))}
    assert repeated_paragraphs(docs.where("doc_id < 8")).where("unit = 'sentence'").count() == 0


def test_rows_that_are_there_more_than_once(spark):
    from merchlake.llm.op3_paragraphs import repeated_paragraphs

    t = " ".join(f"x{i}" for i in range(30)) + "."
    got = repeated_paragraphs(spark.createDataFrame([(1, t)] * 3, "doc_id long, text string").repartition(2)).where("unit = 'sentence'").collect()
    assert sorted(r["removed"] for r in got) == [False, True, True]
    assert all((r["words"], r["run_words"], r["doc_id"]) == (30, 30, 1) for r in got)


def test_common_bands_are_split(spark, monkeypatch):
    """Paragraphs that share a band with many others are still found."""
    from merchlake.llm import op3_paragraphs as op

    rows = [(i, "these five words stand here " + " ".join(f"w{i}x{j}" for j in range(12)) + ".") for i in range(300)]
    rows += [(1000 + i, t[:-1] + " more.") for i, t in rows[::3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(op, "HOT", 1 << 40)
    usual = sorted(map(tuple, op.repeated_paragraphs(docs).drop("component").collect()))
    monkeypatch.setattr(op, "HOT", 20)
    assert sorted(map(tuple, op.repeated_paragraphs(docs).drop("component").collect())) == usual
    assert len(usual) >= 2 * 97


def test_very_long_text(spark):
    from merchlake.llm.op3_paragraphs import repeated_paragraphs

    passage = " ".join(f"p{i}" for i in range(80)) + "."
    long = " ".join(f"n{i} n{i * 7} n{i * i}." if i % 5 == 0 else f"n{i}" for i in range(150_000)) + "\n"
    docs = spark.createDataFrame([(1, long + passage), (2, passage)], "doc_id long, text string")
    got = repeated_paragraphs(docs).where("unit = 'sentence'").collect()
    assert sorted((r["doc_id"], r["words"], r["removed"]) for r in got) == [(1, 80, False), (2, 80, True)]


def template(n, own):
    """Sentences with 24 words of a template and some of their own: none is similar to another."""
    words = " ".join(f"common{j}" for j in range(24))
    return [f"{words} " + " ".join(f"own{i}x{j}" for j in range(own)) + "." for i in range(n)]


def test_many_different_sentences_of_one_template_are_soon_told_apart():
    """20,000 in one band: what they all have brings none of them together."""
    known = op._Hashes()
    bodies = [t.rstrip(".") for t in template(20_000, 16)]
    members = dict(enumerate(op._sets(bodies + [bodies[7] + " y", bodies[7] + " z"], known)))
    began = time.perf_counter()
    found = {frozenset(x) for x in op._similar(members)}
    assert time.perf_counter() - began < 60
    assert len(found) == 2 and frozenset({7, 20_000}) | frozenset({7, 20_001}) >= frozenset().union(*found)


def test_groups_of_a_large_band_lose_no_link():
    """Every two sets that are similar share a group, on either side of WIDE and across it."""
    r = np.random.default_rng(8)
    rarity = r.integers(0, 50, 1 << op.RARITY_BITS)
    narrow, sets = op._grouped(rarity), []
    for size in (4, 5, 9, 30, 50, 52, 60, 64, 65, 70, 80, 81, 200, 1500):
        base = r.integers(1, 1 << 63, size, dtype=np.uint64)
        for _ in range(12):
            other = base.copy()
            other = np.delete(other, r.integers(0, len(other), r.integers(0, max(1, size // 9) + 1)))
            other = np.concatenate([other, r.integers(1, 1 << 63, r.integers(0, max(1, size // 9) + 1), dtype=np.uint64)])
            sets.append(np.unique(other))
    import pyarrow as pa

    by = {}
    known_sets = iter(sets)
    original, op._sets = op._sets, lambda bodies, known: known_sets
    try:
        rows = pa.record_batch([pa.array([5] * len(sets), pa.int64()), pa.array(range(len(sets)), pa.int64()), pa.array(["x"] * len(sets)), pa.array([True] * len(sets))], ["band", "k", "body", "hot"])
        for batch in narrow([rows]):
            for band, k in zip(batch["band"].to_pylist(), batch["k"].to_pylist(), strict=True):
                by.setdefault(k, set()).add(band)
    finally:
        op._sets = original
    similar = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both >= op.SIMILARITY * (len(a) + len(sets[j]) - both):
                similar += 1
                assert by[i] & by[j], (len(a), len(sets[j]))
    assert similar > 100
