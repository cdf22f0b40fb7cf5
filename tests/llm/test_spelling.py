"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from merchlake.llm import op11_spelling as op
from merchlake.llm.queries import op11_spelling

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def counted(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            seen[word] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    """Rows of all words, by trying every pair that shares a cut; no groups."""
    cuts = defaultdict(set)
    for w in words:
        for cut in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            cuts[cut].add(w)
    links = defaultdict(set)
    for together in cuts.values():
        for a in together:
            links[a].update(b for b in together if b != a and b not in links[a] and near(a, b))
    form = {}
    for w in words:
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(links[w]), None if form[w] is None else words[form[w]]))
    return out


def rows_of(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


def test_query_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute({w: n for w, n in counted(docs).items() if n >= 5})
    got = rows_of(op11_spelling(spark, SF))
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] for r in got) and any(r[4] > 1 for r in got)


WORDS = {
    "colour": 40, "color": 300, "colours": 6, "colouur": 2, "colouurr": 1, "colourr": 8, "bolour": 300, "cblour": 300, "ccolour": 300, "colouraa": 1, "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaab": 125, "baaaaaa": 125, "abaaaaa": 3,
    "ÿaaaaaa": 125, "😀olour": 7, "colou😀": 300, "": 50, "x": 10, "y": 10, "xy": 3, "alone in the world": 1, "couldn": 1, "couldm": 200, "coulmn": 200, "oouldn": 200, "cuoldn": 5,
}


def test_ties_runs_and_odd_words(spark):
    for least in (1, 2, 50):
        words = {w: max(1, n // least) for w, n in WORDS.items()}
        df = spark.createDataFrame(list(words.items()), "word string, n long")
        assert set(rows_of(op.group_variants(df))) == brute(words)


def test_all_words_of_a_small_alphabet(spark):
    """Every tie there is: 363 words of three letters with counts that repeat."""
    words = [a + b + c + d + e for a in ("", "a", "b") for b in ("a", "b", "c") for c in ("", "a", "b", "c") for d in "abc" for e in "ac"]
    words = {w: (5 ** (zlib.crc32(w.encode()) % 4)) for w in words}
    assert set(rows_of(op.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))) == brute(words)


def test_long_chains_end_at_one_root(spark):
    words = {"a" * (20 - i): 5**i for i in range(18)}
    got = {r[0]: r for r in rows_of(op.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert {r[2] for r in got.values()} == {"aaa"} and got["aaa"][1] is None


def test_words_of_very_long_runs(spark):
    """A run of 200,000 letters is one word; its rows have a fixed size, so it costs in proportion to its length."""
    long = ("abcdefghij" * 20_000)[:-1]
    docs = [(i, f"{long} {long}") for i in range(50)] + [(100, long + "x"), (101, long[:777] + "Z" + long[778:])]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    words = op.count_words(docs)
    got = {r[0]: r for r in rows_of(op.group_variants(words))}
    assert len(got) == 3 and got[long][4] == 2 and got[long][3] == 100
    assert all(r[1] == long for w, r in got.items() if w != long)


def test_counts_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "Résumé RÉSUMÉ resumes", 1), (1, "Résumé RÉSUMÉ resumes", 1), (None, "couldn wouldn " * 9, 2), (2, None, 3), (None, None, 4), (3, "", 5), (4, "short bits × ÷ ÀÈÌÒÙÝ", 6)] + [(i, "favourite colourful behaviour", 7) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").selectExpr("*", "n as word", "'x' as id", "1 as k1")
    got = {r["word"]: r["n"] for r in op.count_words(docs, drop_one_in=199).collect()}
    want = counted((r[0], r[1]) for r in rows)
    assert got == want and any(n == 1 for n in want.values())
    assert op.count_words(docs, drop_one_in=None).where("word = 'favourite'").first()["n"] == 400


def test_empty_table_and_bad_ratio(spark):
    assert op.group_variants(op.count_words(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    with pytest.raises(ValueError):
        op.group_variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_tables_of_counts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(op, "COUNTED", 3)
    monkeypatch.setattr(op, "ROWS", 7)
    import pyarrow as pa

    parts = list(op._counter(2, None)([pa.record_batch([pa.array(["1", "2"]), pa.array([b"ab cd ef gh", b"ab ab ij"])], ["id", "text"])]))
    assert len(parts) == 2
    total = Counter()
    for p in parts:
        total.update(dict(zip(p["word"].to_pylist(), p["n"].to_pylist(), strict=True)))
    assert total == {"ab": 3, "cd": 1, "ef": 1, "gh": 1, "ij": 1}
    sizes = [p.num_rows for p in op._keys([pa.record_batch([pa.array(["abcd", "efgh"]), pa.array([1, 2], pa.int64())], ["word", "n"])])]
    assert sum(sizes) == 18 and max(sizes) <= 9
