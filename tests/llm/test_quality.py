"""Quality rules against brute force and SQL."""

import itertools
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from merchlake.llm import op13_quality as op
from merchlake.llm.queries import OP13_SQL, op13_quality

SF = "/root/testdata/sf0.001"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return [n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n]


def other_rules(text):
    """Names of the rules beyond the base ones that reject a text."""
    text = text or ""
    n, chars, symbols, dup, _, _ = brute(text)
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    letters = [x for x in text if x.isalpha()]
    tests = {
        "word_length": chars < 2 * n or chars > 15 * n,
        "symbols": 10 * symbols > n,
        "duplicate_lines": 10 * dup > 3 * len(lines),
        "words_without_letters": 10 * sum(not any(c.isalpha() for c in w) for w in words) > 3 * n,
        "capitals": 2 * sum(c.isupper() for c in letters) > len(letters),
        "bullets": 10 * sum(bool(re.match(r"[ \t]*[-*•] ", x)) for x in lines) > 9 * len(lines),
    }
    return {k for k, v in tests.items() if v}


PLAIN = "One day the quiet river carried a small boat past the old mill and nobody on the bank looked up"
TEXTS = [
    None, "", " \n\t ", "a", "a b c d e", "a b c d e f " * 2, "a a a a a a", "a a a a a", PLAIN, PLAIN + "\n" + PLAIN, f"{PLAIN}\n{PLAIN} now\n\n{PLAIN}", "same line here\n" * 5, "x\ny\nx\ny \nx\r\nx\r\n", PLAIN.upper(), PLAIN + " # * $ % & | < >", PLAIN + " and so é😀 ß",
    "- one two three\n- four five six\n• seven eight nine\n * ten eleven twelve", "12 34 56 78 90 12 34 56 78 99 words here now", " ".join("supercalifragilistic" + "x" * i for i in range(12)), "q w e r t y u i o p a s d f", "a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9", "one - two\u0085- three", "!" * 100_000,
    " ".join(f"w{i % 977}" for i in range(50_000)), " ".join(f"w{i}" for i in range(200_000)) + " w1 w2 w3 w4 w5", "very long " * 100_000,
]


def test_measures_and_verdict_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in op.judge(docs).collect()}
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert [got[i][c] for c in BASE] == want, (text or "")[:80]
        assert got[i]["kept"] == (not want[-1] and not other_rules(text)), (text or "")[:80]
    assert got[8]["kept"] and len({frozenset(other_rules(t)) for t in TEXTS}) > 5


def test_query_on_the_whole_table(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = op13_quality(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert [r[c] for c in BASE] == want and r["kept"] == (not want[-1] and not other_rules(texts[r["doc_id"]]))


def test_query_matches_sql_and_labels(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    found = con.execute(OP13_SQL)
    names = [d[0] for d in found.description]
    df = op13_quality(spark, "/root/testdata/sf0.01")
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(found.fetchall())
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    by = {(r["quality"], r["kept"]): r["count"] for r in df.join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert by.get((1, False), 0) <= 0.01 * by[1, True] and by.get((0, True), 0) <= 0.1 * by[0, False]


def test_no_order_of_rules_changes_a_verdict(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if len(t or "") < 5000], "doc_id long, text string")
    others = [r for r in op.RULES if r not in op.BASE]
    want = None
    for order in itertools.islice(itertools.permutations(others), 0, 720, 91):
        got = sorted((r["doc_id"], r["kept"]) for r in op.judge(docs, order=list(order)).collect())
        want = want or got
        assert got == want


def test_rules_that_reject_much_for_little_come_first(spark):
    assert op.ordered([("a", 1.0, 0.1), ("b", 0.1, 0.1), ("c", 2.0, 0.0), ("d", 0.5, 0.9), ("e", 9.0, 0.0)]) == ["d", "b", "a", "c", "e"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {name: (cost, share) for name, cost, share in op.estimate(docs)}
    assert set(found) == set(op.RULES) and all(cost > 0 for cost, _ in found.values())
    texts = [r[0] for r in docs.select("text").collect()]
    assert abs(found["symbols"][1] - sum("symbols" in other_rules(t) for t in texts) / len(texts)) < 1e-9
    assert op.estimate(docs.limit(0))[0][2] == 0.0


def test_what_comes_after_a_rejection_is_not_asked(spark, monkeypatch):
    monkeypatch.setitem(op.MEASURES, "fails", lambda t: F.raise_error(F.lit("asked")).cast("long"))
    monkeypatch.setitem(op.RULES, "fails", (("fails",), lambda x: x > 0))
    df = spark.createDataFrame([("few",)], "text string")
    assert df.select(op.verdict(F.col("text"), ["few_words", "fails"]).alias("kept")).first()["kept"] is False


def test_nulls_repeats_empty_tables_and_clashing_names(spark):
    rows = [(None, PLAIN, 1), (None, PLAIN, 1), (7, None, 2), (7, PLAIN, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, whole int").selectExpr("*", "'m' as made", "1 as n_lines", "true as n_letters")
    got = sorted((str(r["doc_id"]), r["whole"], r["kept"]) for r in op.judge(docs, carry=("whole", "made")).collect())
    assert got == [("7", 2, False), ("7", 3, True), ("None", 1, True), ("None", 1, True)]
    assert op.judge(docs.limit(0)).collect() == []


def test_no_python_on_the_executors(spark):
    df = op13_quality(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
