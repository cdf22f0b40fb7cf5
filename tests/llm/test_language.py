"""Language identification: held-out accuracy, defined results for odd texts."""

import zstandard
from pyspark.sql import functions as F

from merchlake.llm import op1_language_id as op
from merchlake.llm.queries import op1_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op1_language_id(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 0.03 * len(rows)


def test_odd_texts(spark):
    words = {"xx": "alpha beta gamma delta epsilon zeta", "yy": "uno dos tres cuatro cinco seis"}
    train = spark.createDataFrame([(f"{text} {i} " * 30, lang) for lang, text in words.items() for i in range(40)] + [(None, "xx"), ("text", None), ("", "zz")], "text string, lang string")
    found = op.learn(train)
    assert sorted(found) == ["xx", "yy"]
    rows = [(1, None), (2, ""), (3, "123 !? \u00b2\u00bd"), (4, "dos tres cuatro"), (4, "dos tres cuatro"), (None, "BETA GAMMA delta " * 20_000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string")
    got = sorted(((r["doc_id"] or 0), r["lang_pred"], r["rejected"]) for r in op.identify(docs, found).collect())
    assert got == [(0, "xx", False), (1, "und", True), (2, "und", True), (3, "und", True), (4, "yy", False), (4, "yy", False)]
    assert op.identify(docs.limit(0), found).collect() == []
    assert op.learn(train.limit(0)) == {}
    assert {r["lang_pred"] for r in op.identify(docs, {}).collect()} == {"und"}


def test_sample_is_bounded(spark):
    train = spark.range(3000).select(F.concat_ws(" ", F.array_repeat(F.md5(F.col("id").cast("string").cast("binary")), 60)).alias("text"), F.lit("a").alias("lang"))
    (d,) = op.learn(train, dictionary_bytes=20_000).values()
    assert 10_000 <= len(d) <= 20_000


def test_scores_are_those_of_plain_encoding(spark):
    """Brute force: every whole text encoded with each learned dictionary, the smallest sum wins."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = op.learn(docs.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in op.identify(docs, learned).collect()}
    for doc, text in docs.select("doc_id", "text").collect():
        low, sums = (text or "").lower(), {}
        for lang, dictionary in learned.items():
            c = zstandard.ZstdCompressor(level=op.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sums[lang] = sum(len(c.compress(low[i : i + op.BLOCK].encode())) for i in range(0, len(low), op.BLOCK))
        if not any(map(str.isalpha, low)):
            assert got[doc] == ("und", 0.0, True)
            continue
        best, second = sorted(sums.values())[:2]
        lang, score, rejected = got[doc]
        assert sums[lang] == best
        assert score == 1 - best / second
        assert rejected == (score < op.MARGIN)


def test_ties_and_clashing_columns(spark):
    same = {lang: b"the same words in all of them " * 40 for lang in ("bb", "aa")}
    docs = spark.createDataFrame([(1, "the same words", "x", True)], "doc_id long, text string, lang_pred string, rejected boolean")
    (row,) = op.identify(docs, same).collect()
    assert (row["lang_pred"], row["score"], row["rejected"]) == ("aa", 0.0, True)


def test_copies_of_a_text_count_once(spark):
    rows = [("one two three four five six seven eight " * 40, "a")] * 400 + [(f"nine {i} ten {i * i} eleven " * 60, "a") for i in range(40)]
    few = op.learn(spark.createDataFrame(rows, "text string, lang string").repartition(4), dictionary_bytes=16_000)
    once = op.learn(spark.createDataFrame(list(dict.fromkeys(rows)), "text string, lang string"), dictionary_bytes=16_000)
    assert few == once
