"""Engines behind one call: what fails is told and costs others nothing."""

import pytest
from pyspark.sql import functions as F

from merchlake.functions import slots as S
from merchlake.operators import answers, requests


def planned(spark, rows):
    return spark.createDataFrame(rows, "query_id int, step int, engine string, text string").withColumn("search_text", F.col("text"))


def echo(rows):
    return rows.select("query_id", F.upper("text").alias("text"))


def touchy(rows):
    return rows.select("query_id", F.when(F.col("text").contains("bad"), F.raise_error(F.lit("cannot take this")).cast("string")).otherwise(F.col("text")).alias("text"))


def test_a_request_that_fails_costs_no_other_its_answer(spark):
    rows = [(i, 1, "touchy", "bad" if i == 13 else f"t{i}") for i in range(20)] + [(i, 2, "echo", f"e{i}") for i in range(20)] + [(3, 3, "nowhere", "x")]
    said, failed = requests.dispatch(planned(spark, rows), {"touchy": touchy, "echo": echo})
    got = {(r["query_id"], r["step"], r["text"]) for r in said.collect()}
    assert got == {(i, 1, f"t{i}") for i in range(20) if i != 13} | {(i, 2, f"E{i}") for i in range(20)}
    errors = {(r["query_id"], r["step"], r["engine"]): r["error"] for r in failed.collect()}
    assert set(errors) == {(13, 1, "touchy"), (3, 3, "nowhere")} and errors[3, 3, "nowhere"] == "there is no engine nowhere"


def test_an_engine_that_always_fails_is_not_tried_for_ever(spark):
    runs = []

    def down(rows):
        runs.append(1)
        raise ConnectionError("down")

    said, failed = requests.dispatch(planned(spark, [(i, 1, "down", "t") for i in range(40)]), {"down": down}, tries=6)
    assert len(runs) <= 6 and said.count() == 0
    assert sorted(r["query_id"] for r in failed.collect()) == list(range(40)) and failed.first()["error"] == "ConnectionError: down"


def test_engines_that_are_one_function_run_together(spark):
    runs = []

    def counted(rows):
        runs.append(1)
        return echo(rows)

    said, failed = requests.dispatch(planned(spark, [(1, 1, "a", "x"), (1, 2, "b", "y"), (2, 1, "b", "z")]), {"a": counted, "b": counted})
    assert len(runs) == 1 and failed.count() == 0
    assert {(r["query_id"], r["step"], r["engine"], r["text"]) for r in said.collect()} == {(1, 1, "a", "X"), (1, 2, "b", "Y"), (2, 1, "b", "Z")}


def test_what_an_engine_says_it_cannot_do_is_an_error(spark):
    half = lambda rows: rows.select("query_id", F.when(F.col("query_id.query_id") == 1, F.col("text")).alias("text"), F.when(F.col("query_id.query_id") == 2, F.lit("no")).alias("error"))
    said, failed = requests.dispatch(planned(spark, [(i, 1, "h", "t") for i in (1, 2, 3)]), {"h": half})
    assert [r["query_id"] for r in said.collect()] == [1] and [(r["query_id"], r["error"]) for r in failed.collect()] == [(2, "no")]


def test_the_guard_keeps_other_requests_from_engines(spark):
    seen = []

    def search(rows):
        seen.extend(r["text"] for r in rows.collect())
        return echo(rows)

    texts = spark.createDataFrame([(1, "hello"), (2, "phone"), (3, "recipe for chicken curry"), (4, None)], "query_id int, text string")
    found, failed = answers.answer(texts, {n: search for n in (*answers.CATALOG, *answers.SEARCHES)})
    got = {r["query_id"]: r for r in found.collect()}
    assert set(seen) == {"phone"} and failed.count() == 0
    assert got[1]["answer"] == S.REPLIES["GENERAL_GREETING"] and got[3]["answer"] == S.REPLIES["UNRELATED"] and got[4]["answer"] == S.REPLIES["UNKNOWN"]
    assert "PHONE" in got[2]["answer"] and got[2]["answer"].startswith("### ")


def down(rows):
    raise ConnectionError("down")


def test_an_engine_that_fails_does_not_look_like_one_that_finds_nothing(spark):
    texts = spark.createDataFrame([(1, "phone"), (2, "hello")], "query_id int, text string")
    nothing = lambda rows: rows.select("query_id", F.lit(None).cast("string").alias("text"))
    every = (*answers.CATALOG, *answers.SEARCHES)
    empty, failed = answers.answer(texts, dict.fromkeys(every, nothing))
    assert {r["query_id"]: r["answer"] for r in empty.collect()}[1] == S.NO_ANSWER and failed.count() == 0
    for engines in (dict.fromkeys(every, down), {}):
        found, failed = answers.answer(texts, engines)
        got = {r["query_id"]: r["answer"] for r in found.collect()}
        assert failed.count() and all(r["broken"] and f"- {r['engine']}: {r['error']}" in got[1] for r in failed.collect())
        assert got[2] == S.REPLIES["GENERAL_GREETING"]
    with pytest.raises(ConnectionError):
        answers.answer(texts, dict.fromkeys(every, down), strict=True)
    with pytest.raises(LookupError):
        answers.answer(texts, {}, strict=True)


def test_queries_on_chats_end_with_the_error_of_an_engine(spark, monkeypatch):
    from merchlake.plans import requests as plans

    monkeypatch.setattr(answers, "priced", lambda *a: down(None))
    with pytest.raises(ConnectionError):
        plans.chat_answers(spark, "/root/testdata/sf0.001")


def test_documents_that_cannot_be_embedded_are_found(spark):
    from merchlake.operators.isolation import embedded

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "id long, text string")

    def embed(rows):
        return rows.select("id", F.when(F.col("id").isin(4, 17), F.raise_error(F.lit("too long")).cast("int")).otherwise(F.length("text")).alias("v"))

    vectors, errors = embedded(docs, "id", embed)
    assert {r["id"] for r in vectors.collect()} == set(range(30)) - {4, 17}
    assert {r["id"] for r in errors.collect()} == {4, 17}
    nothing, errors = embedded(docs, "id", lambda rows: 1 / 0, tries=3)
    assert nothing is None and errors.count() == 30 and errors.first()["error"].startswith("ZeroDivisionError")
