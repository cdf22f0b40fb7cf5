"""As-of joins and streamed changes against plain loops."""

import datetime
import random

from pyspark.sql import functions as F

from merchlake.operators.asof import as_of
from merchlake.streaming.changes import changes

T0 = datetime.datetime(2024, 1, 1)
DAY = datetime.timedelta(days=1)


def as_of_brute(requests, history):
    out = []
    for i, k, at in requests:
        fits = [(t, tie, v) for kk, t, tie, v in history if kk is not None and kk == k and t is not None and at is not None and t <= at]
        best = max(fits, default=(None, None, None), key=lambda x: (x[0], x[1]))
        out.append((i, k, at, best[0], best[2]))
    return sorted(out, key=str)


def test_as_of_over_many_buckets(spark):
    r = random.Random(4)
    when = lambda: r.choice([None, *[T0 + DAY * r.uniform(0, 900) for _ in range(9)]])
    keys = [None, "a", "b", "hot", "hot", "hot"]
    history = [(r.choice(keys), when(), i, i if i % 5 else None) for i in range(300)] + [("a", T0 + DAY, 1000 + i, -i) for i in range(5)]
    requests = [(i, r.choice([*keys, "unknown"]), when()) for i in range(200)] + [(1, "a", T0 + DAY)] * 3 + [(2, "a", T0)]
    h = spark.createDataFrame(history, "k string, t timestamp, tie long, v long").withColumn("n", F.lit(1))
    q = spark.createDataFrame(requests, "i long, k string, at timestamp")
    for days in (1, 30, 5000):
        got = [tuple(x) for x in as_of(q, h, ["k"], "at", "t", ["v"], width_s=days * 86_400, ties=["tie"]).collect()]
        assert sorted(got, key=str) == as_of_brute(requests, history)


def test_as_of_with_empty_sides(spark):
    h = spark.createDataFrame([], "k string, t timestamp, v long")
    q = spark.createDataFrame([(1, "a", T0)], "i long, k string, at timestamp")
    assert [tuple(x) for x in as_of(q, h, ["k"], "at", "t", ["v"]).collect()] == [(1, "a", T0, None, None)]
    assert as_of(q.limit(0), h, ["k"], "at", "t", ["v"]).collect() == []


def streamed(spark, tmp_path, parts, gone_after_days, late="0 seconds"):
    src = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, "url string, at timestamp, v string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("url string, at timestamp, v string").option("maxFilesPerTrigger", 1).parquet(src)
    out = changes(stream, "url", "at", ["v"], gone_after_days * 86_400, late)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()
    return sorted((r["url"], (r["at"] - T0).days, r["status"]) for r in rows)


def test_sightings_in_and_across_batches(spark, tmp_path):
    at = lambda d: T0 + DAY * d
    parts = [
        [("a", at(0), "x"), ("a", at(2), "x"), ("a", at(1), "y"), ("b", at(0), "x"), (None, at(0), "x"), ("n", None, "x"), ("c", at(0), None)],
        [("a", at(3), "x"), ("a", at(30), "x"), ("c", at(4), None)],
        [("b", at(40), "x"), ("d", at(60), "x")],
    ]
    assert streamed(spark, tmp_path, parts, 10) == [
        ("a", 0, "added"), ("a", 1, "updated"), ("a", 2, "updated"), ("a", 3, "unchanged"), ("a", 13, "removed"), ("a", 30, "added"), ("a", 40, "removed"),
        ("b", 0, "added"), ("b", 10, "removed"), ("b", 40, "added"), ("b", 50, "removed"), ("c", 0, "added"), ("c", 4, "unchanged"), ("c", 14, "removed"), ("d", 60, "added"),
    ]


def test_removals_wait_for_late_rows(spark, tmp_path):
    at = lambda d: T0 + DAY * d
    parts = [[("a", at(0), "x")], [("b", at(12), "x")], [("a", at(9), "x"), ("b", at(13), "y")]]
    got = streamed(spark, tmp_path, parts, 10, "5 days")
    assert got == [("a", 0, "added"), ("a", 9, "unchanged"), ("b", 12, "added"), ("b", 13, "updated")]


def plain_changes(parts, gone_after):
    """Sightings in order of parts, key by key, with removals at the latest before what comes next or when all time has passed."""
    out, state, latest = [], {}, 0
    for part in parts:
        for key, ms, h in sorted(part):
            known, seen = state.get(key, (None, None))
            if seen is not None and ms - seen > gone_after:
                out.append((key, seen + gone_after, "removed"))
                known = seen = None
            out.append((key, ms, "added" if known is None else "unchanged" if h == known else "updated"))
            state[key] = (h, max(ms, seen or ms))
        latest = max([latest, *[ms for _, ms, _ in part]])
    return sorted(out + [(k, seen + gone_after, "removed") for k, (_, seen) in state.items() if seen + gone_after < latest])


def test_many_keys_are_followed_in_a_call_a_group(spark, tmp_path):
    """Not in one for each key and batch; and a batch may have any number of files."""
    r = random.Random(9)
    parts = [[(r.randrange(300), d * 40 + r.randrange(40), r.choice("xy")) for _ in range(900)] for d in range(3)]
    parts = [sorted({(k, d): (k, d, v) for k, d, v in part}.values()) for part in parts]
    src, schema = str(tmp_path / "in"), "k long, at timestamp, v string"
    spark.createDataFrame([], schema).write.parquet(src)
    out = changes(spark.readStream.schema(schema).parquet(src), "k", "at", ["v"], 30 * 86_400, groups=5)
    for part in parts:
        spark.createDataFrame([(k, T0 + DAY * d, v) for k, d, v in part], schema).repartition(3).write.mode("append").parquet(src)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert all(p["stateOperators"][0]["numRowsTotal"] <= 5 for p in query.recentProgress if p["stateOperators"])
    got = sorted((x["k"], (x["at"] - T0).days, x["status"]) for x in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect())
    assert got == plain_changes(parts, 30)
