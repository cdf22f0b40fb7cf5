"""Tables that change together, once for each batch, and only where they change."""

import pytest
from pyspark.sql import functions as F

from merchlake.operators import commits
from merchlake.operators.sinks import Snapshots


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, v string")


def held(table):
    return {(r["id"], r["v"]) for r in table.collect()}


def test_one_changed_key_rewrites_one_bucket(spark, tmp_path):
    t = commits.Tables(spark, str(tmp_path), buckets=16)
    t.commit("s", 0, {"t": (spark.range(400).select("id", F.lit("old").alias("v")), "id")})
    before = t.parts("t")
    assert len(before) == 16
    t.commit("s", 1, {"t": (rows(spark, (7, "new")), "id")})
    after = t.parts("t")
    changed = [b for b in before if before[b] != after[b]]
    assert len(changed) == 1 and set(after) == set(before)
    assert held(t.read("t")) == {(i, "new" if i == 7 else "old") for i in range(400)}
    assert (7, "new") in held(t.read("t", changed)) and t.read("t", changed).count() < 100


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    t = commits.Tables(spark, str(tmp_path), buckets=4)
    batch = dict(upserts={"t": (rows(spark, (1, "a"), (None, "n")), "id")}, appended={"log": rows(spark, (1, "seen"))})
    assert t.commit("s", 5, **batch) and not t.commit("s", 5, **batch) and not t.commit("s", 4, **batch)
    assert t.commit("other", 5, **batch)
    assert held(t.read("t")) == {(1, "a"), (None, "n")} and t.read("log").count() == 2 and t.last("s") == 5


def test_a_batch_that_dies_before_its_commit_has_changed_no_table(spark, tmp_path, monkeypatch):
    t = commits.Tables(spark, str(tmp_path), buckets=4)
    t.commit("s", 0, {"a": (rows(spark, (1, "x")), "id"), "b": (rows(spark, (1, "x")), "id")}, appended={"h": rows(spark, (1, "x"))})
    again = dict(upserts={"a": (rows(spark, (1, "y"), (2, "y")), "id"), "b": (rows(spark, (3, "y")), "id")}, removed={"b": rows(spark, (1, "")).select("id")}, appended={"h": rows(spark, (1, "y"))})

    def dies(self, df):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(Snapshots, "replace", dies)
        with pytest.raises(OSError):
            t.commit("s", 1, **again)
    assert held(t.read("a")) == {(1, "x")} and held(t.read("b")) == {(1, "x")} and t.read("h").count() == 1
    assert t.commit("s", 1, **again)
    assert held(t.read("a")) == {(1, "y"), (2, "y")} and held(t.read("b")) == {(3, "y")} and t.read("h").count() == 2


def test_removed_keys_and_buckets_that_become_empty(spark, tmp_path):
    t = commits.Tables(spark, str(tmp_path), buckets=8)
    t.commit("s", 0, {"t": (rows(spark, *[(i, "x") for i in range(20)]), "id")})
    t.commit("s", 1, {"t": (rows(spark), "id")}, removed={"t": spark.range(1, 25).select("id")})
    assert held(t.read("t")) == {(0, "x")} and len(t.parts("t")) == 1
    t.commit("s", 2, {"t": (rows(spark), "id")}, removed={"t": spark.range(1)})
    assert t.read("t").count() == 0 and t.read("nothing") is None


def test_old_files_expire(spark, tmp_path):
    t = commits.Tables(spark, str(tmp_path), buckets=2)
    for n in range(4):
        t.commit("s", n, {"t": (rows(spark, *[(i, str(n)) for i in range(6)]), "id")})
    assert t.expire(keep=2) == 0 and t.expire(keep=2, older_s=0) == 2
    assert held(t.read("t")) == {(i, "3") for i in range(6)}


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    src = str(tmp_path / "in")
    t = commits.Tables(spark, str(tmp_path / "db"), buckets=4)
    apply = commits.each_batch(t, "stream", lambda b: {"upserts": {"t": (b.groupBy("id").agg(F.max("v").alias("v")), "id")}, "appended": {"h": b}})
    for n in range(2):
        rows(spark, *[(i, f"{n}") for i in range(n, n + 5)]).write.mode("append").parquet(src)
        # two runs, the second from its start: its batches come again
        for state in ("a", f"b{n}"):
            stream = spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1000).parquet(src)
            stream.writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()
    assert held(t.read("t")) == {(0, "0")} | {(i, "1") for i in range(1, 6)} and t.read("h").count() == 10
