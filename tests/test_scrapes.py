"""The data source of scrape folders: shapes, errors with lines, partitions by size, commits, streams."""

import json

import pytest
from pyspark.sql import functions as F

from merchlake.sources import scrapes


@pytest.fixture(autouse=True)
def registered(spark):
    scrapes.register(spark)


def test_all_shapes_and_errors(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    (a / "list.json").write_text('[{"n": 1}, 7, {"n": 2}]')
    (a / "products.json").write_text('{"data": [{"n": 9}], "products": [{"n": 3}]}')
    (a / "other.json").write_text('{"k": 1, "tags": [1], "things": [{"n": 4}]}')
    (a / "lines.jsonl").write_text('{"n": 5}\n\n{oops\n[1]\n{"n": "é"}\n')
    (a / "none.json").write_text('{"k": 1}')
    (a / "empty.json").write_text(" ")
    (a / "bad.json").write_text('{"n":\n  nope}')
    (a / "x-errors-1.json").write_text('[{"n": 0}]')
    (b / "list.json").write_text('[{"n": 100}]')
    (b / "more.json").write_text('{"items": [{"n": 6}]}')
    rows = spark.read.format("scrapes").load(f"{a},{b}").collect()
    good = {(r["file"], r["pos"], json.loads(r["product"])["n"]) for r in rows if r["error"] is None}
    assert good == {("list.json", 0, 1), ("list.json", 1, 2), ("products.json", 0, 3), ("other.json", 0, 4), ("lines.jsonl", 0, 5), ("lines.jsonl", 1, "é"), ("more.json", 0, 6)}
    bad = {(r["file"], r["line"]): r["error"] for r in rows if r["error"] is not None}
    assert set(bad) == {("lines.jsonl", 3), ("lines.jsonl", 4), ("none.json", None), ("empty.json", None), ("bad.json", 2)}
    assert bad["lines.jsonl", 4] == "line 4 is not an object" and bad["empty.json", None] == "empty"


def test_counters_come_with_the_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": 1}\n{"n": 2}\nno\n')
    (tmp_path / "b.json").write_text("")
    rows, seen = scrapes.counted(spark.read.format("scrapes").load(str(tmp_path)))
    assert rows.where("error is null").count() == 2
    assert seen.get == {"rows": 4, "errors": 2, "empty": 1, "products": 2}


def test_partitions_by_size_and_no_files(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.json").write_text(json.dumps([{"n": "x" * 1000}]))
    df = spark.read.format("scrapes").option("partitionBytes", "3500").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4 and df.count() == 10
    assert spark.read.format("scrapes").load(str(tmp_path / "nothing")).count() == 0


def test_what_is_written_is_there_when_all_of_it_is(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.range(20).select("id", F.when(F.col("id") % 2 == 0, "é").alias("t"))
    df.repartition(4).write.format("scrapes").mode("append").save(out)
    read = lambda: sorted(json.loads(r["product"])["id"] for r in spark.read.format("scrapes").load(out).collect())
    assert read() == list(range(20))
    failing = df.select(F.when(F.col("id") == 13, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id") + 100).alias("id")).repartition(4)
    with pytest.raises(Exception, match="no"):
        failing.write.format("scrapes").mode("append").save(out)
    assert read() == list(range(20)) and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    df.limit(3).write.format("scrapes").mode("overwrite").save(out)
    assert len(read()) == 3


def test_new_files_as_a_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for n in range(2):
        (src / f"{n}.json").write_text(json.dumps([{"n": n}, {"n": n + 10}]))
        stream = spark.readStream.format("scrapes").load(str(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
        query = stream.trigger(processingTime="1 second").start()
        query.processAllAvailable()
        query.stop()
        assert spark.read.parquet(out).count() == 2 * (n + 1)
