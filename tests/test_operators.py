"""Facts about single operators, and jobs that read and write."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.operators import catalog, commits, comparison, documents, entities, rendering, retrieval, scoring, sinks, understanding
from merchlake.operators import ingest as ingest_ops
from merchlake.sources import feeds, pages
from merchlake.streaming.listings import arrivals, each_once, ingest, run_available, windowed

S25 = {
    "id": 1, "name": "Samsung Galaxy S25 Ultra 5G", "brand": "Samsung", "category": "Flagship Foldable", "price_min": 120000.0, "price_max": 140000.0, "ram_gb": 12, "storage_gb": 256, "battery_mah": 5000, "charging_w": 45, "display_inches": 6.8,
    "display_text": "6.8 inch Dynamic AMOLED 2X 120Hz 2600 nits LTPO Gorilla Glass Victus 2", "camera_text": "200 MP wide OIS + 50 MP telephoto 5x optical zoom + 12 MP ultrawide, 8K video ProRes", "processor_text": "Qualcomm Snapdragon 8 Gen 3 for Galaxy",
    "battery_text": None, "os": "Android 15, One UI 7, 7 years software updates, Galaxy AI", "body_text": "IP68 dust/water resistant, Titanium frame, Armor Aluminum", "network": "5G",
}
# "raw" also counts inside "ultrawide", so photography has two flags
SCORES = {
    "camera": 0.75, "gaming": 0.827381, "battery": 0.392857, "display": 0.856777, "charging": 0.25, "value": 0.518895, "student": 0.573629, "travel": 0.671429, "photography": 0.883333, "durability": 1.0, "resale": 0.85,
    "ai_features": 1.0, "software": 0.95, "foldable": 1.0, "compact": 0.2, "business": 0.627778, "ecosystem": 0.85, "accessibility": 0.730952, "content_creator": 0.875,
}
KINDS = "id long, name string, brand string, category string, price_min double, price_max double, ram_gb int, storage_gb int, battery_mah int, charging_w int, display_inches double, display_text string, camera_text string, processor_text string, battery_text string, os string, body_text string, network string"


def phones(spark, *rows):
    return spark.createDataFrame([tuple({**S25, **r}[c.split()[0]] for c in KINDS.split(", ")) for r in rows], KINDS)


def test_scores_of_a_known_product(spark):
    r = scoring.with_scores(phones(spark, {}), list(SCORES)).first()
    assert {n: round(r[f"s_{n}"], 6) for n in SCORES} == SCORES
    assert scoring.with_scores(phones(spark, {}), ["nothing"]).first()["s_nothing"] == 0.0


def test_scores_of_an_empty_product_are_in_range(spark):
    empty = {k: None for k in S25 if k != "id"}
    r = scoring.with_scores(phones(spark, empty), list(scoring.SCORERS)).first()
    assert all(0 <= r[f"s_{n}"] <= 1 for n in scoring.SCORERS)


def test_compare_has_a_row_a_dimension(spark):
    df = phones(spark, {}, {"id": 2, "name": "Apple iPhone 17 Pro Max", "brand": "Apple", "price_min": 160000.0, "ram_gb": 8, "battery_mah": 4422, "charging_w": 27})
    assert comparison.dimensions(df).count() == 20
    assert comparison.dimensions(df, "camera").count() == 8
    assert {r["id"] for r in comparison.leader(comparison.dimensions(df)).where("leads").collect()} == {1}


def test_names_and_keys(spark):
    rows = [("Samsung", "Samsung Galaxy S25 Ultra 5G (12GB/256GB) with 1 Year Warranty"), ("samsung ", "Galaxy S25 Ultra 12GB/256GB | Official"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "brand string, name string").select(entities.product_key(F.col("brand"), F.col("name"))).collect()]
    assert got == ["samsung|galaxy s25 ultra", "samsung|galaxy s25 ultra", "|"]


def test_where_compiles_nested_conditions(spark):
    df = spark.range(10)
    assert [r[0] for r in df.where(catalog.where({"$or": [{"id": 3}, {"id": {"$gt": 6, "$ne": 8}}]})).collect()] == [3, 7, 9]
    assert df.where(catalog.where({})).count() == 10


def test_budget_and_scope(spark):
    rows = {"Best phone under 30k": (30000.0, None), "between 20k and 30k": (30000.0, 20000.0), "above 40k": (None, 40000.0), "iphone 16 and 17": (17000.0, 16000.0), "a nice one": (None, None)}
    df = spark.createDataFrame([(q,) for q in rows], "q string")
    most, least = understanding.budget(F.col("q"))
    assert {r["q"]: (r[1], r[2]) for r in df.select("q", most, least).collect()} == rows


def test_documents_come_back(spark):
    df = phones(spark, {}, {"id": 2, "os": " ", "category": None})
    shops = spark.createDataFrame([(1, "Shop A", 120000.0, True, None), (1, "Shop B", 125500.0, False, "Out"), (1, "shop a ", None, None, "In Stock")], "id long, name string, price double, in_stock boolean, stock_status string")
    docs = df.join(ingest_ops.store_buckets(shops, "id", [F.col("name")]), "id", "left").select("id", documents.render().alias("d"))
    got = {r["id"]: tuple(r)[1:] for r in docs.select("id", *[e.alias(n) for n, e in documents.parse(F.col("d")).items()]).collect()}
    assert got == {1: (S25["name"], "Samsung", "Flagship", 120000, 125500, 2, 2), 2: (S25["name"], "Samsung", "Mobile", None, None, 0, 0)}
    text = docs.where("id = 2").first()["d"]
    assert "No live price is currently reported by any store." in text and "none reported" in text and "Operating System" not in text


def test_ingest_embeds_only_changed_documents(spark, tmp_path):
    tables = [sinks.Snapshots(spark, f"{tmp_path}/{n}") for n in ("t", "m", "v")]
    embedded = []

    def embed(docs):
        embedded.append(sorted(r["id"] for r in docs.collect()))
        return docs.select("id", F.length("text").alias("size"))

    def run(*rows):
        df = spark.createDataFrame(rows, "id long, name string, price double")
        return {r["status"]: r["n"] for r in ingest(df, tables[0], tables[1], "id", ["name", "price"], F.concat(F.lit("about "), "name"), embed, tables[2]).collect()}

    assert run((1, "a", 1.0), (2, "b", 2.0), (2, "b", 2.0)) == {"added": 2}
    assert run((1, "a", 9.0), (2, "bb", 2.0)) == {"updated": 2}
    assert run((1, "a", 9.0), (3, "c", 1.0)) == {"added": 1, "removed": 1, "unchanged": 1}
    assert run((1, "a", 9.0), (3, "c", 1.0)) == {"unchanged": 2}
    assert embedded == [[1, 2], [2], [3]]
    assert sorted(tuple(r) for r in tables[2].read().collect()) == [(1, 7), (3, 7)]
    assert sorted(r["id"] for r in tables[0].read().collect()) == [1, 3]


def test_snapshots_do_not_overwrite_each_other(spark, tmp_path):
    one, two = (sinks.Snapshots(spark, f"{tmp_path}/t") for _ in range(2))
    one.replace(spark.range(3))
    seen = two.newest()
    two.newest = lambda: seen
    one.replace(spark.range(4))
    with pytest.raises(RuntimeError, match="someone else"):
        two.replace(spark.range(5))
    assert one.read().count() == 4


def test_arrays_results_and_policies(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    sinks.write_array(rows, f"{tmp_path}/array")
    assert sorted((r["id"], r["name"]) for r in sinks.read_array(spark, f"{tmp_path}/array").collect()) == [(1, "a"), (2, None)]
    (tmp_path / "no.json").write_text('{"id": 1}')
    with pytest.raises(ValueError, match="list of records"):
        sinks.read_array(spark, str(tmp_path / "no.json"))
    error = F.when(F.col("name").isNull(), F.lit("no name"))
    good, bad = sinks.checked(rows, error, "skip")
    assert good.count() == 1 and bad.first()["error"] == "no name"
    sinks.write_result(good, bad, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out.errors").count() == 1
    with pytest.raises(Exception, match="no name"):
        sinks.checked(rows, error)[0].collect()
    sinks.log_failures(bad.select("id", "error"), "load", f"{tmp_path}/log")
    sinks.log_failures(bad.select("id", "error"), "embed", f"{tmp_path}/log")
    assert sorted(r["stage"] for r in spark.read.json(f"{tmp_path}/log").collect()) == ["embed", "load"]


def test_normalised_tables_find_or_create(spark, tmp_path):
    kinds = "store string, brand string, model string, variant_key string, price double, in_stock boolean, product_url string, scraped_at timestamp"
    at = datetime.datetime(2025, 1, 2)
    first = spark.createDataFrame([("A", "x", "m1", "k1", 1.0, True, "u1", at), ("B", "x", "m1", "k1", 2.0, True, "u2", at)], kinds)
    second = spark.createDataFrame([("B", "x", "m2", "k2", 3.0, False, "u3", at), ("C", "x", "m1", "k1", 4.0, True, "u4", at)], kinds)
    db = commits.Tables(spark, f"{tmp_path}/db", buckets=4)
    for number, batch in enumerate((first, second, second)):
        assert commits.import_listings(db, "scrape", min(number, 1), batch) == (number < 2)
    assert {(r["name"], r["store_id"]) for r in db.read("stores").collect()} == {("A", 1), ("B", 2), ("C", 3)}
    assert {(r["model"], r["model_id"]) for r in db.read("models").collect()} == {("m1", 1), ("m2", 2)}
    assert {(r["variant_key"], r["model_id"]) for r in db.read("variants").collect()} == {("k1", 1), ("k2", 2)}
    assert sorted((r["store_id"], r["price"]) for r in db.read("listings").collect()) == [(1, 1.0), (2, 2.0), (2, 3.0), (3, 4.0)]
    db.compact("listings")
    assert len(db.parts("listings")[None]) == 1 and db.read("listings").count() == 4


def test_vectors_are_checked(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, embedding array<double>")
    with pytest.raises(Exception, match="2 has 1 components, not 2"):
        ingest_ops.checked_vectors(v, 2).collect()
    with pytest.raises(LookupError, match="no such id: 3"):
        ingest_ops.update_vectors(v, spark.createDataFrame([(3, "x")], "id long, label string"), "id", ["label"])
    with pytest.raises(ValueError):
        ingest_ops.delete_vectors(v)
    assert ingest_ops.delete_vectors(v, where=F.size("embedding") == 1).count() == 1


def test_condition_texts():
    assert retrieval.parsed_where(["price<=30000"]) == {"price": {"$lte": 30000}}
    assert retrieval.parsed_where(["brand='Samsung'", "score>0.5"]) == {"$and": [{"brand": "Samsung"}, {"score": {"$gt": 0.5}}]}
    assert retrieval.parsed_where([]) == {}
    with pytest.raises(ValueError, match="no comparison"):
        retrieval.parsed_where(["brand"])


def test_templates_and_volatile_fields(spark):
    assert rendering.placeholders("a {{x}} {{ y }} {{x}}") == ["x", "y"]
    with pytest.raises(KeyError):
        rendering.filled("{{x}}", {})
    df = spark.createDataFrame([(1, "t", [("s", "t")])], "id long, scraped_at string, stores array<struct<name string, scraped_at string>>")
    assert feeds.stable(df, ["scraped_at"]).schema.simpleString() == "struct<id:bigint,stores:array<struct<name:string>>>"
    assert spark.range(1).select(T.digits(F.lit("Tk 1,350.00")), T.digits(F.lit("none"))).first() == (135000, None)


def test_scrape_files_of_all_shapes(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    product = {"productUrl": "u1", "name": "P", "price": 100, "inStock": True, "specs": {"Display": {"Size": "6.1", "Type": "OLED"}, "RAM": "8 GB"}}
    files = {
        a / "star-tech-2026-06-19T11-53-57-549Z.json": {"products": [product]}, a / "list-2026-06-19T11-53-57-549Z.json": [{"url": "u2"}, 7, "x"], a / "items.json": {"items": [{"url": "u3"}]},
        a / "data.json": {"data": [{"url": "u4"}]}, a / "other.json": {"n": 1, "tags": [1], "things": [{"url": "u5"}]}, a / "x-errors-1.json": {"products": [product]}, b / "items.json": {"items": [{"url": "other"}]},
    }
    for path, content in files.items():
        path.write_text(json.dumps(content, indent=1))
    (a / "empty.json").write_text(" ")
    (a / "bad.json").write_text("{nope")
    found = feeds.scrape_files(spark, str(a), str(b))
    assert {r["state"]: r["files"] for r in feeds.load_report(found).collect()} == {"loaded": 5, "empty": 1, "invalid": 1}
    rows = {r["productUrl"]: r for r in feeds.canonical(feeds.product_rows(found)).collect()}
    assert set(rows) == {"u1", "u2", "u3", "u4", "u5"}
    assert rows["u1"]["source"] == "Star Tech" and rows["u1"]["price"] == 100.0
    assert rows["u1"]["specs"] == {"Size": "6.1", "Type": "OLED", "RAM": "8 GB"}


def test_csv_catalog(spark, tmp_path):
    (tmp_path / "c.csv").write_text('brand,name,Display,Battery\nA,x,"6.1 ""in""\nOLED",\nB,y,,5000\n')
    rows = {r["name"]: r["sections"] for r in feeds.csv_catalog(spark, str(tmp_path / "c.csv"), ["Display", "Battery"]).collect()}
    assert rows == {"x": {"Display": '6.1 "in" OLED'}, "y": {"Battery": "5000"}}


def test_ingest_writes_only_changes_and_can_be_repeated(spark, tmp_path):
    table, manifest = (sinks.Snapshots(spark, str(tmp_path / n)) for n in ("table", "manifest"))
    make = lambda rows: spark.createDataFrame(rows, "url string, name string, seen int")
    run = lambda rows: {r["status"]: r["n"] for r in ingest(make(rows), table, manifest, "url", ["name"]).collect()}
    assert run([("a", "A", 1), ("b", "B", 1), ("d", "D", 1)]) == {"added": 3}
    assert run([("a", "A", 2), ("b", "B", 2), ("d", "D", 2)]) == {"unchanged": 3}
    assert run([("a", "A", 3), ("b", "B2", 3), ("c", "C", 3)]) == {"added": 1, "updated": 1, "unchanged": 1, "removed": 1}
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", "A", 1), ("b", "B2", 3), ("c", "C", 3)]


def test_streams_of_files(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 10:00:00", "k", 1.0) for i in range(30)] * 2
    df = spark.createDataFrame(rows, "id long, ts string, key string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    stream = arrivals(spark, str(tmp_path / "in"), df.schema, "ts")
    run_available(each_once(stream, "id", "ts", "5 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    run_available(windowed(arrivals(spark, str(tmp_path / "in"), df.schema, "ts"), "ts", "value", "key"), str(tmp_path / "out2"), str(tmp_path / "state2"))
    assert all(r["n"] == 20 for r in spark.read.parquet(str(tmp_path / "out2")).collect())


def test_documents_and_history_are_written(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x y", None), ("b", "z", 3)], "id string, text string, n int")
    sinks.write_documents(docs, str(tmp_path / "docs"))
    assert sorted(r["id"] for r in feeds.documents(spark, str(tmp_path / "docs")).collect()) == ["a", "b"]
    day = spark.createDataFrame([(1, "2024-05-01 03:00:00")], "id int, scraped_at string").withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))
    for _ in range(2):
        sinks.append_history(day, str(tmp_path / "history"))
    assert spark.read.parquet(str(tmp_path / "history")).where("day = '2024-05-01'").count() == 2


def test_snippets(spark):
    df = spark.createDataFrame([("word " * 100,), ("One. Two",), (None,)], "t string")
    got = [tuple(r) for r in df.select(T.snippet(F.col("t")), T.first_sentence(F.col("t"))).collect()]
    assert got[0][0].endswith("word…") and len(got[0][0]) <= 281
    assert got[1] == ("One. Two", "One.") and got[2] == (None, None)


def test_nesting_of_any_depth(spark):
    deep = '{"a": ' * 40 + "1" + "}" * 40
    df = spark.createDataFrame([(1, deep), (2, '{"x": {"y": [1, 2], "z": null}, "e": {}}'), (3, "no json"), (4, None), (5, '{"p": {"q": 1}, "p_q": 2}')], "id long, j string")
    got = {(r["id"], r["name"], r["value"]) for r in feeds.flattened_rows(df, "id", "j").collect()}
    assert got == {(1, "_".join("a" * 40), "1"), (2, "x_y", "[1,2]"), (5, "p_q", "2")}


def test_links_that_run_in_circles(spark):
    link = lambda to: f'<a title="Next page" href="{to}">'
    rows = [("https://h/a", link("b")), ("https://h/b", link("/c")), ("https://h/c", link("https://h/b")), ("https://h/d", link("gone")), ("https://h/e", "")]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {(r["first_url"][-1], r["step"], r["url"][-1]) for r in pages.followed(df, df.where("url not like '%b'"), "https://h").collect()}
    assert got == {("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c"), ("c", 0, "c"), ("c", 1, "b"), ("d", 0, "d"), ("e", 0, "e")}


def test_a_kind_of_product_without_crumbs(spark):
    df = spark.createDataFrame([(None, []), ("phones", None), (None, [" "])], "o string, k array<string>")
    assert [r[0] for r in df.select(pages.category(F.col("o"), F.col("k"))).collect()] == [None, "phones", None]


def test_lines_that_are_not_json_are_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\n\nnot json\n{"id": "2"}\n[1]\n')
    (tmp_path / "b.jsonl").write_text('{"id": "3", "text": "y"}\n')
    got = [(r["file"].rpartition("/")[2], r["line"], r["text"]) for r in feeds.bad_lines(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [("a.jsonl", 3, "not json"), ("a.jsonl", 5, "[1]")]


def test_documents_that_fail_are_embedded_in_the_next_run(spark, tmp_path):
    table, manifest, vectors = (sinks.Snapshots(spark, str(tmp_path / n)) for n in ("t", "m", "v"))
    rows = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "url string, name string")
    bad = {"b"}
    embed = lambda df: df.select("url", F.when(F.col("url").isin(*bad), F.raise_error(F.lit("no")).cast("int")).otherwise(F.length("text")).alias("v")) if bad else df.select("url", F.length("text").alias("v"))
    run = lambda: {r["status"]: r["n"] for r in ingest(rows, table, manifest, "url", ["name"], F.col("name"), embed, vectors).collect()}
    assert run() == {"added": 3, "not_embedded": 1} and vectors.read().count() == 2
    bad.clear()
    assert run() == {"unchanged": 2, "updated": 1} and vectors.read().count() == 3
    assert run() == {"unchanged": 3}


def test_last_values_of_names_made_standard(spark):
    rows = [("a", "RAM", "8", 1), ("a", "memory", "12", 2), ("a", "RAM", "", 3), ("a", "Weight", None, 4), ("b", "Chip", "x", 1), ("b", "RAM", "6", 2)]
    df = spark.createDataFrame(rows, "key string, name string, value string, ord long")
    got = ingest_ops.last_values(df, "key", "name", "value", "ord", ingest_ops.wide_spec_name)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "ram", "12"), ("b", "processor", "x"), ("b", "ram", "6")]
