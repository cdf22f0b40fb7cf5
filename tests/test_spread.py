"""A catalog that is one file is the work of all cores."""

import re

from merchlake.operators import bands, ingest, names, requests
from merchlake.sources.catalog import phones

SF = "/root/testdata/sf0.001"


def dealt(df):
    return "RoundRobinPartitioning" in df._jdf.queryExecution().executedPlan().toString()


def test_products_of_names(spark):
    assert dealt(names.products(phones(spark, SF)))


def test_products_of_recommendations(spark, monkeypatch):
    seen, cheapest = [], bands.cheapest
    monkeypatch.setattr(bands, "cheapest", lambda r, p, most: (seen.append(dealt(p)), cheapest(r, p, most))[1])
    asked = requests.wishes(spark.createDataFrame([(1, "cheap 5G phone")], "query_id int, text string"))
    assert requests.recommend(asked, phones(spark, SF)).count() == 5
    assert seen == [True]


def test_merged_products_are_dealt_by_url_once(spark):
    fields = ["name", "brand"]
    columns = "id long, ord long, store string, source string, name string, brand string, price double, original_price double, in_stock boolean, stock_status string, scraped_file string, product_url string, url string"
    rows = [(i % 7, None if i % 11 == 0 else i * 37 % 101, f"s{i % 3}", None, None if i % 4 == 0 else f"n{i % 5}", "b" if i % 2 else "", float(i), None, i % 5 == 0, None, "f", f"u{i % 7}/{i % 2}", None) for i in range(100)]
    products = spark.createDataFrame(rows, columns).repartition(5, "id")
    merged = ingest.by_url(products, fields, "ord", near="id")
    plan = merged._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2  # the products' own, and one by url
    want = {}
    for r in rows:
        want.setdefault(r[11], []).append((-sum(bool(x) for x in r[4:6]), r[1] is None, r[1] or 0, r))
    for r in merged.collect():
        mine = sorted(want.pop(r["product_url"]), key=lambda x: x[:3])
        if mine[0][1:3] != mine[1][1:3]:
            assert (r["name"], r["brand"]) == mine[0][3][4:6]
        firsts = {}
        for x in mine:
            firsts.setdefault(x[3][2], x[:3])
        assert r["listings"] == len(mine) and [s["name"] for s in r["stores"]] == sorted(firsts, key=firsts.get)
    assert not want
