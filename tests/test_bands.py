"""The cheapest matches by bands are those of looking at every product."""

import random

from merchlake.operators import bands

PRODUCTS = "id long, price_min double, brand string, foldable boolean, five_g boolean"
REQUESTS = "query_id int, budget_min double, budget_max double, brand string, foldable boolean, five_g boolean"


def brute(requests, products, most):
    out = set()
    for q, lo, hi, brand, fold, five in requests:
        fits = sorted((p, i) for i, p, b, f, g in products if p is not None and p > 0 and (lo is None or p >= lo) and (hi is None or p <= hi) and (brand is None or b is not None and b.lower() == brand.lower()) and (not fold or f) and (not five or g))
        out |= {(q, i, p) for p, i in fits[:most]}
    return out


def found(spark, requests, products, most):
    df = bands.cheapest(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(products, PRODUCTS), most)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some(n, seed):
    r = random.Random(seed)
    price = lambda: r.choice([None, 0.0, -5.0, 100.0, float(r.randint(1, 50)), r.uniform(50, 5000), 10.0 ** r.randint(0, 7)])
    return [(i, price(), r.choice([None, "Acme", "ACME", "Zed", "Other"]), r.choice([True, False, None]), r.choice([True, False])) for i in range(n)]


def wishes(n, seed):
    r = random.Random(seed)
    edge = lambda: r.choice([None, None, 0.0, -1.0, 100.0, r.uniform(1, 200), r.uniform(50, 5000), 1e6, 1e9, 0.5])
    return [(i, edge(), edge(), r.choice([None, "acme", "zed", "none of these"]), r.choice([True, False, None]), r.choice([True, False])) for i in range(n)]


def test_many_requests(spark, monkeypatch):
    monkeypatch.setattr(bands, "BAND", 16)
    products, requests = some(1200, 1), wishes(120, 2)
    for most in (1, 7, 100):
        assert found(spark, requests, products, most) == brute(requests, products, most)


def test_one_price_that_a_third_of_all_have(spark, monkeypatch):
    monkeypatch.setattr(bands, "BAND", 32)
    products = [(i, 250.0 if i % 3 == 0 else 1.0 + i, "Acme", False, True) for i in range(900)]
    requests = [(1, 250.0, 250.0, None, False, False), (2, 249.0, None, "ACME", False, True), (3, 250.5, 260.0, None, False, False), (4, None, 251.0, None, False, False), (5, None, None, None, True, False)]
    assert found(spark, requests, products, 20) == brute(requests, products, 20)


def test_requests_that_ask_for_the_same_and_empty_tables(spark):
    products = some(50, 5)
    requests = [(i, 10.0, None, None, False, False) for i in range(30)]
    assert found(spark, requests, products, 3) == brute(requests, products, 3)
    assert found(spark, [], products, 3) == set() and found(spark, requests, [], 3) == set()
    assert found(spark, requests, [(1, None, "a", True, True)], 3) == set()


def test_no_plan_has_a_nested_loop(spark, monkeypatch):
    plans, keep = [], bands.kept
    monkeypatch.setattr(bands, "kept", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    found(spark, wishes(20, 1), some(100, 2), 5)
    assert plans and not any("NestedLoop" in p or "Cartesian" in p for p in plans)
