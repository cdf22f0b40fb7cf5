"""Texts as visitors and sites write them, made from rows of the catalog: one for each product, from templates.

Like the columns of `catalog`, they are plain SQL that Spark and DuckDB both read, so a query and its oracle start from the
same rows, and there are as many of them as there are products.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from merchlake.sources.catalog import PHONE_COLUMNS, table
from merchlake.sources.scratch import kept, spread

#: What stands for {name} in a template; numbers follow the product's key.
PLACES = {
    "id": "p_partkey", "name": "p_name", "brand": PHONE_COLUMNS["brand"], "k": "10 + p_partkey % 60", "n": "5000 + p_partkey % 90 * 500", "m": "52000 + p_partkey % 70 * 500",
    "year": "2015 + p_partkey % 11", "gb": "4 + p_partkey % 13", "mah": "3000 + p_partkey % 40 * 100", "inch": "concat(5 + p_partkey % 3, '.', p_partkey % 10)", "size": "p_size", "type": "p_type",
}


def quoted(value: object) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower()


def picked(values: list, stride: int = 1) -> str:
    """SQL for the value that a product's key picks from a list; keys `stride` apart pick neighbours."""
    cases = " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values))
    return f"(CASE CAST(floor(p_partkey / {stride}) AS BIGINT) % {len(values)} {cases} END)"


def filled(templates: list, stride: int = 1) -> str:
    """SQL for a picked template with what the row says in its places."""
    out = picked(templates, stride)
    for name, value in PLACES.items():
        if any(t is not None and f"{{{name}}}" in t for t in templates):
            out = f"replace({out}, '{{{name}}}', CAST({value} AS STRING))"
    return out


def varied(texts: list[str], brands: list[str]) -> list[str]:
    """Templates from texts: amounts, thousands with a k, and brands are taken from the row."""
    out = [re.sub(r"\b\d{2}(?= ?k\b| thousand)", "{k}", re.sub(r"\b\d{5}\b", "{n}", t)) for t in texts]
    return [re.sub(rf"(?i)\b(?:{'|'.join(brands)})\b", "{brand}", t) for t in out]


def rows_sql(columns: dict[str, str]) -> str:
    """A query with one row for each product."""
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM part"


def rows(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    """Those rows, written once: what reads them does not make them again for every pattern that it looks for."""
    return kept(spread(table(spark, sf_dir, "part")).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()]))
