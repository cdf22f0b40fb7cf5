"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlake.llm import op1_language_id as language
from merchlake.llm import op9_secrets as secrets
from merchlake.llm import op10_toxicity as toxicity
from merchlake.llm.common import crc_mod
from merchlake.llm.op2_substrings import remove_repeats
from merchlake.llm.op3_paragraphs import repeated_paragraphs
from merchlake.llm.op4_packing import pack
from merchlake.llm.op5_mixing import mix
from merchlake.llm.op6_neighbours import nearest
from merchlake.llm.op7_search import search
from merchlake.llm.op8_simhash import near_duplicates
from merchlake.llm.op11_spelling import count_words, group_variants
from merchlake.llm.op12_whitening import whiten
from merchlake.llm.op13_quality import judge


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    dictionaries = language.learn(docs.where(~held_out))
    found = language.identify(docs, dictionaries)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = secrets.find(docs, secrets.learn(secrets.samples(docs)))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    digest = F.sha2(secrets.written(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), digest.alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_docs(spark, sf_dir)).drop("kept")


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(_docs(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out).select("doc_id", "toxic")
    # one label a document: a document that is labelled both ways teaches nothing
    labels = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    model = toxicity.learn(docs, labels)
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_docs(spark, sf_dir), F.col("doc_id") % 100 == 0, 10)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(_docs(spark, sf_dir), drop_one_in=199).where("n >= 5"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 8)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_docs(spark, sf_dir))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM s
), r AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM w
), o AS (
  SELECT *, coalesce(sum(cap) OVER b, 0.0::DOUBLE) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left, sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM r WINDOW b AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (budget - cap_before) / w_left::DOUBLE AS level FROM o
), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, ratio) FROM l WHERE level < ratio) * w), cap) AS target FROM l
), f AS (
  SELECT d.doc_id, d.source, d.size, d.key, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT f.*, n, CASE WHEN target > 0 THEN (upto + n * source_size)::DOUBLE / target ELSE 0.0 END AS finish, md5(concat_ws(':', coalesce(source, ''), key, size::VARCHAR, n::VARCHAR)) AS tie
  FROM f, (VALUES (0), (1)) AS passes(n)
), g AS (
  SELECT *, sum(size) OVER (ORDER BY finish, tie) AS total, (SELECT sum(source_size) * 1.5::DOUBLE FROM s) AS budget FROM p
)
SELECT doc_id, size, source_size, target, (sum(CASE WHEN total <= budget THEN size ELSE 0 END))::BIGINT AS taken
FROM g GROUP BY doc_id, source, key, size, source_size, target
"""

_S13 = r"[\x20\x09-\x0D]"
OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), s AS (
  SELECT row, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5
), g AS (
  SELECT row, i, array_to_string(w[i:i + 4], ' ') AS v FROM s
), p AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, v) AS n FROM g) WHERE n > 1
), r AS (
  SELECT row, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS nxt FROM p) GROUP BY row
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, (length(t) - length(regexp_replace(t, '{_S13}', '', 'g')))::BIGINT AS spaces, length(t)::BIGINT AS chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}'))) AS n_bare_words,
    length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_capitals, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}]\x20'))) AS n_bullets
  FROM d LEFT JOIN r USING (row)
), b AS (
  SELECT *, chars - spaces AS word_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_bare_words > 3 * n_words
    OR 2 * n_capitals > n_letters OR 10 * n_bullets > 9 * n_lines) AS kept
FROM b
"""

QUERIES = {"op1_language_id": op1_language_id, "op2_substrings": op2_substrings, "op3_paragraphs": op3_paragraphs, "op4_packing": op4_packing, "op5_mixing": op5_mixing, "op6_neighbours": op6_neighbours, "op7_search": op7_search, "op8_simhash": op8_simhash, "op9_secrets": op9_secrets, "op10_toxicity": op10_toxicity, "op11_spelling": op11_spelling, "op12_whitening": op12_whitening, "op13_quality": op13_quality}
ORACLE_SQL = {"op5_mixing": OP5_SQL, "op13_quality": OP13_SQL}
