"""From raw documents to packed training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchlake.llm import op1_language_id as language
from merchlake.llm import op9_secrets as secrets
from merchlake.llm.common import Scratch, fresh, small_batches
from merchlake.llm.op4_packing import pack
from merchlake.llm.op5_mixing import mix
from merchlake.llm.op8_simhash import near_duplicates

#: SQL for the rows of `run`: none, as SQL has neither the compressor nor the tokenizer.
ORACLE_SQL = None


def _identity(docs: DataFrame) -> Column:
    """A hash of all of a row; rows that agree in everything share it."""
    return F.xxhash64(*[F.col(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letters, or no dictionary clearly better than the next.

    Dictionaries are learned from the rows that have a lang. Where none has, nothing is known and all rows stay.
    """
    dictionaries = language.learn(docs)
    if not dictionaries:
        return docs
    small_batches(spark)
    found = fresh(docs, "found")
    judged = docs.withColumn(found, language.language_of(F.col("text"), dictionaries))
    return judged.where(~F.col(found)["rejected"]).drop(found)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: one with the group's least doc_id."""
    found = near_duplicates(docs, identity=_identity(docs))
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("identity").alias("identity"))
    return _repeated(docs, stays.select("identity", F.lit(1).alias("times")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts, and counts n_chars again; no document goes."""
    # all columns go along as one, so none is mistaken for a result of the scan
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = secrets.find(rows, secrets.learn(secrets.samples(docs)), carry=("row",))
    clean = found.withColumn("clean", secrets.redact(F.col("row.text"), F.col("spans")))
    out = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("clean")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return clean.select(*[column.alias(c) for c, column in out.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings sources to their targets: a document stays out, stays once, or stands there twice."""
    taken = mix(docs, identity=_identity(docs)).where("taken > 0")
    times = taken.groupBy("identity").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("times"))
    return _repeated(docs, times, each=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _repeated(docs: DataFrame, times: DataFrame, each: bool = False) -> DataFrame:
    """`docs` with each row that `times` (identity, times) names, so many times; others go.

    Rows that agree in everything count as one, unless `each` is set: then each of them stands there so many times.
    """
    identity, number, times_name = (fresh(docs, n) for n in ("identity", "number", "times"))
    out = docs.withColumn(identity, _identity(docs)).join(times.toDF(identity, times_name), identity)
    if not each:
        twin = F.row_number().over(Window.partitionBy(identity).orderBy(identity))
        out = out.withColumn(number, twin).where(F.col(number) == 1)
    copies = F.explode(F.array_repeat(F.lit(True), F.col(times_name)))
    return (out.withColumn(number, copies) if each else out).select(*docs.columns)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of `sf_dir`; each stage's rows are written and reread before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
