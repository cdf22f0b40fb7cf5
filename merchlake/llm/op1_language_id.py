"""Language identification by compression: per-language zstandard raw-content dictionaries, smallest encoding wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import small_batches

#: Characters of one sampled training excerpt, and of one block that is encoded.
EXCERPT = 1024
BLOCK = 8192
#: zstandard level for all texts; faster levels miss short matches, above all at the start of a text.
LEVEL = 12
#: Bytes of text that the dictionary of a language is made of, at most.
DICTIONARY_BYTES = 64 * 1024
#: Rejected if the best encoding saves less than this share of the second best.
MARGIN = 0.005


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary for each language of `labelled`.

    A dictionary is made of excerpts from anywhere in the texts. Which ones is settled by a hash, at a rate that gives
    about `dictionary_bytes` a language (the documented bound of the sample; what is above it is cut off), so neither
    large languages nor long texts shift it. Copies of a text count once. Rows without text or language teach nothing;
    no rows give no languages.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    parts = F.ceil(F.length("text") / F.lit(EXCERPT)).cast("int")
    texts = rows.select("lang", F.xxhash64("text").alias("text"), parts.alias("parts")).distinct()
    sizes = {r["lang"]: r["parts"] for r in texts.groupBy("lang").agg(F.sum("parts").alias("parts")).collect() if r["parts"]}
    if not sizes:
        return {}
    # excerpts may be shorter than EXCERPT at the end of a text: ask for half as many again, and cut
    rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.5 * dictionary_bytes / EXCERPT / n))])
    chance = lambda i: F.pmod(F.xxhash64("text", i), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = F.filter(F.sequence(F.lit(0), parts - 1), lambda i: chance(i) < F.element_at(rates, F.col("lang")))
    excerpts = F.transform(picked, lambda i: F.struct(chance(i).alias("at"), F.substring("text", i * EXCERPT + 1, F.lit(EXCERPT)).alias("part")))
    found: dict[str, list] = {}
    for r in rows.where(parts > 0).select("lang", F.explode(excerpts).alias("e")).select("lang", "e.*").distinct().collect():
        found.setdefault(r["lang"], []).append((r["at"], r["part"]))
    out = {}
    for lang in sorted(found):
        texts = dict.fromkeys(part for _, part in sorted(found[lang]))
        out[lang] = "\n".join(texts).lower().encode("utf-8", "replace")[:dictionary_bytes]
    return out


def _scorer(dictionaries: dict[str, bytes], margin: float):
    """text -> (language, score, whether rejected)."""

    by_lang = []
    for lang in sorted(dictionaries):
        d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        by_lang.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)))
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def score(text: str | None) -> tuple[str, float, bool]:
        if text is None or not dictionaries or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        text = text.lower()
        blocks = [text[i : i + BLOCK].encode("utf-8", "replace") for i in range(0, len(text), BLOCK)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in by_lang)
        second = sizes[1][0] if len(sizes) > 1 else max(sizes[0][0], sum(len(plain.compress(b)) for b in blocks))
        saved = 1 - sizes[0][0] / second
        return sizes[0][1], saved, saved < margin

    return score


def language_of(text: Column, dictionaries: dict[str, bytes], margin: float = MARGIN) -> Column:
    """A struct of lang_pred, score and rejected for a text column; see `identify`."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = _scorer(dictionaries, margin)
        for texts in batches:
            yield pd.DataFrame([score(t) for t in texts], columns=["lang_pred", "score", "rejected"]).astype({"score": "float64", "rejected": "bool"})

    return predict(text)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row of `docs`.

    Every text is put in lower case and encoded whole, in blocks, once with each language's dictionary; the language with the smallest sum
    is predicted (ties: the first by name). The score is the share of bytes saved against the second best (with one
    language, against no dictionary). A row is rejected if the score is below `margin`.
    A null text, one without a letter, and any text if nothing was learned, get `und`, score 0, and are rejected. Null
    and repeated ids are kept as they are; other columns play no part; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), language_of(F.col(text_col), dictionaries, margin).alias("found"))
    return found.select("doc_id", "found.*")
