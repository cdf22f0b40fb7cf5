"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlake.llm.common import small_batches

BITS = 20
#: Labelled documents that the model is fitted on, about; chosen by a hash of the id.
SAMPLE_ROWS = 12_000
#: Characters of all sampled texts together, at most.
SAMPLE_CHARS = 60_000_000
EPOCHS = 4
_WORD = re.compile(r"\w+")


class Features:
    """Hashed features of a text: its words, pairs of neighbours and pairs with one word skipped, each once."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.known: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        known, out = self.known, []
        if len(known) > 500_000:
            known.clear()
        for w in _WORD.findall(text.lower()):
            h = known.get(w)
            if h is None:
                b = w.encode("utf-8", "replace")
                h = known[w] = zlib.crc32(b) << 32 | zlib.adler32(b)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        h = self.words(text or "")
        parts = [self._spread(h)]
        for kind, gap in ((1, 1), (2, 2)):
            if len(h) > gap:
                parts.append(self._spread(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(kind)))
        return np.unique(np.concatenate(parts)).astype(np.int64)

    def _spread(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(29))) & self.mask


class Ftrl:
    """FTRL-proximal: a rate for each coordinate from its own past gradients; L1 keeps weights at exactly 0."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 20.0, l2: float = 0.1):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias = np.zeros(2)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias_weight(self) -> float:
        return -self.bias[0] / ((self.beta + np.sqrt(self.bias[1])) / self.alpha)

    def learn(self, at: np.ndarray, y: float, weight: float) -> None:
        w, b = self.weights(at), self.bias_weight()
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias += g - (np.sqrt(self.bias[1] + g * g) - np.sqrt(self.bias[1])) / self.alpha * b, g * g


def _fitting(sizes: list[tuple[int, int, int]], most: int) -> list[tuple[int, int]]:
    """(label, hash) of the sampled ids, given as (label, hash, characters), whose texts fit into `most` characters.

    Each class has half of `most`, and what the other one leaves. Ids are taken by rising hash; one whose texts do not
    fit is skipped and takes no room. If none of a class fits, its shortest is taken all the same.
    """
    of = {y: sorted((h, chars) for label, h, chars in sizes if label == y) for y in (0, 1)}
    need = {y: sum(chars for _, chars in ids) for y, ids in of.items()}
    out = []
    for y, ids in of.items():
        room, start = most - min(most // 2, need[1 - y]), len(out)
        for h, chars in ids:
            if chars <= room:
                room -= chars
                out.append((y, h))
        if ids and len(out) == start:
            out.append((y, min(ids, key=lambda i: (i[1], i[0]))[0]))
    return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, bias) of the features that the fit leaves above 0; few enough to be sent with tasks.

    Fitted on a sample of about `sample_rows` labelled rows, chosen by a hash of the id, with both classes equally many
    where there are enough of them; the rarer class of the sample weighs more, by the power 0.7 of its rarity. Only
    the ids and labels of the sample, which that bounds, are broadcast to find its texts. Where these have more than
    `sample_chars` characters, `_fitting` chooses among them. Rows whose label is not 0 or 1, whose id is null, or whose text is
    null, teach nothing. If a class is missing, every document gets the label of the other one; without any labels
    every score is 0.5.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return np.zeros(0, np.int64), np.zeros(0), {0: -10.0, 1: 10.0}.get(next(iter(counts), -1), 0.0)
    rate = {y: min(1.0, sample_rows / 2 / n) for y, n in counts.items()}
    top = 1 << 53
    picked = known.withColumn("h", F.pmod(F.xxhash64("id", F.lit(10)), F.lit(top))).where(F.col("h") / float(top) < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("h", "y", "text")
    sizes = [tuple(r) for r in texts.groupBy("y", "h").agg(F.sum(F.length("text").cast("long")).alias("chars")).collect()]
    if sum(chars for _, _, chars in sizes) > sample_chars:
        taken = docs.sparkSession.createDataFrame(_fitting(sizes, sample_chars), "y int, h long")
        texts = texts.join(F.broadcast(taken), ["y", "h"])
    feats, examples = Features(), []
    for r in texts.select("h", "y", "text").toLocalIterator():
        examples.append((r["h"], r["y"], feats.of(r["text"])))
    examples.sort(key=lambda e: (e[0], e[1], len(e[2])))
    n = [max(1, sum(y == k for _, y, _ in examples)) for k in (0, 1)]
    model = Ftrl()
    for epoch in range(epochs):
        order = np.random.default_rng(epoch).permutation(len(examples))
        for i in order:
            _, y, at = examples[i]
            model.learn(at, y, min(5.0, (len(examples) / 2 / n[y]) ** 0.7))
    every = np.arange(len(model.z))
    w = model.weights(every)
    keep = np.flatnonzero(w)
    return keep, w[keep], float(model.bias_weight())


def toxic_score(text: Column, model: tuple[np.ndarray, np.ndarray, float]) -> Column:
    """The score column of a text column; see `score`."""

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, weights, bias = model
        w, feats = np.zeros(1 << BITS), Features()
        w[at] = weights
        for texts in batches:
            yield pd.Series([1 / (1 + np.exp(-np.clip(w[feats.of(t)].sum() + bias, -35, 35))) for t in texts], dtype="float64")

    return predict(text)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic) and predicted (1 from 0.5) for each row of `docs`.

    Whole texts count; each feature counts once a document. Null and empty texts get the score of the bias alone. Null
    and repeated ids are kept as they are; other columns play no part; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), toxic_score(F.col(text_col), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
