"""Spelling variant grouping: words one code point apart, by groups around what two of them share; no pair is ever made.

Words that differ by one replaced code point share one group: a position, what stands before it and what stands after.
A group keeps its size and its two leading words, so every member knows how many others there are and which leads them.
Words that differ by one inserted code point meet where the longer one, with that code point left out, is the shorter one:
what is left out of words joins the vocabulary. Both are keys of one kind, a hash of the sequence of code points (with a
zero for the replaced one), made for all positions of a word in one walk over it. So a row has a fixed size however long
its word is, and a group never has more rows than there are code points (times places to put one), whatever the corpus.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.llm.common import Scratch, small_batches

#: Different words that a task counts before it hands them on, and rows of groups that it hands on at once.
COUNTED, ROWS = 400_000, 100_000
_PRIME = (1 << 127) - 1
_BASE = int.from_bytes(hashlib.sha256(b"spelling variants").digest()[:15], "little")
_SELF, _REPLACED, _LEFT_OUT = 0, 1, 2
_KEYS = "k1 long, k2 long, kind byte, n long, side byte, place int, c int, w1 long, w2 long, word string"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, drop_one_in: int | None = None) -> DataFrame:
    """(word, n): how often each word of `least_length` code points or more occurs.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case and all else as it is. With
    `drop_one_in`, a run whose unsigned crc32 of `<id>:<word>` is a multiple of it loses its code point number crc32 modulo
    length first (a null id is written as nothing). Null texts have no words; repeated rows count each time. Words are
    counted within tasks, in tables of bounded size, before they are shuffled, so no frequent word is a hot key.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(_counter(least_length, drop_one_in), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counter(least: int, drop_one_in: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def batch(seen: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for rows in batches:
            for doc, text in zip(rows["id"], rows["text"], strict=True):
                # lower() of bytes changes A-Z alone
                own = Counter(runs.findall(text.as_py().lower().decode("utf-8", "replace")))
                if drop_one_in:
                    start = zlib.crc32(f"{doc.as_py()}:".encode())
                    for word, n in own.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % drop_one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        seen[word] += n
                else:
                    seen.update(own)
                if len(seen) >= COUNTED:
                    yield batch(seen)
                    seen = Counter()
        if seen:
            yield batch(seen)

    return count


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word its own row, one for each position (that one replaced) and one for each different word that is left if one code point goes.

    `side` and `place` put the words that a left-out code point makes longer in their order: of two such words the one
    whose own code point is the less comes first, and among those the one that has it earlier.
    """
    powers = [1]
    keys, cols, words = [], [], []

    def out() -> pa.RecordBatch:
        k = np.frombuffer(b"".join(x.to_bytes(16, "little") for x in keys), "<i8").reshape(-1, 2)
        a = np.array(cols, np.int64).reshape(-1, 7)
        columns = [k[:, 0], k[:, 1], a[:, 0].astype(np.int8), a[:, 1], a[:, 2].astype(np.int8), a[:, 3].astype(np.int32), a[:, 4].astype(np.int32), a[:, 5], a[:, 6]]
        return pa.record_batch([pa.array(x) for x in columns] + [pa.array(words, pa.string())], [x.split()[0] for x in _KEYS.split(", ")])

    for rows in batches:
        for word, n in zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True):
            codes = [ord(x) for x in word]
            length = len(codes)
            while len(powers) <= length:
                powers.append(powers[-1] * _BASE % _PRIME)
            after, rest = [0] * (length + 1), 0
            for i in range(length - 1, -1, -1):
                rest = (rest + codes[i] * powers[length - 1 - i]) % _PRIME
                after[i] = rest
            whole = (powers[length] + rest) % _PRIME
            w1, w2 = np.frombuffer(whole.to_bytes(16, "little"), "<i8").tolist()
            keys.append(whole)
            cols.append((_SELF, n, 0, 0, 0, w1, w2))
            words.append(word)
            before = 1
            for i, code in enumerate(codes):
                power = powers[length - 1 - i]
                keys.append((whole - code * power) % _PRIME)
                cols.append((_REPLACED, n, 0, i, code, w1, w2))
                words.append(None)
                follows = codes[i + 1] if i + 1 < length else -1
                if code != follows:  # of a run of one code point, the last stands for all
                    less = code < follows
                    keys.append((before * power + after[i + 1]) % _PRIME)
                    cols.append((_LEFT_OUT, n, 0 if less else 1, i if less else -i, code, w1, w2))
                    words.append(None)
                before = (before * _BASE + code) % _PRIME
                if len(keys) >= ROWS:
                    yield out()
                    keys, cols, words = [], [], []
    if keys:
        yield out()


def _near(words: DataFrame) -> DataFrame:
    """(word, n, n_near, replaced, shorter, longer): how many words are near, and of each kind the one to prefer.

    Such a one is (minus its count, side, place, code point): the order is that of counts, then that of the words, which for
    words that differ from one word at one place is told by that place and what stands there.
    """
    rows = words.select("word", "n").mapInArrow(_keys, _KEYS)
    group = Window.partitionBy("k1", "k2").orderBy("kind", F.desc("n"), "side", "place", "c").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = F.struct("kind", "n", "side", "place", "c")
    rows = rows.withColumns({"size": F.count(F.lit(1)).over(group), "first": F.first(lead).over(group), "second": F.nth_value(lead, 2).over(group)})
    c, kind = F.col, F.col("kind")
    choice = lambda n, less, place, code: F.struct((-n).alias("n"), F.when(less, 0).otherwise(1).alias("side"), F.when(less, place).otherwise(-place).alias("place"), code.alias("c"))
    other = F.when(c("first.c") == c("c"), c("second")).otherwise(c("first"))
    replaced = F.when((kind == _REPLACED) & (c("size") > 1), choice(other["n"], other["c"] < c("c"), c("place"), other["c"]))
    # the word that is left is less than the longer one just where the code point left out is not less than the next
    shorter = F.when((kind == _LEFT_OUT) & (c("first.kind") == _SELF), choice(c("first.n"), c("side") == 1, F.abs("place"), c("c")))
    longer = F.when((kind == _SELF) & (c("size") > 1), F.struct((-c("second.n")).alias("n"), c("second.side").cast("int").alias("side"), c("second.place").alias("place"), c("second.c").alias("c")))
    rows = rows.select("w1", "w2", "word", F.when(kind == _SELF, c("n")).alias("n"), F.when(kind == _LEFT_OUT, 1).otherwise(c("size") - 1).alias("near"), kind.alias("kind"), replaced.alias("replaced"), shorter.alias("shorter"), longer.alias("longer"))
    rows = rows.where((kind == _SELF) | c("replaced").isNotNull() | c("shorter").isNotNull())
    return rows.groupBy("w1", "w2").agg(F.max("word").alias("word"), F.max("n").alias("n"), F.sum("near").alias("n_near"), *[F.min(x).alias(x) for x in ("replaced", "shorter", "longer")])


def _made(best: Column) -> Column:
    """The word with the count of each kind's choice, as an array of structs (minus count, word); the least is the best."""
    word = F.col("word")
    upto = lambda x: F.substring(word, F.lit(1), F.abs(x["place"]))
    since = lambda x, skip: F.substring(word, F.abs(x["place"]) + 1 + skip, F.length(word))
    char = lambda x: F.decode(F.unhex(F.lpad(F.hex(x["c"].cast("long")), 8, "0")), "UTF-32")
    r, s, l = (F.col(x) for x in ("replaced", "shorter", "longer"))
    forms = [(r, F.concat(upto(r), char(r), since(r, 1))), (s, F.concat(upto(s), since(s, 1))), (l, F.concat(upto(l), char(l), since(l, 0)))]
    return F.array_min(F.filter(F.array(*[F.when(x.isNotNull(), F.struct(x["n"].alias("n"), form.alias("word"))) for x, form in forms]), lambda x: x.isNotNull()))


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for different words with their counts (word, n).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near
    word of largest n, ties to the smallest in code-point order, if that n is at least `ratio` times its own; root is the
    end of the chain of forms, which cannot run in circles as counts rise by `ratio` each time. A word that is near to none
    has n_near 0 and is its own root. Empty, and very long, words are words like others; an empty table gives an empty one.
    Keys are 127-bit hashes; what depends on them holds but for collisions.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    small_batches(words.sparkSession)
    scratch = Scratch(words.sparkSession, "spelling")
    best = _near(words).withColumn("best", _made(F.col("replaced")))
    big = -F.col("best.n") >= ratio * F.col("n")
    found = scratch.keep(best.select("word", F.when(big, F.col("best.word")).alias("form"), "n", "n_near", F.when(big, -F.col("best.n")).alias("form_n")))
    roots = scratch.keep(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        hop = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.keep(roots.join(hop, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        scratch.drop(roots)
        roots = moved
        if moved.where("on").isEmpty():
            break
    return found.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
