"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlake.llm.common import Scratch

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in a range of finish times and in a group of a source's shuffled order, about; so both grow in number with the table.
RANGE_ROWS, GROUP_ROWS = 4_096, 4_096


def word_count(text: Column) -> Column:
    """Words of a text, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take `weights` in turn. The total is `share` of all sizes; a target stops at
    `most` times its source's size and the excess is shared again by weight until none is above. That is one level
    L with target = min(L * weight, cap): sorted by cap / weight, the first k sources are capped, and sums over the
    sorted sources give L for every k. One row per source is all that this sorts.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", pick.alias("w"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        "budget": F.sum("source_size").over(every) * F.lit(float(share)),
    })
    s = s.withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("w_left"))
    # the first source in this order that its level does not fill sets the level for itself and all after it
    s = s.withColumn("open_level", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(every).getField("level"))
    s = s.withColumn("target", F.when(F.col("open_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("open_level") * F.col("w"))))
    return s.select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", identity: Column | None = None) -> DataFrame:
    """How many words of each document a mixture of the sources takes.

    A document's size is its number of words. Within each source, documents stand in a shuffled order (by the md5 of
    the id, then id and size); where the target is above the source's size the order is gone through again. Each pass
    of a document has a virtual finish time, the cumulative words of its source up to and with it divided by the
    source's target. All are sorted by finish time and taken while the running total stays within the total budget.

    Sums are two-level: words per (source, group of the order) and per range of finish times come first, a running sum
    within a group or range after. So no window holds a whole source, and only the range of finish times in which the
    budget ends is sorted out row by row; ranges before it are taken whole.

    Returns one row for each row of `docs`: doc_id, source, size, source_size, target, taken (and `identity`, if given,
    a column over `docs` that a caller can join on). Null texts and texts without a word have size 0 and take 0. A null
    source is a source of its own. A null id is an id like any other. Rows that agree in source, id and size are alike
    and are taken alike. An empty table gives an empty result. Other columns of `docs` play no part, whatever their
    names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    extra = [] if identity is None else [identity.alias("identity")]
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *extra)
    d = d.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    d = scratch.keep(d)
    n = d.count()
    digits = min(12, 3 + max(0, math.ceil(math.log(max(1, n / GROUP_ROWS / 4096), 16))))
    ranges = max(2048, -(-n // RANGE_ROWS))
    d = d.withColumn("grp", F.conv(F.substring("key", 1, digits), 16, 10).cast("long"))

    words = scratch.keep(d.groupBy("source", "grp").agg(F.sum("size").alias("words")))
    before = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    starts = words.select(F.col("source").alias("s1"), F.col("grp").alias("g1"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    aim = scratch.keep(targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most))
    starts = starts.join(aim.withColumnRenamed("source", "s2"), F.col("s1").eqNullSafe(F.col("s2"))).drop("s2")
    within = Window.partitionBy("source", "grp").orderBy("key", "doc_id", "size")
    d = d.withColumn("inside", F.sum("size").over(within))
    d = d.join(starts, F.col("source").eqNullSafe(F.col("s1")) & (F.col("grp") == F.col("g1"))).drop("s1", "g1")

    passes = [F.struct(finish.alias("finish"), F.least(F.floor(finish * F.lit(float(ranges))), F.lit(8 * ranges)).alias("range"), tie.alias("tie")) for finish, tie in (_pass(n) for n in range(math.ceil(most)))]
    d = scratch.keep(d.select("doc_id", "source", "size", "source_size", "target", *(["identity"] if extra else []), F.array(*passes).alias("passes")))

    each = d.where("size > 0").select("size", F.explode("passes").alias("p")).select("size", "p.*")
    running = each.groupBy("range").agg(F.sum("size").alias("words")).select("range", "words", F.sum("words").over(Window.orderBy("range")).alias("upto"))
    budget = words.agg(F.sum("words")).first()[0] or 0
    budget = budget * float(share)
    end = running.where(F.col("upto") > budget).orderBy("range").first()
    if end is None:
        cut_range, cut_finish, cut_tie = 8 * ranges + 1, 0.0, ""
    else:
        last = each.where(F.col("range") == end["range"]).select("finish", "tie", F.sum("size").over(Window.partitionBy("range").orderBy("finish", "tie")).alias("upto"))
        cut = last.where(F.col("upto") + (end["upto"] - end["words"]) <= budget).orderBy(F.desc("finish"), F.desc("tie")).first()
        cut_range, cut_finish, cut_tie = end["range"], *((cut["finish"], cut["tie"]) if cut else (-1.0, ""))
    is_in = lambda p: (p["range"] < cut_range) | ((p["range"] == cut_range) & ((p["finish"] < cut_finish) | ((p["finish"] == cut_finish) & (p["tie"] <= cut_tie))))
    taken = (F.size(F.filter("passes", is_in)) * F.col("size")).cast("long")
    return d.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *(["identity"] if extra else []))


def _pass(n: int) -> tuple[Column, Column]:
    """Finish time and tie-break of a document's pass number n."""
    finish = F.when(F.col("target") > 0, (F.col("start") + F.col("inside") + n * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    return finish, F.md5(F.concat_ws(":", F.coalesce("source", F.lit("")), "key", F.col("size").cast("string"), F.lit(str(n))).cast("binary"))
