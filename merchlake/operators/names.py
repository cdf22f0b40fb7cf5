"""An index of texts by their grams: products that hold a name are found by equi-joins, from the preferred ones on.

Every run of up to three characters of a text is a gram, with the products that have it as its postings. What holds a
name has all of the name's grams, so its rarest one tells the candidates, and a look at the texts tells which of these
hold the name; a name shorter than three is itself a gram, and all its postings hold it. Postings are kept in levels: what
stands in a lower level is preferred to what stands in a higher one, so a name that is found needs no further level, and
a name that many products hold costs no more than the first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchlake.functions import text as T
from merchlake.sources.scratch import kept, spread

c = F.col
GRAM = 3
#: Products in the first level, about, and how many times as many there are with each further one.
FIRST, GROWTH = 16_384, 16
#: Steps that a power of two is cut into where values are counted to find the bounds of levels.
BINS = 256
#: Stages of name resolution in order: for look-ups of one product, and for comparisons.
STAGES = {"lookup": ["slug", "slug_part", "tokens", "name_part"], "compare": ["slug", "brand", "name_part", "slug_part", "tokens"]}


def grams(text: Column) -> Column:
    """The different runs of one to GRAM characters of a text."""
    return F.array_distinct(F.concat(*[_runs(text, n) for n in range(1, GRAM + 1)]))


def _runs(text: Column, n: int) -> Column:
    """Every run of n characters, one from each place; one walk over the text, as a look-ahead takes nothing away."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def probes(needle: Column) -> Column:
    """The grams to look for a text by: all of GRAM characters, or the text itself if it is shorter."""
    return F.when(F.length(needle) < GRAM, F.array(needle)).otherwise(F.array_distinct(_runs(needle, GRAM)))


def with_level(rows: DataFrame, column: str, falling: bool = True) -> DataFrame:
    """`rows` with their level: about FIRST rows of the greatest (or least) values are in level 0, GROWTH times as many up to and with the next, and so on.

    Equal values share a level, and nulls are in the last one. Bounds come from counts by how far values are from the
    preferred end, in BINS steps for each power of two: a few thousand counts, however many rows there are.
    """
    value = c(column).cast("double")
    end = rows.agg((F.max(value) if falling else F.min(value)).alias("end"), F.count("*").alias("n")).first()
    if end["n"] <= FIRST or end["end"] is None:
        return rows.withColumn("level", F.lit(0))
    step = F.floor(F.log2(F.abs(value - F.lit(end["end"])) + 1) * BINS)
    counts = sorted((r["step"], r["count"]) for r in rows.where(value.isNotNull()).groupBy(step.alias("step")).count().collect())
    bounds, most, n = [], FIRST, 0
    for reached, count in counts:
        n += count
        if n >= most:
            bounds.append(reached)
        while n >= most:
            most *= GROWTH
    return rows.withColumn("level", T.ladder([(step <= b, i) for i, b in enumerate(bounds)], len(bounds)) if bounds else F.lit(0))


def build(rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Postings (gram, level, id, and what else `rows` has) of rows (id, text, level, ...); with `wanted`, a table of grams, those only."""
    out = rows.withColumn("gram", F.explode(grams(c("text")))).drop("text")
    return out if wanted is None else out.join(wanted.select("gram").distinct(), "gram", "left_semi")


def write(postings: DataFrame, path: str) -> None:
    """Writes postings in a folder for each level, in order of grams, so that a look-up reads a level's files where its grams are."""
    postings.repartitionByRange("level", "gram").sortWithinPartitions("level", "gram").write.mode("overwrite").partitionBy("level").parquet(path)


def rarest(needles: DataFrame, keys: list[str], counts: DataFrame) -> DataFrame:
    """(keys, needle, gram): the gram of each needle that fewest texts have. Needles with a gram that none has are not in the result."""
    each = needles.select(*keys, "needle", F.explode(probes(c("needle"))).alias("gram")).join(counts, "gram", "left")
    found = each.groupBy(*keys, "needle").agg(F.min(F.struct("n", "gram")).alias("least"), F.bool_or(c("n").isNull()).alias("none"))
    return found.where(~c("none")).select(*keys, "needle", "least.gram")


def products(phones: DataFrame) -> DataFrame:
    """What name resolution reads of a catalog: id, lower-case brand and name, slug, price, and the price's level.

    A catalog in few files is dealt to all cores, so slugs, and the grams made of what is kept of this, are not one task's work.
    """
    rows = spread(phones).select("id", F.lower("brand").alias("brand"), F.lower("name").alias("p_name"), T.slugify(c("name")).alias("ps"), "price_min")
    return with_level(rows, "price_min")


def prepared(names: DataFrame) -> DataFrame:
    """(name, ns, head, words) of different names that are not blank: slug, first word, and slugs of the others of two letters or more."""
    n = names.select(F.trim("name").alias("name")).distinct().withColumn("ns", T.slugify(c("name"))).where("ns != ''")
    tail = T.slugify(F.regexp_replace("name", r"^\S+\s*", ""))
    words = F.when(F.contains("name", F.lit(" ")), F.filter(F.split(tail, "-"), lambda w: F.length(w) > 1)).otherwise(F.array().cast("array<string>"))
    return n.select("name", "ns", F.lower(F.split("name", " ")[0]).alias("head"), F.array_distinct(words).alias("words"), words.alias("all_words"))


def resolve(names: DataFrame, phones: DataFrame, order: str = "lookup", index: dict[str, DataFrame] | None = None) -> DataFrame:
    """(name_id, name, id, stage): the product that each name means, by the first stage (from 1) that finds one.

    Stages are those of STAGES: an equal slug; a brand of that name; a product's name that contains it; a slug that
    contains the name's; or products of the brand that the first word tells, by how many of the other words (of two
    letters or more) are in the slug. In a stage the dearest product wins, then the least id. Blank names find nothing.

    Every stage is an equi-join, and each different name is looked up once. Without a written `index` (see `write_index`)
    postings are made of the names' own grams only. A name that contains another has the other's slug within its own, so
    one set of candidates does for both kinds of containment, and a stage after `slug_part` that asks for names adds nothing.
    """
    stages = {kind: i + 1 for i, kind in enumerate(STAGES[order])}
    asked = names.select("name_id", F.trim("name").alias("name"))
    n = kept(prepared(names))
    if index is None:
        p = kept(products(phones))
        wanted = n.select(F.explode(F.flatten(F.transform(F.concat(F.array("ns"), "words"), probes))).alias("gram"))
        postings = kept(build(p.select("id", c("ps").alias("text"), "level", "brand"), wanted))
        index = {"products": p, "postings": postings, "counts": postings.groupBy("gram").agg(F.count("*").alias("n"))}
    p, postings, counts = index["products"], index["postings"], kept(index["counts"])
    dearest = F.min(F.struct(c("price_min").isNull().alias("no_price"), (-c("price_min")).alias("price"), "id"))
    by_slug = p.groupBy(c("ps").alias("ns")).agg(dearest.alias("best"))
    found = [n.join(by_slug, "ns").select("name", c("best.id").alias("id"), F.lit(stages["slug"]).alias("stage"))]
    if "brand" in stages:
        by_brand = p.groupBy("brand").agg(dearest.alias("best"))
        found.append(n.withColumn("brand", F.lower("name")).join(by_brand, "brand").select("name", c("best.id").alias("id"), F.lit(stages["brand"]).alias("stage")))
    found = [kept(_first(found))]

    left = kept(n.join(found[0].select("name"), "name", "left_anti"))
    levels = sorted(r["level"] for r in postings.select("level").distinct().collect())  # a few, by FIRST and GROWTH
    # a catalog of like names is small as a file and large in memory: it is never sent to the driver to be broadcast
    texts = p.select("id", "p_name", "ps", "price_min").hint("merge")
    probe = kept(rarest(left.select("name", c("ns").alias("needle")), ["name"], counts))
    part_stage = F.when(F.contains("p_name", F.lower("name")), min(stages["name_part"], stages["slug_part"])).when(F.contains("ps", c("needle")), stages["slug_part"])
    parts = _by_levels(probe, postings, texts, levels, ["gram"], part_stage, F.lit(0), min(stages["name_part"], stages["slug_part"]), F.lit(0))
    if parts is not None:
        found.append(parts)
        left = kept(left.join(parts.select("name"), "name", "left_anti"))
    words = left.where(F.size("words") > 0).select("name", c("head").alias("brand"), "all_words", F.explode("words").alias("needle"))
    probe = kept(rarest(words, ["name", "brand", "all_words"], counts).select("name", "brand", "all_words", "gram").distinct())
    hits = F.size(F.filter("all_words", lambda w: F.contains(c("ps"), w)))
    tokens = _by_levels(probe, postings, texts, levels, ["gram", "brand"], F.when(hits > 0, stages["tokens"]), hits, stages["tokens"], F.size("all_words"))
    if tokens is not None:
        found.append(tokens)
    return asked.join(_first(found), "name").select("name_id", "name", "id", "stage")


def _first(found: Iterable[DataFrame]) -> DataFrame:
    """(name, id, stage): of what was found for a name, that of the first stage; a stage has one of each name."""
    every = None
    for df in found:
        every = df if every is None else every.unionByName(df)
    return every.groupBy("name").agg(F.min(F.struct("stage", "id")).alias("b")).select("name", "b.id", "b.stage")


def _by_levels(probe: DataFrame, postings: DataFrame, texts: DataFrame, levels: list[int], on: list[str], stage: Column, hits: Column, best_stage: int, most_hits: Column) -> DataFrame | None:
    """(name, id, stage): for each name of `probe` the best product by stage, hits, price and id, level after level.

    A name is through when what it has found is of the best stage with the most hits there can be: later levels are cheaper.
    """
    best = None
    for i, n in enumerate(levels):
        met = probe.join(postings.where(c("level") == n).select("id", *on), on).drop("gram").dropDuplicates(["name", "id"]).join(texts, "id")
        rows = met.withColumns({"stage": stage, "hits": hits, "full": hits >= most_hits}).where(c("stage").isNotNull())
        rows = rows.select("name", F.struct("stage", (-c("hits")).alias("hits"), c("price_min").isNull().alias("no_price"), (-c("price_min")).alias("price"), "id").alias("b"), (c("full") & (c("stage") == best_stage)).alias("full"))
        rows = rows if best is None else rows.unionByName(best)
        best = kept(rows.groupBy("name").agg(F.min("b").alias("b"), F.bool_or("full").alias("full")))
        if i + 1 < len(levels):
            probe = kept(probe.join(best.where("full").select("name"), "name", "left_anti"))
            if probe.isEmpty():
                break
    return None if best is None else best.select("name", "b.id", "b.stage")


def write_index(phones: DataFrame, root: str) -> None:
    """Writes all that `resolve` reads of a catalog under `root`."""
    p = kept(products(phones))
    p.write.mode("overwrite").parquet(f"{root}/products")
    write(build(p.select("id", c("ps").alias("text"), "level", "brand")), f"{root}/postings")
    load_index(p.sparkSession, root, counted=False)["postings"].groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/counts")


def load_index(spark: SparkSession, root: str, counted: bool = True) -> dict[str, DataFrame]:
    p = spark.read.parquet(f"{root}/products")
    postings = spark.read.schema(f"id {p.schema['id'].dataType.simpleString()}, brand string, gram string, level int").parquet(f"{root}/postings")
    return {"products": p, "postings": postings} | ({"counts": spark.read.parquet(f"{root}/counts")} if counted else {})


def holding(rows: DataFrame, requests: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, rank, id): for each request (query_id, text) the first `most` rows by id whose text holds it; rank from 1.

    `rows` has id and text. Whatever the case; white space around a request goes, and a blank one, which all rows hold,
    gets the first of all. Levels are by id here, the least first, so a request ends with the level that fills it.
    """
    text = kept(rows.select("id", F.lower("text").alias("text")).where("text is not null"))
    n = kept(requests.select("query_id", F.lower(F.trim("text")).alias("needle")).where("needle is not null"))
    of = kept(n.where("needle != ''").select("needle").distinct())
    wanted = of.select(F.explode(probes(c("needle"))).alias("gram"))
    postings = kept(build(with_level(text, "id", falling=False).select("id", "text", "level"), wanted))
    probe = kept(rarest(of, [], postings.groupBy("gram").agg(F.count("*").alias("n"))))
    levels = sorted(r["level"] for r in postings.select("level").distinct().collect())
    first = Window.partitionBy("needle").orderBy("id")
    got = None
    for i, k in enumerate(levels):
        met = probe.join(postings.where(c("level") == k).select("id", "gram"), "gram").join(text, "id").where(F.contains("text", c("needle"))).select("needle", "id")
        met = met if got is None else met.unionByName(got.drop("rank"))
        got = kept(met.withColumn("rank", F.row_number().over(first)).where(c("rank") <= most))
        if i + 1 < len(levels):
            probe = kept(probe.join(got.where(c("rank") == most).select("needle"), "needle", "left_anti"))
            if probe.isEmpty():
                break
    blank = text.select("id").orderBy("id").limit(most).withColumn("rank", F.row_number().over(Window.orderBy("id"))).withColumn("needle", F.lit(""))
    got = blank.select("needle", "id", "rank") if got is None else got.unionByName(blank.select("needle", "id", "rank"))
    return n.join(got, "needle").select("query_id", "rank", "id")
