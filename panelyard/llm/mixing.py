"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a digest of identifier and text and laid end to
end; the stream of words is cut into blocks of ``BLOCK`` words and runs at most twice. Slot j of
the schedule takes the golden-ratio point frac((j + 1/2) phi), the point falls
into one source's share of the line of cumulative weights, and the slot's rank within its source is
the block it reads. Slots beyond a source's need drop out, and blocks that got no slot follow
at the end, so each source gives exactly its rounded target.

A source may hold a third of all rows: running sums go through digest-prefix buckets,
and slots are ranked in chunks, so no window holds a whole source.

Defined results: a null text has size 0 and is never taken; a null source is a source,
last in order; targets of empty tables and of sources without words are 0; repeated
rows are documents of their own; reruns agree, whatever the partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.quality import BLANKS
from panelyard.llm.shared import GAPS, documents
from panelyard.sources.store import materialise

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, REPEATS = 1.5, 2.0
BLOCK = 1024               # words a slot reads
GOLDEN = 0.6180339887498949
CELLS = 1024               # of the line of cumulative weights, for an equality join
CHUNK = 64                 # slots ranked together, at least; else the root of their number
PREFIX_ROWS = 1_000_000    # documents up to which two digits of the digest make buckets


def place(doc_id: Column, text: Column) -> Column:
    """A document's place in the shuffle of its source."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), text))


def sized(df: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(doc_id, source, size, h): words of each document, and its place in the shuffle."""
    docs = documents(df, id_col, text_col, source=source_col)
    text = F.coalesce("text", F.lit(""))
    body = F.btrim(text, F.lit(BLANKS))
    size = F.when(body == "", 0).otherwise(F.size(F.split(body, GAPS))).cast("long")
    mark = place(F.col("doc_id"), text)
    return docs.select("doc_id", "source", size.alias("size"), mark.alias("h"))


def source_targets(docs: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """(source, source_size, weight, target): shares by weight, capped, the excess reshared.

    One row per source; each round of resharing is one aggregate over them.
    """
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))))
    table = materialise(sums.withColumn("weight", weight), "mix-sources")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:
        over = F.col("weight") * level > repeats * F.col("source_size")
        got = table.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, repeats * F.col("source_size"))),
            F.sum(F.when(~over, F.col("weight")))).first()
        if got[0] == held or not got[2]:
            break
        held, level = got[0], (total - (got[1] or 0.0)) / got[2]
    target = F.least(repeats * F.col("source_size"), F.col("weight") * level)
    return table.withColumn("target", target).withColumn("words", F.round("target").cast("long"))


def streams(docs: DataFrame, digits: int) -> DataFrame:
    """Each document's first word in its source's shuffled stream, as ``start``."""
    cut = docs.withColumn("bucket", F.substring("h", 1, digits))
    sums = cut.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = cut.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))
    return placed.join(sums, on).withColumn("start", F.col("base") + F.col("ahead")).drop(
        "_s", "_b", "base", "ahead", "bucket")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, rank, words): which block of which source each slot reads."""
    spark = targets.sparkSession
    need = targets.where("words > 0").withColumn("k", F.ceil(F.col("words") / F.lit(block)))
    n = need.agg(F.sum("k")).first()[0] or 0
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, 0)  # one row per source
    line = need.withColumn("hi", F.sum("k").over(upto) / F.lit(float(max(n, 1))))
    line = materialise(line.withColumn("lo", F.col("hi") - F.col("k") / F.lit(float(max(n, 1)))),
                       "mix-line")
    chunk = max(CHUNK, math.isqrt(n))  # as many chunks as slots in one
    cell = F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))
    cells = line.select("source", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS), F.greatest(cell, F.floor(F.col("lo") * CELLS)))).alias("cell"))
    point = (F.col("slot") + 0.5) * GOLDEN
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn(
        "x", point - F.floor(point)).withColumn("cell", F.floor(F.col("x") * CELLS))
    drawn = slots.join(cells, "cell").where("x >= lo and x < hi").select(
        "slot", "source", F.floor(F.col("slot") / chunk).alias("chunk"))
    per = drawn.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = per.select(F.col("source").alias("_s"), F.col("chunk").alias("_c"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("inside", inside).join(
        bases, F.col("source").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c")))
    ranked = ranked.select("slot", "source", (F.col("base") + F.col("inside")).alias("rank"))
    given = per.groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("given"))
    short = line.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn(
        "given", F.coalesce("given", F.lit(0))).where("given < k")
    late = short.select("source", F.explode(F.sequence("given", F.col("k") - 1)).alias("rank"))
    late = late.select((F.col("rank") + F.lit(n)).alias("slot"), "source", "rank")
    need = line.select(F.col("source").alias("_s"), "words", "k")
    return ranked.unionByName(late).join(need, F.col("source").eqNullSafe(F.col("_s"))).where(
        "rank < k").select("slot", "source", "rank", F.least(
            F.lit(block), F.col("words") - F.col("rank") * block).alias("words"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        *, weights=WEIGHTS, share=SHARE, repeats=REPEATS, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, h), one row per input row."""
    docs = materialise(sized(df, id_col, text_col, source_col), "mix-sizes")
    digits = 2 if docs.count() <= PREFIX_ROWS else 3
    targets = materialise(source_targets(docs, weights, share, repeats), "mix-targets")
    named = targets.select(F.col("source").alias("_s"), "source_size", "target", "words")
    placed = materialise(streams(docs, digits).join(
        named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-placed")
    epoch = F.explode(F.sequence(F.lit(0), F.lit(int(repeats) - 1))).alias("epoch")
    runs = placed.where("size > 0").select(
        "source", "start", "size", "words", "source_size", epoch).withColumn(
        "at", F.col("start") + F.col("epoch") * F.col("source_size")).where("at < words")
    end = F.least(F.col("at") + F.col("size"), F.col("words"))
    rank = F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block)))
    pieces = runs.select("source", "start", "at", end.alias("end"), rank.alias("rank"))
    slots = schedule(targets, block).select(F.col("source").alias("_s"), F.col("rank").alias("_r"),
                                            F.col("words").alias("read"))
    low = F.greatest("at", F.col("rank") * block)
    high = F.least("end", F.col("rank") * block + F.col("read"))
    taken = pieces.join(slots, F.col("source").eqNullSafe(F.col("_s"))
                        & (F.col("rank") == F.col("_r"))).groupBy("source", "start").agg(
        F.sum(high - low).alias("taken")).select(
        F.col("source").alias("_s"), F.col("start").alias("_p"), "taken")
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_p")) & (
        F.col("size") > 0)
    return placed.join(taken, on, "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "h")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", **params) -> DataFrame:
    """The rows as often as the mix takes them, all columns as they are.

    A row comes round(taken / size) times, which is 0 to ``repeats``.
    """
    taken = mix(df, id_col, text_col, source_col, **params).groupBy("h").agg(
        F.coalesce(F.round(F.try_divide(F.sum("taken"), F.sum("size"))), F.lit(0)).cast("int")
        .alias("times")).where("times > 0")
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])     # the caller's names cannot clash
    at, text = (F.col(f"c{df.columns.index(c)}") for c in (id_col, text_col))
    mark = place(at, F.coalesce(text.cast("string"), F.lit("")))
    again = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("again")
    return rows.withColumn("h", mark).join(taken, "h").select(*rows.columns, again).drop(
        "again").toDF(*df.columns)
