"""Per-group (mostly per-month) statistics, ranks and quantiles.

A cross-section can hold any number of assets, so a window over a whole month is
used only when the largest group is known to fit one task. Past
``ROW_LIMIT`` rows the same results come from

* aggregates with map-side combine whose small result is joined back, and
* ranks computed in *cells*: each oversized group is cut at sampled values, cells
  are counted and prefix-summed, and only the rows of one cell meet in a task.

Cuts come from a hash sample, so they are a pure function of the rows and a
recomputed partition lands in the same cells. A value that many rows share is
(with near certainty) one of the cuts and gets a cell of its own, where its rank
follows from the counts alone and its rows are never gathered.

A limit below ``ROW_LIMIT`` makes cells of that size as long as a group has at most ``CUTS``
of them; larger groups get larger cells, up to ``ROW_LIMIT`` rows, so that rows times cuts
grow no faster than the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.sources.store import attach, materialise

ROW_LIMIT = 1_000_000
SAMPLES_PER_CELL = 32
CUTS = 64    # a group is cut finer than this only to keep its cells within ROW_LIMIT rows


@dataclass(frozen=True)
class Section:
    """Upper bounds on the groups of a key: how many, and rows in the largest."""

    groups: int
    largest: int


def measure(df: DataFrame, keys) -> Section:
    """Count groups and the largest group with one aggregate job."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    row = counts.agg(F.count(F.lit(1)).alias("g"), F.max("_n").alias("m")).first()
    return Section(row["g"] or 0, row["m"] or 0)


def _fits(section: Section, row_limit: int | None) -> bool:
    return section.largest <= (ROW_LIMIT if row_limit is None else row_limit)


def with_group_aggs(df: DataFrame, keys, section: Section, row_limit: int | None = None,
                    cheap: bool = True, **aggs: Column) -> DataFrame:
    """Add aggregates of each row's group as columns.

    Wide groups read ``df`` twice; say ``cheap=False`` if it comes out of a shuffle, and
    it is written first instead of computed again.
    """
    keys = list(keys)
    if _fits(section, row_limit):
        w = Window.partitionBy(*keys)
        return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    if not cheap:
        df = materialise(df, "grouped")
    table = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return attach(df, table, keys, section.groups)


def rank_within(df: DataFrame, keys, value: str, *, tie: str, section: Section,
                average: str | None = None, ordinal: str | None = None,
                size: str | None = None, row_limit: int | None = None,
                stored: bool = False) -> DataFrame:
    """Rank non-null ``value`` ascending inside each group.

    ``average`` names a column for the tie-averaged rank, ``ordinal`` for a
    strict 1..n order with ties broken by ``tie`` (unique in the group), ``size``
    for the non-null count. Rows with a NULL value get NULL ranks.

    Cells take several passes that must see the same bits, so their input is written
    first unless the caller says it is ``stored`` already.
    """
    keys = list(keys)
    if _fits(section, row_limit):
        return _rank_windowed(df, keys, value, tie, average, ordinal, size)
    limit = ROW_LIMIT if row_limit is None else row_limit
    if not stored:
        df = materialise(df, "ranked")
    if average or not ordinal:
        df = _rank_celled(df, keys, F.col(value), tie, section, limit, average, size)
        size = None
    if ordinal:
        pair = F.struct(F.col(value).alias("v"), F.col(tie).alias("t"))
        order = F.when(F.col(value).isNotNull(), pair)
        df = _rank_celled(df, keys, order, tie, section, limit, ordinal, size)
        df = df.withColumn(ordinal, F.col(ordinal).cast("long"))
    return df


def _rank_windowed(df, keys, value, tie, average, ordinal, size):
    v = F.col(value)
    asc = v.asc_nulls_last()
    cols = []
    if ordinal:
        r = F.row_number().over(Window.partitionBy(*keys).orderBy(asc, F.col(tie)))
        cols.append(F.when(v.isNotNull(), r.cast("long")).alias(ordinal))
    if average:
        w = Window.partitionBy(*keys).orderBy(asc)
        upto = F.count(v).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        cols.append(F.when(v.isNotNull(), (F.rank().over(w) + upto) / 2.0).alias(average))
    if size:
        cols.append(F.count(v).over(Window.partitionBy(*keys)).alias(size))
    return df.select("*", *cols)


def _with_position(df: DataFrame, most: int) -> DataFrame:
    """Add ``__pos``, the number of sorted ``__cuts`` strictly below ``__o``.

    A lower bound by halving steps, one projection per step: array reads past the end
    are NULL and leave the position alone, and no step needs an interpreted lambda.
    """
    df = df.withColumn("__pos", F.lit(0))
    for power in reversed(range(max(1, math.ceil(math.log2(most + 1))))):
        jump = F.col("__pos") + 2 ** power
        df = df.withColumn("__pos", F.when(F.get("__cuts", jump - 1) < F.col("__o"), jump)
                           .otherwise(F.col("__pos")))
    return df


def _rank_celled(df, keys, order, tie, section, limit, out, size):
    # Every row is looked up in its group's cuts, so their number must not grow with a small limit.
    limit = max(limit, min(ROW_LIMIT, math.ceil(section.largest / CUTS)))
    cells_most = math.ceil(section.largest / limit)
    df = df.withColumn("__o", order)

    sizes = df.groupBy(*keys).agg(F.count("__o").alias("__live"))
    sizes = sizes.withColumn("__parts", F.ceil(F.col("__live") / limit).cast("int"))

    draw = F.pmod(F.xxhash64(F.col(tie), *[F.col(k) for k in keys]), F.col("__live"))
    sample = (attach(df.select(*keys, tie, "__o"), sizes, keys, section.groups)
              .where((F.col("__parts") > 1) & F.col("__o").isNotNull())
              .where(draw < F.col("__parts") * SAMPLES_PER_CELL))
    picks = (sample.groupBy(*keys)
             .agg(F.array_sort(F.collect_list("__o")).alias("__s"), F.max("__parts").alias("__p"))
             .select(*keys, F.array_distinct(F.transform(
                 F.sequence(F.lit(1), F.col("__p") - 1),
                 lambda i: F.get(F.col("__s"), F.floor(i * F.size("__s") / F.col("__p")).cast("int")),
             )).alias("__cuts")))
    plan = attach(sizes, picks, keys, section.groups * cells_most)
    empty = F.array_compact(F.array(F.lit(None).cast(df.schema["__o"].dataType)))
    plan = materialise(plan.select(*keys, "__live", F.coalesce("__cuts", empty).alias("__cuts")),
                       "cuts")

    # Even cells lie between cuts, odd cells hold one repeated value, -1 the NULLs.
    rows = attach(df, plan, keys, section.groups * cells_most)
    rows = _with_position(rows, cells_most)
    hit = F.coalesce(F.get(F.col("__cuts"), F.col("__pos")) == F.col("__o"), F.lit(False))
    rows = rows.withColumn("__cell", F.when(F.col("__o").isNull(), -1)
                           .otherwise(2 * F.col("__pos") + hit.cast("int"))).drop("__pos", "__cuts")

    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    # Filtering on __cell itself would copy the nested lookup into a scan predicate.
    counts = (rows.where(F.col("__o").isNotNull()).groupBy(*keys, "__cell")
              .agg(F.count(F.lit(1)).alias("__m"))
              .withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0))))
    rows = attach(rows, counts, [*keys, "__cell"], section.groups * 2 * cells_most)

    lone = F.col("__cell") % 2 != 0
    salt = F.when(lone, F.pmod(F.xxhash64(F.col(tie)), F.lit(4 * cells_most))).otherwise(F.lit(0))
    rows = rows.withColumn("__salt", salt)
    w = Window.partitionBy(*keys, "__cell", "__salt").orderBy("__o")
    upto = F.count("__o").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    local = F.when(lone, (F.col("__m") + 1) / 2.0).otherwise((F.rank().over(w) + upto) / 2.0)
    if out:
        rows = rows.withColumn(out, F.when(F.col("__o").isNotNull(), F.col("__before") + local))
    if size:
        rows = rows.withColumn(size, F.col("__live"))
    return rows.drop("__o", "__live", "__cell", "__m", "__before", "__salt")


def group_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float], *, tie: str,
                    section: Section, interpolation: str = "nearest",
                    row_limit: int | None = None) -> DataFrame:
    """Exact quantiles per group, one column per entry of ``probs``.

    ``nearest`` takes the observation at round((n-1)p), ``linear`` interpolates
    between its neighbours.
    """
    if interpolation not in ("nearest", "linear"):
        raise ValueError(f"unknown interpolation {interpolation!r}")
    keys = list(keys)
    ranked = rank_within(df.select(*keys, tie, value).where(F.col(value).isNotNull()), keys, value,
                         tie=tie, section=section, ordinal="_r", size="_n", row_limit=row_limit)
    at = F.col("_r") - 1
    out = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        if interpolation == "nearest":
            out.append(F.max(F.when(at == F.floor(pos + 0.5), F.col(value))).alias(name))
            continue
        lo = F.max(F.when(at == F.floor(pos), F.col(value)))
        hi = F.max(F.when(at == F.ceil(pos), F.col(value)))
        share = F.max(pos - F.floor(pos))
        out.append((lo + (hi - lo) * share).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def counted_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear quantiles per group where a group has few distinct values: only counts are gathered."""
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias("_m")))
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select(*keys, value, "_m", F.sum("_m").over(upto).alias("_upto"),
                           F.sum("_m").over(group).alias("_n"))
    out = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = (F.max(F.when((F.col("_upto") - F.col("_m") <= at) & (at < F.col("_upto")), F.col(value)))
                  for at in (F.floor(pos), F.ceil(pos)))
        out.append((lo + (hi - lo) * F.max(pos - F.floor(pos))).alias(name))
    return counts.groupBy(*keys).agg(*out)
