"""Walk-forward folds and month windows as small tables joined to the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.config import MAX_MONTHS, Costs, Split
from panelyard.functions.months import month_index, month_index_of
from panelyard.operators.cross_section import measure, rank_within
from panelyard.sources.store import attach

ROLES = ("train", "val", "test")


def distinct_months(df: DataFrame) -> DataFrame:
    return df.select("yyyymm").distinct()


def walk_forward_folds(months: DataFrame, split: Split = Split()) -> DataFrame:
    """(fold, role, yyyymm): train, an embargo, validation, test, in that order.

    Blocks are ranges of month ordinals, so the folds are one range join against at
    most a few dozen rows.
    """
    s = split
    mi = month_index(F.col("yyyymm"))
    years = months.agg(F.floor(F.max("yyyymm") / 100).cast("int").alias("last")).where(
        F.col("last") >= s.first_test_year).select(
        F.explode(F.sequence(F.lit(s.first_test_year), F.col("last"),
                             F.lit(s.test_step_years))).alias("year"))
    test_lo = F.col("year") * 12 + 1
    val_lo = test_lo - s.val_years * 12
    train_hi = val_lo - 1 - s.embargo_months
    train_lo = (F.lit(month_index_of(s.train_start)) if s.expanding
                else train_hi - s.train_years * 12 + 1)

    def block(role, lo, hi):
        return F.struct(F.lit(role).alias("role"), lo.alias("lo"), hi.alias("hi"))

    blocks = years.select("year", F.explode(F.array(
        block("train", train_lo, train_hi), block("val", val_lo, test_lo - 1),
        block("test", test_lo, test_lo + s.test_step_years * 12 - 1))).alias("b"))
    rows = months.withColumn("_mi", mi).join(
        F.broadcast(blocks), F.col("_mi").between(F.col("b.lo"), F.col("b.hi")))
    rows = rows.select("year", F.col("b.role").alias("role"), "yyyymm")

    def size(role):
        return F.count(F.when(F.col("role") == role, 1))

    def end(f, role):
        return f(F.when(F.col("role") == role, F.col("yyyymm")))

    # Years run until the first test block without months.
    so_far = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    sizes = (F.broadcast(years).join(rows, "year", "left").groupBy("year").agg(
        size("train").alias("n_train"), size("val").alias("n_val"), size("test").alias("n_test"),
        F.concat_ws("-", end(F.min, "test"), end(F.max, "test")).alias("fold"))
        .withColumn("_open", F.min("n_test").over(so_far) > 0))
    kept = sizes.where(F.col("_open") & (F.col("n_train") >= s.min_train_months)
                       & (F.col("n_val") >= s.min_val_months)).select("year", "fold")
    return rows.join(F.broadcast(kept), "year").select("fold", "role", "yyyymm")


def require_folds(folds: DataFrame) -> DataFrame:
    if folds.isEmpty():
        raise ValueError("no folds; check the split settings against the sample")
    return folds


def leakage_violations(folds: DataFrame, embargo_months: int = 0) -> DataFrame:
    """(fold, problem) rows; empty when every block strictly precedes the next, no month is tested
    twice, and no fold learns from the ``embargo_months`` calendar months before its validation."""
    def end(f, role):
        return f(F.when(F.col("role") == role, F.col("yyyymm")))

    ends = folds.groupBy("fold").agg(
        end(F.max, "train").alias("train_hi"), end(F.min, "val").alias("val_lo"),
        end(F.max, "val").alias("val_hi"), end(F.min, "test").alias("test_lo"))
    gap = month_index(F.col("val_lo")) - month_index(F.col("train_hi")) - 1
    order = ends.select("fold", F.explode(F.array_compact(F.array(
        F.when(F.col("train_hi") >= F.col("val_lo"), F.lit("train overlaps val")),
        F.when(F.col("val_hi") >= F.col("test_lo"), F.lit("val overlaps test")),
        F.when((gap >= 0) & (gap < embargo_months), F.lit("embargo breached")),
    ))).alias("problem"))
    twice = (folds.where(F.col("role") == "test").groupBy("yyyymm")
             .agg(F.count(F.lit(1)).alias("k"), F.min("fold").alias("fold"))
             .where(F.col("k") > 1).select("fold", F.lit("month tested twice").alias("problem")))
    return order.unionByName(twice)


def fold_rows(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Panel rows stamped with each (fold, role) they serve in."""
    return panel.join(F.broadcast(folds), "yyyymm")  # folds x months, calendar-bounded


def month_windows(months: DataFrame, length: int, stride: int | None = None) -> DataFrame:
    """(window, pos, yyyymm) for overlapping runs of ``length`` months.

    Starts step by ``stride`` (default half a window) and a last window reaches the
    end; a block shorter than ``length`` is one window. ``months`` is one row per
    month, so its ordering window is calendar-bounded.
    """
    stride = stride or max(length // 2, 1)
    everything = Window.partitionBy(F.lit(1))
    numbered = months.select(
        "yyyymm", F.row_number().over(everything.orderBy("yyyymm")).alias("_k"),
        F.count(F.lit(1)).over(everything).alias("_n"))
    last = F.greatest(F.col("_n") - length, F.lit(0)).cast("int")
    starts = (numbered.where(F.col("_k") == 1).select(F.explode(F.array_union(
        F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))).alias("window")))
    inside = (F.col("_k") > F.col("window")) & (F.col("_k") <= F.col("window") + length)
    return (numbered.join(F.broadcast(starts), inside)
            .select("window", (F.col("_k") - F.col("window")).cast("int").alias("pos"), "yyyymm"))


def window_rows(panel: DataFrame, windows: DataFrame) -> DataFrame:
    return panel.join(F.broadcast(windows), "yyyymm")  # <= 2 windows per month by default


def densify(panel: DataFrame, windows: DataFrame, features: list[str], costs: Costs = Costs(),
            target: str = "ret_next_dm") -> DataFrame:
    """Every (month, asset seen in the window) cell; absent cells are zero with mask 0.

    Each asset carries the window's short month list, so no month-by-asset product is
    ever joined.
    """
    rate = F.lit(costs.spread_bps / 1e4)
    have = panel.select("signalname", "yyyymm", F.lit(1).alias("mask"),
                        F.col(target).alias("y"),
                        (F.col("carry_cost") if "carry_cost" in panel.columns else rate).alias("carry"),
                        F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float"))
                                  for c in features]).alias("x"))
    lists = windows.groupBy("window").agg(
        F.array_sort(F.collect_list(F.struct("pos", "yyyymm"))).alias("_months"))
    assets = window_rows(panel.select("signalname", "yyyymm"), windows).select(
        "window", "signalname").distinct()
    cells = (attach(assets, lists, ["window"], MAX_MONTHS)
             .select("window", "signalname", F.explode("_months").alias("_m"))
             .select("window", "signalname", "_m.pos", "_m.yyyymm"))
    zero = F.lit(0.0)
    mask = F.coalesce("mask", F.lit(0))
    empty = F.array(*[F.lit(0.0).cast("float") for _ in features])
    return cells.join(have, ["signalname", "yyyymm"], "left").select(
        "window", "pos", "yyyymm", "signalname", mask.alias("mask"),
        F.coalesce("y", zero).alias("y"), F.coalesce("carry", zero).alias("carry"),
        F.when(mask == 1, 2.0 * costs.switch_bps / 1e4).otherwise(0.0).alias("switch"),
        F.coalesce("x", empty).alias("x"))


def encode_ids(df: DataFrame, col: str = "signalname", row_limit: int | None = None) -> DataFrame:
    """(id, code) with codes 0, 1, … in sorted order."""
    ids = df.select(col).distinct()
    ranked = rank_within(ids, [], col, tie=col, section=measure(ids, []), ordinal="_r",
                         row_limit=row_limit)
    return ranked.select(col, (F.col("_r") - 1).cast("int").alias("code"))
