"""Which rows enter the study: point-in-time screens, targets, breadth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.config import MAX_MONTHS, Universe
from panelyard.functions.months import month_index
from panelyard.sources.store import attach

ID_COLS = ("signalname", "yyyymm")
META_COLS = ("ret", "ret_next", "ret_next_dm", "carry_cost", "switch_cost",
             "turnover_raw", "n_available")


def by_asset():
    """An asset's months in order; calendar-bounded once its key is unique."""
    return Window.partitionBy("signalname").orderBy("yyyymm")


def require_columns(df: DataFrame, needed) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {missing}")


def post_publication(returns: DataFrame, metadata: DataFrame, u: Universe) -> DataFrame:
    """Keep an asset from the January after its publication year, inside the sample.

    The join is on the asset key and left to the planner: as a shuffle join it
    leaves rows partitioned the way the per-asset windows need them anyway.
    """
    months = F.col("yyyymm").between(u.start, u.end)
    published = metadata.select("signalname", "pub_year").where(F.col("pub_year").isNotNull())
    joined = returns.where(months).join(published, "signalname")
    return joined.where(F.col("yyyymm") >= (F.col("pub_year") + 1) * 100 + 1).drop("pub_year")


def month_table(df: DataFrame, **aggs) -> DataFrame:
    """One row per month; aggregates combine map-side before the shuffle."""
    return df.groupBy("yyyymm").agg(*[a.alias(n) for n, a in aggs.items()])


def demean(df: DataFrame, col: str = "ret_next", out: str = "ret_next_dm") -> DataFrame:
    """Subtract the month's equal-weighted mean."""
    means = month_table(df, _mean=F.avg(col))
    return (attach(df, means, ["yyyymm"], MAX_MONTHS)
            .withColumn(out, F.col(col) - F.col("_mean")).drop("_mean"))


def next_month_target(df: DataFrame) -> DataFrame:
    """``ret_next`` from the row exactly one calendar month later; others drop."""
    here = month_index(F.col("yyyymm"))
    ahead = (df.withColumn("_mi", F.lead(here).over(by_asset()))
             .withColumn("ret_next", F.lead("ret").over(by_asset())))
    return ahead.where(F.col("_mi") == here + 1).drop("_mi")


def min_breadth(df: DataFrame, least: int) -> DataFrame:
    counts = month_table(df, _breadth=F.count(F.lit(1))).where(F.col("_breadth") >= least)
    return attach(df, counts.select("yyyymm"), ["yyyymm"], MAX_MONTHS, how="left_semi")


def add_target(df: DataFrame, least: int) -> DataFrame:
    """Target, demeaned target and breadth screen from a single month table."""
    df = next_month_target(df)
    months = month_table(df, _mean=F.avg("ret_next"), _breadth=F.count(F.lit(1)))
    months = months.where(F.col("_breadth") >= least).drop("_breadth")
    return (attach(df, months, ["yyyymm"], MAX_MONTHS, how="inner")
            .withColumn("ret_next_dm", F.col("ret_next") - F.col("_mean")).drop("_mean"))


def feature_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c not in ID_COLS + META_COLS)


def in_panel_order(df: DataFrame) -> DataFrame:
    meta = [c for c in META_COLS if c in df.columns]
    return df.select(*ID_COLS, *meta, *feature_columns(df))


def panel_summary(df: DataFrame) -> DataFrame:
    """Rows, assets, months, date range and the spread of assets per month."""
    totals = df.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_distinct("signalname").alias("n_assets"))
    per_month = month_table(df, _n=F.count(F.lit(1)))
    spread = per_month.agg(
        F.count(F.lit(1)).alias("n_months"), F.min("yyyymm").alias("first_month"),
        F.max("yyyymm").alias("last_month"), F.min("_n").alias("min_assets"),
        F.median("_n").alias("median_assets"), F.max("_n").alias("max_assets"))
    return totals.crossJoin(F.broadcast(spread))  # one row each
