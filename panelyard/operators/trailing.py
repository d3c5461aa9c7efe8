"""Trailing features per asset.

An asset has at most one row per month, so its window partition is bounded by the
calendar however many source rows it had. All windows share one partitioning and
order: one exchange and one sort for the whole feature block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.config import MAX_MONTHS
from panelyard.functions.scalars import at_least, finite
from panelyard.operators.universe import by_asset, month_table
from panelyard.sources.store import attach

# Window lengths in months.
RETURN_WINDOWS = (3, 6, 12, 24, 36, 60)
VOL_WINDOWS = (12, 36, 60)
SHARPE_WINDOWS = (36, 60)


def _past(total: Column, length: int) -> Column:
    """Sum over the last ``length`` rows from a running total: O(1) per row."""
    return total - F.coalesce(F.lag(total, length).over(by_asset()), F.lit(0.0))


def _last(agg: Column, length: int) -> Column:
    return agg.over(by_asset().rowsBetween(-(length - 1), 0))


def spread_assets(df: DataFrame) -> DataFrame:
    """Hash the rows by asset at full width, once, for every window that follows.

    An explicit width keeps adaptive coalescing (which looks at bytes, not at the work
    of sliding windows) from folding the stage into a few tasks.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, "signalname")


def add_return_features(df: DataFrame) -> DataFrame:
    """Trailing returns, risk, skew and drawdown from rows with a finite return.

    A month that loses everything (a return of -1 or less; less cannot be compounded
    and counts as -1) makes every trailing return that spans it -1, and the drawdown
    over a frame that holds it minus infinity, which is given as NULL.

    As every row counts, "at least k observations" is a test on the row number. Sums
    come from running totals; only the central moments slide.
    """
    ret, own = F.col("ret"), by_asset()
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    lost, log = F.col("ret") <= -1, F.when(F.col("ret") > -1, F.log1p("ret")).otherwise(0.0)
    df = df.where(finite(ret).isNotNull()).select(
        "*", F.row_number().over(own).alias("_k"), F.sum(log).over(upto).alias("_cum"),
        F.sum(lost.cast("double")).over(upto).alias("_lost"),
        F.sum(ret).over(upto).alias("_sum"),
        *[_last(F.stddev_samp(ret), w).alias(f"_sd_{w}") for w in VOL_WINDOWS],
        _last(F.skewness(ret), 36).alias("_skew"))
    k, cum = F.col("_k"), F.col("_cum")

    def seen(least: int, value: Column) -> Column:
        return F.when(k >= least, value)

    def grown(w: int, skip: Column | None = None) -> Column:
        """Compounded return of the last ``w`` rows, the latest left out if ``skip``."""
        gone = _past(F.col("_lost"), w) - (lost.cast("double") if skip is not None else 0.0)
        total = _past(cum, w) - (skip if skip is not None else 0.0)
        return seen(w, F.when(gone > 0, -1.0).otherwise(F.exp(total) - 1))

    cols = [grown(w).alias(f"r_{w}") for w in RETURN_WINDOWS]
    cols += [ret.alias("r_1"), grown(12, log).alias("r_12_2")]
    cols += [seen(w // 2, F.col(f"_sd_{w}")).alias(f"vol_{w}") for w in VOL_WINDOWS]
    for w in SHARPE_WINDOWS:
        mean = _past(F.col("_sum"), w) / F.least(k, F.lit(w))
        risk = at_least(F.col(f"_sd_{w}"), 1e-6)
        cols.append(seen(w // 2, mean / risk * math.sqrt(12)).alias(f"sharpe_{w}"))
    cols.append(seen(36, F.col("_skew")).alias("skew_36"))
    gone = _past(F.col("_lost"), 60) > 0
    cols.append(seen(12, F.when(~gone, cum - _last(F.max(cum), 60))).alias("dd_60"))
    return df.select("*", *cols).drop("_k", "_cum", "_sum", "_skew", "_lost",
                                      *[f"_sd_{w}" for w in VOL_WINDOWS])


def with_index(df: DataFrame) -> DataFrame:
    """Equal-weighted index return and breadth of each month."""
    index = month_table(df, idx_ret=F.avg("ret"), n_available=F.count(F.lit(1)))
    return attach(df, index, ["yyyymm"], MAX_MONTHS)


def add_index_features(df: DataFrame) -> DataFrame:
    """Beta and correlation to the equal-weighted index, and its trailing sum."""
    ret, idx, own = F.col("ret"), F.col("idx_ret"), by_asset()
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    df = with_index(df.where(ret.isNotNull())).select(
        "*", F.row_number().over(own).alias("_k"), F.sum(idx).over(upto).alias("_sum"),
        _last(F.covar_samp(ret, idx), 60).alias("_cov"),
        _last(F.stddev_samp(idx), 60).alias("_sx"), _last(F.stddev_samp(ret), 60).alias("_sy"))
    k, cov, sx, sy = (F.col(c) for c in ("_k", "_cov", "_sx", "_sy"))
    return df.select(
        "*",
        F.when(k >= 24, cov / at_least(sx * sx, 1e-12)).alias("beta_idx"),
        F.when(k >= 24, cov / at_least(sx * sy, 1e-12)).alias("corr_idx"),
        F.when(k >= 12, _past(F.col("_sum"), 12)).alias("idx_r_12"),
    ).drop("_k", "_sum", "_cov", "_sx", "_sy")
