"""Net-of-cost accounting of a weight book.

Nothing here runs month after month: a month's trade depends only on the previous
month's weights and returns, so the whole history is one pass of month totals and
one per-asset window.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.config import Costs
from panelyard.functions.months import next_month
from panelyard.functions.scalars import at_most
from panelyard.operators.universe import require_columns
from panelyard.sources.store import attach

SERIES = ("model", "scheme")
SCALED = ("gross", "cost", "net", "turnover", "switching", "carrying")


def month_ordinals(df: DataFrame, series) -> DataFrame:
    """1, 2, … over the months a series actually traded in."""
    months = df.select(*series, "yyyymm").distinct()
    order = Window.partitionBy(*series).orderBy("yyyymm")
    return months.withColumn("_ord", F.row_number().over(order))


def with_drift(book: DataFrame, months: DataFrame, keys, groups: int | None) -> DataFrame:
    """Weights at the end of the month if nothing is traded."""
    r = F.coalesce("ret_next", F.lit(0.0))
    nav = 1.0 + F.col("_earned")
    grown = F.col("weight") * (1.0 + r)
    return (attach(book, months, keys, groups)
            .withColumn("drifted", F.when(F.abs(nav) < 1e-8, grown)
                        .otherwise(F.try_divide(grown, nav))))


def account(book: DataFrame, costs: Costs = Costs(), *, series: tuple[str, ...] = SERIES,
            groups: int | None = None) -> DataFrame:
    """One row per (series, month) with gross return, turnover and unscaled costs.

    ``groups`` is a proven bound on the number of (series, month) pairs, if known.
    """
    require_columns(book, [*series, "yyyymm", "signalname", "weight", "ret_next"])
    keys = [*series, "yyyymm"]
    w, r = F.col("weight"), F.coalesce("ret_next", F.lit(0.0))
    carry = F.coalesce("carry_cost", F.lit(0.0)) if "carry_cost" in book.columns else F.lit(0.0)
    order = Window.partitionBy(*series).orderBy("yyyymm")
    months = book.groupBy(*keys).agg(
        F.sum(w * r).alias("_earned"), F.sum(carry * F.abs(w)).alias("carrying"),
        F.sum(F.when(w < 0, -w).otherwise(0.0)).alias("_short"),
        F.count(F.lit(1)).alias("n")).withColumn("_ord", F.row_number().over(order))

    held = with_drift(book.select(*keys, "signalname", "weight", "ret_next"),
                      months.select(*keys, "_ord", "_earned"), keys, groups)
    own = Window.partitionBy(*series, "signalname").orderBy("_ord")
    now = F.col("_ord")
    before = F.when(F.lag("_ord").over(own) == now - 1, F.lag("drifted").over(own)).otherwise(0.0)
    stays = F.coalesce(F.lead("_ord").over(own) == now + 1, F.lit(False))
    moves = held.select(*series, F.array_compact(F.array(
        F.struct(now.alias("m"), F.abs(w - before).alias("move")),
        F.when(~stays, F.struct((now + 1).alias("m"), F.abs("drifted").alias("move"))),
    )).alias("_moves"))
    turnover = (moves.select(*series, F.explode("_moves").alias("e"))
                .groupBy(*series, F.col("e.m").alias("_ord"))
                .agg(F.sum("e.move").alias("turnover")))

    # The exit of the last month's book has no month to fall in and drops here.
    joined = months.join(turnover, [*series, "_ord"])
    return joined.select(
        *series, F.col("yyyymm").alias("formation_yyyymm"),
        next_month(F.col("yyyymm")).alias("yyyymm"), F.col("_earned").alias("gross"),
        (F.col("turnover") * (2.0 * costs.switch_bps / 1e4)).alias("switching"), "carrying",
        (F.col("_short") * (costs.short_fee_bps_annual / 1e4 / 12.0)).alias("borrow"),
        "turnover", "n")


def net_of_costs(base: DataFrame, multipliers=(1.0,)) -> DataFrame:
    """Net return at each cost multiple. Weights do not depend on it, so a sweep is
    a month-level expansion. The borrow fee is not scaled."""
    mult = F.explode(F.array(*[F.lit(float(m)) for m in multipliers]))
    out = base.withColumn("cost_mult", mult)
    out = out.withColumn("switching", F.col("switching") * F.col("cost_mult"))
    out = out.withColumn("carrying", F.col("carrying") * F.col("cost_mult"))
    out = out.withColumn("cost", F.col("switching") + F.col("carrying") + F.col("borrow"))
    return out.withColumn("net", F.col("gross") - F.col("cost"))


def vol_target(monthly: DataFrame, target: float, *, series: tuple[str, ...] = SERIES,
               window: int = 36, least: int = 12, most: float = 3.0) -> DataFrame:
    """Lever each month to ``target`` volatility, estimated on earlier months only."""
    keys = [*series, "cost_mult"] if "cost_mult" in monthly.columns else list(series)
    past = Window.partitionBy(*keys).orderBy("yyyymm").rowsBetween(-window, -1)
    sd = F.when(F.count("net").over(past) >= least, F.stddev_samp("net").over(past))
    wanted = F.when(sd == 0, F.lit(most)).otherwise(
        at_most(F.try_divide(F.lit(target), sd * math.sqrt(12)), most))
    out = monthly.withColumn("leverage", F.coalesce(wanted, F.lit(1.0)))
    return out.withColumns({c: F.col(c) * F.col("leverage") for c in SCALED})
