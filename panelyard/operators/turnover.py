"""Measuring how fast each signal's decile book churns, and what that costs.

Books are ranked in long form, keyed by (signal, month). Their churn comes from each month
beside the one before, all signals at once, while that fits a task; past it from the books
themselves, keyed by (signal, firm).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.config import MAX_MONTHS, Costs
from panelyard.functions.months import from_month_index, month_index
from panelyard.functions.scalars import finite, pearson
from panelyard.operators.cross_section import (ROW_LIMIT, Section, counted_quantiles, group_quantiles,
                                               measure, rank_within)
from panelyard.operators.universe import by_asset
from panelyard.sources.store import attach

FIRM_IDS = ("permno", "yyyymm")
CELL_LIMIT = 16_000_000     # rows times signals of a month that one task compares with the month before


def unpivot_signals(firms: DataFrame, signals: list[str], start: int = 192601,
                    end: int = 202312) -> DataFrame:
    """(permno, yyyymm, signalname, value) without the empty cells of a sparse table."""
    window = firms.where(F.col("yyyymm").between(start, end))
    return (window.select(*FIRM_IDS, *[finite(F.col(s)).alias(s) for s in signals])
            .unpivot(list(FIRM_IDS), signals, "signalname", "value")
            .where(F.col("value").isNotNull()))


def decile_book(values: DataFrame, section: Section | None = None, n_quantiles: int = 10,
                row_limit: int | None = None, stored: bool = False) -> DataFrame:
    """Equal-weighted long-short extreme-quantile book with gross exposure 2.

    Boundaries compare integers (rank*q against n), so they cannot slip by a
    rounding error; leg sizes follow from n alone.
    """
    keys = ["signalname", "yyyymm"]
    section = section or measure(values, keys)
    q = n_quantiles
    ranked = rank_within(values, keys, "value", tie="permno", section=section,
                         ordinal="_r", size="_n", row_limit=row_limit, stored=stored)
    r, n = F.col("_r"), F.col("_n")
    side = F.when(r * q > n * (q - 1), 1.0).when(r * q <= n, -1.0).otherwise(0.0)
    held = n - F.floor(n * (q - 1) / q) + F.floor(n / q)
    return ranked.where(n >= 2 * q).select(
        *keys, "permno", side.alias("side"), (r / n).alias("u"),
        (side / F.greatest(held, F.lit(1)) * 2.0).alias("w"))


def turnover_series(book: DataFrame, min_common: int = 30) -> DataFrame:
    """Sum of absolute weight changes between consecutive calendar months.

    Each firm's row pays its change from last month and, if the firm is gone next
    month, its exit then. Exit amounts dated to a month the signal was not measured
    in are dropped with it. Change rows combine map-side, so a month costs one row
    per task in the final shuffle however many firms it has.
    """
    by_firm = Window.partitionBy("signalname", "permno").orderBy("_mi")
    mi = F.col("_mi")
    moves = (book.withColumn("_mi", month_index(F.col("yyyymm")))
             .withColumn("_stays", F.lag("_mi").over(by_firm) == mi - 1)
             .withColumn("_w0", F.when(F.col("_stays"), F.lag("w").over(by_firm)).otherwise(0.0))
             .withColumn("_u0", F.when(F.col("_stays"), F.lag("u").over(by_firm)))
             .withColumn("_leaves", F.coalesce(F.lead("_mi").over(by_firm) != mi + 1, F.lit(True))))
    here = F.struct(mi.alias("m"), F.abs(F.col("w") - F.col("_w0")).alias("move"),
                    F.lit(1).alias("present"), F.col("u").alias("u"), F.col("_u0").alias("u0"))
    gone = F.when(F.col("_leaves") & (F.col("w") != 0), F.struct(
        (mi + 1).alias("m"), F.abs("w").alias("move"), F.lit(0).alias("present"),
        F.lit(None).cast("double").alias("u"), F.lit(None).cast("double").alias("u0")))
    events = moves.select("signalname", F.explode(F.array_compact(F.array(here, gone))).alias("e"))

    u = F.when(F.col("e.u0").isNotNull(), F.col("e.u"))
    months = events.groupBy("signalname", F.col("e.m").alias("_mi")).agg(
        F.sum("e.move").alias("turnover"), F.sum("e.present").alias("_present"),
        F.count("e.u0").alias("_common"), pearson(u, F.col("e.u0")).alias("_corr"))
    by_signal = Window.partitionBy("signalname").orderBy("_mi")
    return (months.where(F.col("_present") > 0)
            .withColumn("_last", F.lag("_mi").over(by_signal))
            .where(F.col("_last") == mi - 1)
            .select("signalname", from_month_index(mi).alias("yyyymm"), "turnover",
                    F.when(F.col("_common") > min_common, F.col("_corr")).alias("rank_autocorr")))


def _book_of(x: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ranks over n of one month's book; firms in order, missing values NaN."""
    live = np.flatnonzero(~np.isnan(x))
    n = len(live)
    w, u = np.zeros(len(x)), np.full(len(x), np.nan)
    if n < 2 * q:
        return w, u
    order = live[np.argsort(x[live], kind="stable")]
    r = np.arange(1, n + 1)
    side = np.where(r * q > n * (q - 1), 1.0, np.where(r * q <= n, -1.0, 0.0))
    held = n - np.floor(n * (q - 1) / q) + np.floor(n / q)
    w[order], u[order] = side / max(held, 1) * 2.0, r / n
    return w, u


def _correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    x, y = x - x.mean(), y - y.mean()
    norm = np.sqrt((x @ x) * (y @ y))
    return float(x @ y / norm) if norm else None


def measured_turnover(firms: DataFrame, signals: list[str], *, section: Section | None = None,
                      start: int = 192601, end: int = 202312, n_quantiles: int = 10,
                      min_common: int = 30, row_limit: int | None = None) -> DataFrame:
    """:func:`turnover_series` of the signals' decile books, straight from the firm table.

    Each row goes to its own month and the next, so a task that has a month also has the one
    before: both are ranked there, and one exchange of the wide rows is all that moves. Months
    too wide for a task go through the books. ``section`` is of the firm table's months.
    """
    section = section or measure(firms, ["yyyymm"])
    if section.largest * len(signals) > (CELL_LIMIT if row_limit is None else row_limit):
        values = unpivot_signals(firms, signals, start, end)
        long = Section(section.groups * len(signals), section.largest)
        book = decile_book(values, long, n_quantiles, row_limit, stored=True)
        return turnover_series(book, min_common)

    def run(table: pa.Table) -> pa.Table:
        at = table.column("_at")[0].as_py()
        table = table.take(pc.sort_indices(
            table, sort_keys=[("permno", "ascending"), ("_mi", "ascending")], null_placement="at_start"))
        firm = pc.dictionary_encode(table.column("permno").combine_chunks(), null_encoding="encode")
        firm = firm.indices.to_numpy(zero_copy_only=False)
        now = table.column("_mi").to_numpy() == at
        stays = np.flatnonzero(firm[1:] == firm[:-1])   # last month's row, this month's is the next
        alone = np.ones(len(now), dtype=bool)
        alone[stays], alone[stays + 1] = False, False
        rows = []
        for s in signals:
            x = table.column(s).cast(pa.float64()).to_numpy()
            w, u = np.zeros(len(x)), np.full(len(x), np.nan)
            for month in (now, ~now):
                w[month], u[month] = _book_of(x[month], n_quantiles)
            if np.isnan(u[now]).all() or np.isnan(u[~now]).all():
                continue
            moved = np.abs(w[alone]).sum() + np.abs(w[stays + 1] - w[stays]).sum()
            u0, u1 = u[stays], u[stays + 1]
            both = ~(np.isnan(u0) | np.isnan(u1))
            corr = _correlation(u1[both], u0[both]) if both.sum() > min_common else None
            rows.append({"signalname": s, "_mi": at, "turnover": float(moved), "rank_autocorr": corr})
        return pa.Table.from_pylist(rows, schema=schema)

    schema = pa.schema([("signalname", pa.string()), ("_mi", pa.int32()), ("turnover", pa.float64()),
                        ("rank_autocorr", pa.float64())])
    mi = F.col("_mi")
    window = firms.where(F.col("yyyymm").between(start, end))
    pairs = (window.select("permno", month_index(F.col("yyyymm")).alias("_mi"),
                           *[finite(F.col(s)).alias(s) for s in signals])
             .select("*", F.explode(F.array(mi, mi + 1)).alias("_at")))
    months = pairs.groupBy("_at").applyInArrow(
        run, "signalname string, _mi int, turnover double, rank_autocorr double")
    return months.select("signalname", from_month_index(mi).alias("yyyymm"), "turnover", "rank_autocorr")


def causal_turnover(series: DataFrame, min_months: int = 24) -> DataFrame:
    """Mean turnover over months strictly before t, once ``min_months`` are seen."""
    past = by_asset().rowsBetween(Window.unboundedPreceding, -1)
    mean = F.when(F.count("turnover").over(past) >= min_months, F.avg("turnover").over(past))
    return series.withColumn("turnover_causal", mean)


def attach_holding_period(turnover: DataFrame, metadata: DataFrame) -> DataFrame:
    """Spread a month's churn over the documented holding period."""
    doc = metadata.select("signalname", "holding_months", "stock_weight", "ls_quantile")
    return (turnover.join(doc, "signalname", "left")
            .withColumn("turnover_monthly", _per_holding_month()))


def _per_holding_month():
    held = F.coalesce(F.col("holding_months").cast("double"), F.lit(1.0))
    return F.col("turnover_causal") / F.greatest(held, F.lit(1.0))


def cost_rate(turnover: DataFrame, costs: Costs = Costs()) -> DataFrame:
    return (turnover.withColumn("carry_bps", F.col("turnover_monthly") * costs.spread_bps)
            .withColumn("switch_bps", F.lit(2.0 * costs.switch_bps)))


def fill_turnover(panel: DataFrame, fallback: str = "pooled", row_limit: int | None = None,
                  values: int | None = None) -> DataFrame:
    """Forward-fill ``turnover_causal`` per asset, then fall back to a median.

    ``pooled`` is the median over the whole panel (it looks ahead; kept because
    results are defined by it), ``month`` the causal within-month median. ``values`` is a proven
    bound on the distinct turnovers: if a task holds them, the median comes from their counts.
    """
    if fallback not in ("pooled", "month"):
        raise ValueError(f"unknown fallback {fallback!r}")
    keys = [] if fallback == "pooled" else ["yyyymm"]
    upto = by_asset().rowsBetween(Window.unboundedPreceding, 0)
    filled = panel.withColumn("turnover_causal",
                              F.last("turnover_causal", ignorenulls=True).over(upto))
    known = (filled.where(F.col("turnover_causal").isNotNull())
             .select(F.struct("signalname", "yyyymm").alias("_row"), "yyyymm", "turnover_causal"))
    if values is not None and values <= (ROW_LIMIT if row_limit is None else row_limit):
        middle = counted_quantiles(known, keys, "turnover_causal", {"_median": 0.5})
    else:
        middle = group_quantiles(known, keys, "turnover_causal", {"_median": 0.5}, tie="_row",
                                 section=measure(panel, keys), interpolation="linear",
                                 row_limit=row_limit)
    out = attach(filled, middle, keys, MAX_MONTHS)
    return out.withColumn("turnover_causal",
                          F.coalesce("turnover_causal", "_median")).drop("_median")


def attach_costs(panel: DataFrame, causal: DataFrame | None, costs: Costs = Costs(), *,
                 on: tuple[str, ...] = ("signalname", "yyyymm"), fallback: str = "pooled",
                 flat_turnover: float | None = None, causal_rows: int | None = None,
                 row_limit: int | None = None) -> DataFrame:
    """Carrying and switching cost of each asset-month.

    Without a measured series, ``flat_turnover`` prices every asset alike.
    ``causal_rows`` is a proven bound on the series table, if the caller has one.
    """
    if causal is None:
        if flat_turnover is None:
            raise ValueError("no turnover series: pass flat_turnover for a flat rate")
        out = panel.withColumn("turnover_causal", F.lit(float(flat_turnover)))
    else:
        out = attach(panel, causal.select(*on, "turnover_causal"), on, causal_rows)
        out = fill_turnover(out, fallback, row_limit, causal_rows)
    monthly = _per_holding_month()
    return (out.withColumn("turnover_monthly", monthly)
            .withColumn("turnover_raw", F.col("turnover_monthly"))
            .withColumn("carry_cost", F.col("turnover_monthly") * costs.spread_bps / 1e4)
            .withColumn("switch_cost", F.lit(2.0 * costs.switch_bps / 1e4))
            .drop("turnover_causal"))
