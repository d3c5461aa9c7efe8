"""Training objectives on long rows, one value per month window.

Rows are ([model,] window, pos, signalname, score, y[, carry, switch]) where ``pos`` is
the place of the month in its window; cells absent from the panel have no row. With a
``model`` column every model has windows of its own. These
differ from ``accounting`` on purpose: tilts use raw scores, exits are free, the
net asset value is floored and absolute changes are smoothed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scalars import huber, smooth_abs
from panelyard.operators.cross_section import Section, measure, with_group_aggs
from panelyard.sources.store import attach

CELL = ("window", "pos")
TINY = 1e-8
PORTFOLIO = ("sharpe", "utility")
NAMES = ("mse", "huber", "ic", *PORTFOLIO)


def series_of(rows: DataFrame) -> list[str]:
    return [c for c in ("model",) if c in rows.columns]


def cell_of(rows: DataFrame) -> list[str]:
    return [*series_of(rows), *CELL]


def window_of(rows: DataFrame) -> list[str]:
    return [*series_of(rows), "window"]


def raw_weights(rows: DataFrame, scheme: str = "tilt", *, tilt_gross: float = 1.0,
                gross: float = 2.0, temperature: float = 1.0, section: Section | None = None,
                row_limit: int | None = None) -> DataFrame:
    """Add ``w``: weights proportional to raw score deviations, differentiable."""
    if scheme not in ("tilt", "neutral", "simplex"):
        raise KeyError(f"unknown scheme {scheme!r}; have ['neutral', 'simplex', 'tilt']")
    keys = cell_of(rows)
    section = section or measure(rows, keys)
    if scheme == "simplex":
        rows = with_group_aggs(rows, keys, section, row_limit, _top=F.max("score"))
        rows = rows.withColumn("_e", F.exp((F.col("score") - F.col("_top"))
                                           / max(temperature, TINY)))
        rows = with_group_aggs(rows, keys, section, row_limit, _z=F.sum("_e"))
        return rows.withColumn("w", F.col("_e") / F.col("_z")).drop("_top", "_e", "_z")
    rows = with_group_aggs(rows, keys, section, row_limit, _mean=F.avg("score"),
                           _cells=F.count(F.lit(1)))
    rows = rows.withColumn("dev", F.col("score") - F.col("_mean"))
    rows = with_group_aggs(rows, keys, section, row_limit, _l1=F.sum(F.abs("dev")))
    rows = rows.withColumn("l1", F.greatest("_l1", F.lit(TINY)))
    if scheme == "tilt":
        w = 1.0 / F.col("_cells") + tilt_gross * F.col("dev") / F.col("l1")
    else:
        w = gross * F.col("dev") / F.col("l1")
    return rows.withColumn("w", w).drop("_mean", "_l1")


def with_prior(rows: DataFrame, section: Section, row_limit: int | None = None) -> DataFrame:
    """Add ``prior``, last month's weight after returns, 0 where the asset was absent."""
    rows = with_group_aggs(rows, cell_of(rows), section, row_limit,
                           _earned=F.sum(F.col("w") * F.col("y")))
    rows = rows.withColumn("nav", F.greatest(1.0 + F.col("_earned"), F.lit(0.1)))
    rows = rows.withColumn("_drift", F.col("w") * (1.0 + F.col("y")) / F.col("nav"))
    own = Window.partitionBy(*window_of(rows), "signalname").orderBy("pos")
    kept = F.lag("pos").over(own) == F.col("pos") - 1
    return (rows.withColumn("prior", F.when(kept, F.lag("_drift").over(own)).otherwise(0.0))
            .drop("_drift"))


def portfolio_months(rows: DataFrame, *, smooth: bool = True) -> DataFrame:
    """Gross return, cost and turnover of each month of a window."""
    change = F.col("w") - F.col("prior")
    move = smooth_abs(change) if smooth else F.abs(change)
    cost = F.col("switch") * move + F.col("carry") * F.abs("w")
    return rows.groupBy(*cell_of(rows)).agg(
        F.sum(F.col("w") * F.col("y")).alias("gross"), F.sum(cost).alias("cost"),
        F.sum(move).alias("turnover"))


def _portfolio_loss(name: str, net: Column, risk_aversion: float) -> Column:
    if name == "sharpe":
        return -F.avg(net) / F.greatest(F.stddev_samp(net), F.lit(TINY)) * 12 ** 0.5
    return -(F.avg(net) - 0.5 * risk_aversion * F.var_samp(net))


def objective_by_window(rows: DataFrame, name: str, *, scheme: str = "tilt", delta: float = 0.02,
                        risk_aversion: float = 10.0, turnover_penalty: float = 0.0,
                        section: Section | None = None, row_limit: int | None = None) -> DataFrame:
    """([model,] window, n_months, loss); portfolio objectives add net Sharpe, annual gross
    return, annual cost and turnover."""
    if name not in NAMES:
        raise KeyError(f"unknown objective {name!r}; have {sorted(NAMES)}")
    x, y, win = F.col("score"), F.col("y"), window_of(rows)
    months = F.count_distinct("pos").alias("n_months")
    if name in ("mse", "huber"):
        loss = (x - y) * (x - y) if name == "mse" else huber(x - y, delta)
        return rows.groupBy(*win).agg(months, F.avg(loss).alias("loss"))
    if name == "ic":
        sxy = F.covar_pop(x, y) * F.count(F.lit(1))
        norms = [F.sqrt(F.greatest(F.var_pop(c) * F.count(F.lit(1)), F.lit(TINY))) for c in (x, y)]
        by_month = rows.groupBy(*cell_of(rows)).agg((sxy / (norms[0] * norms[1])).alias("ic"))
        return by_month.groupBy(*win).agg(months, (-F.avg("ic")).alias("loss"))
    section = section or measure(rows, cell_of(rows))
    held = with_prior(raw_weights(rows, scheme, section=section, row_limit=row_limit),
                      section, row_limit)
    by_month = portfolio_months(held).withColumn(
        "net", F.col("gross") - F.col("cost") - turnover_penalty * F.col("turnover"))
    net = F.col("net")
    return by_month.groupBy(*win).agg(
        months, _portfolio_loss(name, net, risk_aversion).alias("loss"),
        (-_portfolio_loss("sharpe", net, risk_aversion)).alias("sharpe_net"),
        (F.avg("gross") * 12).alias("ret_gross"), (F.avg("cost") * 12).alias("cost"),
        F.avg("turnover").alias("turnover"))


def evaluate_objective(rows: DataFrame, name: str, **options) -> DataFrame:
    """The objective averaged over windows, weighted by their months: a row per model."""
    per_window = objective_by_window(rows, name, **options)
    weighted = F.sum(F.col("loss") * F.col("n_months"))
    return per_window.groupBy(*series_of(rows)).agg(F.try_divide(weighted, F.sum("n_months")).alias("loss"),
                          F.sum("n_months").alias("n_months"))


def score_gradient(rows: DataFrame, name: str, *, scheme: str = "tilt", delta: float = 0.02,
                   risk_aversion: float = 10.0, turnover_penalty: float = 0.0,
                   tilt_gross: float = 1.0, gross: float = 2.0, section: Section | None = None,
                   row_limit: int | None = None) -> DataFrame:
    """Add ``ds``, the derivative of a row's window loss to its score (tilt or neutral).

    Backward pass in the same shape as the forward one: month totals, one step ahead
    per asset (this month's weight is next month's starting point), month totals.
    """
    if scheme not in ("tilt", "neutral"):
        raise KeyError(f"no gradient for scheme {scheme!r}; have ['neutral', 'tilt']")
    cell, window = cell_of(rows), window_of(rows)
    section = section or measure(rows, cell)
    x, y = F.col("score"), F.col("y")
    n_windows = Section(section.groups, section.largest * section.groups)

    def agg(df, keys, size, **columns):
        return with_group_aggs(df, keys, size, row_limit, **columns)

    if name in ("mse", "huber"):
        df = agg(rows, window, n_windows, _cells=F.count(F.lit(1)))
        slope = 2.0 * (x - y) if name == "mse" else F.greatest(
            F.least(x - y, F.lit(delta)), F.lit(-delta))
        return df.withColumn("ds", slope / F.col("_cells")).drop("_cells")

    if name == "ic":
        df = agg(rows, cell, section, _mx=F.avg(x), _my=F.avg(y))
        df = df.withColumn("_p", x - F.col("_mx")).withColumn("_t", y - F.col("_my"))
        df = agg(df, cell, section, _pp=F.sum(F.col("_p") * F.col("_p")),
                 _tt=F.sum(F.col("_t") * F.col("_t")), _pt=F.sum(F.col("_p") * F.col("_t")))
        df = agg(df, window, n_windows, _months=F.max("pos"))
        den = F.sqrt(F.greatest("_pp", F.lit(TINY)) * F.greatest("_tt", F.lit(TINY)))
        pull = F.when(F.col("_pp") > TINY, F.col("_pt") * F.col("_p") / F.col("_pp")).otherwise(0.0)
        return (df.withColumn("ds", -(F.col("_t") - pull) / den / F.col("_months"))
                .drop("_mx", "_my", "_p", "_t", "_pp", "_tt", "_pt", "_months"))

    df = with_prior(raw_weights(rows, scheme, tilt_gross=tilt_gross, gross=gross, section=section,
                                row_limit=row_limit), section, row_limit)
    nets = portfolio_months(df).withColumn(
        "_net", F.col("gross") - F.col("cost") - turnover_penalty * F.col("turnover"))
    win = Window.partitionBy(*window)  # one row per month of a window
    t, mean, sd = (f.over(win) for f in (F.count("_net"), F.avg("_net"), F.stddev_samp("_net")))
    away = F.col("_net") - mean
    if name == "sharpe":
        floor = F.greatest(sd, F.lit(TINY))
        bend = F.when(sd > TINY, mean * away / (sd * (t - 1) * sd * sd)).otherwise(0.0)
        outer = -(12 ** 0.5) * (1.0 / (t * floor) - bend)
    else:
        outer = -(1.0 / t - risk_aversion * away / (t - 1))
    df = attach(df, nets.select(*cell, outer.alias("_g")), cell, section.groups)

    change = F.col("w") - F.col("prior")
    kink = (F.col("switch") + turnover_penalty) * change / F.sqrt(change * change + 1e-8)
    df = df.withColumn("_pay", F.col("_g") * kink)  # -dL/d(prior) of this row is -_pay
    own = Window.partitionBy(*window, "signalname").orderBy("pos")
    lasts = F.lead("pos").over(own) == F.col("pos") + 1
    df = df.withColumn("_next", F.when(lasts, F.lead("_pay").over(own)).otherwise(0.0))
    grown = F.col("w") * (1.0 + y)
    df = with_group_aggs(df, cell, section, row_limit, cheap=False,
                         _pull=F.sum(F.col("_next") * grown))
    live = (1.0 + F.col("_earned")) > 0.1
    ahead = F.col("_next") * (1.0 + y) / F.col("nav") - F.when(
        live, y * F.col("_pull") / (F.col("nav") * F.col("nav"))).otherwise(0.0)
    dw = F.col("_g") * (y - F.col("carry") * F.signum("w")) - F.col("_pay") + ahead
    df = df.withColumn("_dw", dw)
    df = agg(df, cell, section, _along=F.sum(F.col("_dw") * F.col("dev")))
    scale = tilt_gross if scheme == "tilt" else gross
    ddev = scale * (F.col("_dw") / F.col("l1") - F.when(
        F.col("l1") > TINY, F.signum("dev") * F.col("_along") / (F.col("l1") * F.col("l1"))
    ).otherwise(0.0))
    df = df.withColumn("_dd", ddev)
    df = agg(df, cell, section, _md=F.avg("_dd"))
    return df.withColumn("ds", F.col("_dd") - F.col("_md")).select(*rows.columns, "ds")
