"""Forecast and performance statistics.

Inputs are month-level series (one row per month and series, bounded by the
calendar), except where a function says it reads the full panel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.config import MAX_MONTHS
from panelyard.functions.scalars import finite, pearson, sharpe
from panelyard.operators.cross_section import Section, measure, rank_within
from panelyard.sources.store import attach, materialise

MONTHS = 12
FACTORS = ("mktrf", "smb", "hml", "rmw", "cma", "umd")


def _default_lags(n):
    return F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0)))


MOST_LAGS = math.floor(4 * (MAX_MONTHS / 100) ** (2 / 9))


def bartlett(x: Column, order, lags: Column | int, most: int = MOST_LAGS) -> Column:
    """x_t^2 plus its weighted products with earlier values; the sum over a series
    is the HAC estimate of the variance of sum(x). NULL lags count as zero."""
    lags = F.lit(lags) if isinstance(lags, int) else lags
    total = x * x
    for lag in range(1, most + 1):
        pair = F.coalesce(x * F.lag(x, lag).over(order), F.lit(0.0))
        total = total + F.when(lags >= lag, 2.0 * (1 - lag / (lags + 1.0)) * pair).otherwise(0.0)
    return total


def with_mean_hac(df: DataFrame, keys, order: str, value: str, out: str = "_hac") -> DataFrame:
    """Add each row's term of the HAC variance of the mean of ``value``."""
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy(order)
    df = (df.withColumn("_e", F.col(value) - F.avg(value).over(whole))
          .withColumn("_lags", _default_lags(F.count(value).over(whole))))
    return df.withColumn(out, bartlett(F.col("_e"), ordered, F.col("_lags"))).drop("_e", "_lags")


def mean_t(value: str, hac: str = "_hac") -> Column:
    """t-statistic aggregate over rows prepared by :func:`with_mean_hac`."""
    n = F.count(value)
    var = F.greatest(F.sum(hac) / n, F.lit(1e-18))
    return F.when(n >= 3, F.avg(value) / F.sqrt(var / n))


def newey_west(df: DataFrame, keys, order: str, value: str) -> DataFrame:
    live = df.where(F.col(value).isNotNull())
    return (with_mean_hac(live, keys, order, value).groupBy(*keys)
            .agg(F.count(value).alias("n"), mean_t(value).alias("t")))


def sharpe_se(r: str) -> Column:
    """Standard error of the annualised Sharpe ratio, with skew and fat tails."""
    n, sd = F.count(r), F.stddev_samp(r)
    sr = F.try_divide(F.avg(r), sd)
    var = (1 + 0.5 * sr * sr - F.skewness(r) * sr + F.kurtosis(r) / 4 * sr * sr) / n
    return F.when((n >= 12) & (sd > 0), F.sqrt(F.greatest(var, F.lit(0.0)) * MONTHS))


def equity_curve(df: DataFrame, keys, order: str = "yyyymm", value: str = "net") -> DataFrame:
    """Growth of 1 and the distance below its running maximum."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.product(1.0 + F.coalesce(value, F.lit(0.0))).over(upto))
    return df.withColumn("drawdown", F.try_divide("equity", F.max("equity").over(upto)) - 1)


# ----------------------------------------------------------------- forecasts
def oos_r2(y: Column, yhat: Column) -> Column:
    """Share of squared return explained against a zero forecast."""
    ok = y.isNotNull() & yhat.isNotNull()
    lost = F.sum(F.when(ok, (y - yhat) * (y - yhat)))
    return 1.0 - F.try_divide(lost, F.sum(F.when(ok, y * y)))


def scaled_r2(x: Column, y: Column) -> Column:
    """``oos_r2`` after the one OLS rescaling of the score, from moments alone."""
    n = F.count(x)
    sxy, sxx = F.covar_samp(x, y), F.var_samp(x)
    explained = F.coalesce(F.try_divide(sxy * sxy, sxx), F.lit(0.0))
    lost = (F.var_samp(y) - explained) * (n - 1)
    return 1.0 - F.try_divide(lost, F.sum(y * y))


def scale_to_target(df: DataFrame, *, score: str = "score", target: str = "ret_next",
                    models: int | None = None) -> DataFrame:
    """Add ``fitted``, the score restated by one OLS line per model; a constant score
    becomes the mean outcome. ``models`` is a proven bound on their number."""
    x, y = F.col(score), F.col(target)
    lines = df.groupBy("model").agg(
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        F.coalesce(F.try_divide(F.covar_samp(x, y), F.var_samp(x)), F.lit(0.0)).alias("_b"))
    return (attach(df, lines, ["model"], models)
            .withColumn("fitted", F.col("_my") + F.col("_b") * (x - F.col("_mx")))
            .drop("_mx", "_my", "_b"))


def monthly_ic(df: DataFrame, *, score: str = "score", target: str = "ret_next",
               method: str = "spearman", series: tuple[str, ...] = ("model",),
               section: Section | None = None, row_limit: int | None = None) -> DataFrame:
    """Cross-sectional correlation of score and outcome, one row per month (reads
    the full panel)."""
    keys = [*series, "yyyymm"]
    x, y = score, target
    df = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    if method == "spearman":
        section = section or measure(df, keys)
        for col, name in ((score, "_rx"), (target, "_ry")):
            df = rank_within(df, keys, col, tie="signalname", section=section, average=name,
                             row_limit=row_limit)
        x, y = "_rx", "_ry"
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    return df.groupBy(*keys).agg(pearson(F.col(x), F.col(y)).alias("ic"))


def ic_summary(ic: DataFrame, series: tuple[str, ...] = ("model",)) -> DataFrame:
    live = with_mean_hac(ic.where(F.col("ic").isNotNull()), series, "yyyymm", "ic")
    return live.groupBy(*series).agg(
        F.avg("ic").alias("ic_mean"), mean_t("ic").alias("ic_t"),
        F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"),
        F.avg((F.col("ic") > 0).cast("double")).alias("ic_hit"))


# --------------------------------------------------------------- performance
def _breakeven() -> Column:
    turnover = F.avg("turnover")
    return F.when(turnover > 0, F.avg("gross") / turnover * 1e4)


def performance_summary(monthly: DataFrame, keys=("model", "scheme")) -> DataFrame:
    """Headline row per strategy; every window and the aggregate share one exchange."""
    keys = list(keys)
    df = equity_curve(with_mean_hac(monthly, keys, "yyyymm", "net"), keys)
    year = F.lit(float(MONTHS))
    return df.groupBy(*keys).agg(
        F.count("net").alias("n_months"),
        (F.avg("gross") * year).alias("ret_gross"), (F.avg("net") * year).alias("ret_net"),
        (F.stddev_samp("net") * math.sqrt(MONTHS)).alias("vol"),
        sharpe(F.col("gross")).alias("sharpe_gross"), sharpe(F.col("net")).alias("sharpe_net"),
        sharpe_se("net").alias("sharpe_net_se"), mean_t("net").alias("t_net"),
        F.min("drawdown").alias("max_dd"), F.skewness("net").alias("skew"),
        F.avg("turnover").alias("turnover"), (F.avg("cost") * year).alias("cost_drag"),
        F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"),
        _breakeven().alias("breakeven_bps"))


def subperiod_table(monthly: DataFrame, breaks: tuple[int, ...] = (200001, 201001),
                    keys=("model", "scheme"), least: int = 12) -> DataFrame:
    """Net performance in the blocks between ``breaks`` (months of P&L)."""
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    m = F.col("yyyymm")
    block = sum(((m >= b).cast("int") for b in breaks), F.lit(0))
    lo = F.min(m).over(whole)
    hi = F.max(m).over(whole)
    for i, b in enumerate(breaks):
        lo = F.when(F.col("_block") == i + 1, F.lit(b)).otherwise(lo)
        hi = F.when(F.col("_block") == i, F.lit(b - 1)).otherwise(hi)
    label = F.concat_ws("-", F.floor(lo / 100).cast("string"), F.floor(hi / 100).cast("string"))
    df = monthly.withColumn("_block", block).withColumn("period", label)
    keys += ["period"]
    df = equity_curve(with_mean_hac(df, keys, "yyyymm", "net"), keys)
    return df.groupBy(*keys).agg(
        F.count("net").alias("n_months"), (F.avg("net") * float(MONTHS)).alias("ret_net"),
        sharpe(F.col("net")).alias("sharpe_net"), mean_t("net").alias("t_net"),
        F.min("drawdown").alias("max_dd")).where(F.col("n_months") >= least)


# --------------------------------------------------------------- regressions
def _sums_of(products: list[Column]) -> Column:
    return F.array(*[F.coalesce(F.sum(p), F.lit(0.0)) for p in products])


def _estimates(k: int):
    """Solves from one row of sums per series: coefficients, HAC t and r2, terms in order.

    A row has x'x, x'y and y's spread, and the score products x_t e_t e_s x_s' added up lag by lag in weights.
    """
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for keys, xx, xy, n, spread, rss, score in zip(
                pdf["keys"], pdf["xx"], pdf["xy"], pdf["n"], pdf["spread"], pdf["rss"], pdf["score"]):
            coef, inverse, free = _from_products(np.reshape(xx, (k, k)), np.asarray(xy))
            s = np.reshape(score, (k, k))
            with np.errstate(divide="ignore", invalid="ignore"):
                t = coef / np.sqrt(np.diag(inverse @ s @ inverse))
            r2 = 1 - rss / spread if spread else float("nan")
            if n <= k:
                coef, t, r2 = np.full(k, np.nan), np.full(k, np.nan), float("nan")
            t = np.where(free | ~np.isfinite(t), np.nan, t)
            out.append((keys, np.where(free, np.nan, coef), t, n, r2))
        return pd.DataFrame(out, columns=["keys", "coef", "t", "n", "r2"])
    return solve


def _from_products(xx: np.ndarray, xy: np.ndarray):
    """Coefficients, the inverse of x'x, and which terms the data cannot tell apart."""
    scale = np.sqrt(np.diag(xx).clip(0))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(xx / np.outer(scale, scale))
    live = values > 1e-10 * max(values.max(initial=0), 1e-300)
    free = (vectors[:, ~live] ** 2).sum(axis=1) > 1e-8
    inverse = ((vectors[:, live] / values[live]) @ vectors[:, live].T) / np.outer(scale, scale)
    return inverse @ xy, inverse, free


def _coefficients(k: int):
    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([_from_products(np.reshape(a, (k, k)), np.asarray(b))[0].tolist()
                          for a, b in zip(xx, xy)])
    return solve


def factor_regression(returns: DataFrame, factors: DataFrame, *, cols: list[str] | None = None,
                      series: tuple[str, ...] = ("model",), value: str = "net",
                      lags: int = 6) -> DataFrame:
    """Long table (series, term, coef, t, p, r2, n) of returns on factors.

    Products of the terms, then of the residual scores with those of up to ``lags`` months before, are sums
    by series with map-side combine; only these sums, a K x K handful per series, are solved in Python.
    The constant is annualised. Terms that are not identified (a constant or collinear
    factor) have NULL estimates; a series of no more months than terms has NULL in all of them.
    """
    cols = cols or [c for c in FACTORS if c in factors.columns]
    keys = list(series)
    terms, k = ["const", *cols], len(cols) + 1
    given = factors.select("yyyymm", *[F.col(c).cast("double").alias(f"_x{i + 1}") for i, c in enumerate(cols)])
    rows = returns.select(*keys, "yyyymm", F.col(value).cast("double").alias("_y")).join(
        F.broadcast(given.dropDuplicates(["yyyymm"])), "yyyymm").dropna(
        subset=["_y", *[f"_x{i}" for i in range(1, k)]]).withColumn("_x0", F.lit(1.0))
    rows = materialise(rows, "regression")       # read for the products and for the scores
    x = [F.col(f"_x{i}") for i in range(k)]
    y = F.col("_y")
    products = rows.groupBy(*keys).agg(
        _sums_of([a * b for a in x for b in x]).alias("xx"), _sums_of([a * y for a in x]).alias("xy"),
        F.count(y).alias("n"), (F.var_pop(y) * F.count(y)).alias("spread"))
    fitted = products.withColumn("_b", _coefficients(k)("xx", "xy"))
    resid = y - sum((F.get("_b", i) * x[i] for i in range(k)), F.lit(0.0))
    scored = rows.join(fitted.select(*keys, "_b"), keys).withColumn("_e", resid)
    own = Window.partitionBy(*keys).orderBy("yyyymm")       # months, by the calendar
    now = [F.col(f"_u{i}") for i in range(k)]
    scored = scored.withColumns({f"_u{i}": x[i] * F.col("_e") for i in range(k)})
    past = {f"_p{i}": sum((2.0 * (1 - lag / (lags + 1.0)) * F.coalesce(F.lag(f"_u{i}", lag).over(own), F.lit(0.0))
                           for lag in range(1, lags + 1)), now[i]) for i in range(k)}
    scored = scored.withColumns(past)
    one_way = scored.groupBy(*keys).agg(
        _sums_of([now[i] * F.col(f"_p{j}") for i in range(k) for j in range(k)]).alias("_s"),
        F.sum(F.col("_e") * F.col("_e")).alias("rss"))
    # A lag counts once from each side.
    mirrored = F.array(*[(F.get("_s", i * k + j) + F.get("_s", j * k + i)) / 2.0
                         for i in range(k) for j in range(k)])
    sums = products.join(one_way.select(*keys, "rss", mirrored.alias("score")), keys)
    named = sums.select(F.struct(*keys).alias("keys"), "xx", "xy", "n", "spread", "rss", "score")
    kinds = ", ".join(f"{c}: {dict(sums.dtypes)[c]}" for c in keys)
    solve = _estimates(k)
    solved = named.mapInPandas(
        lambda frames: map(solve, frames),
        f"keys struct<{kinds}>, coef array<double>, t array<double>, n long, r2 double")
    names = F.array(*[F.lit(t) for t in terms])
    long = solved.select("keys.*", "n", finite(F.col("r2")).alias("r2"), F.posexplode(F.arrays_zip(
        names.alias("term"), "coef", "t")).alias("_i", "_e"))
    t = finite(F.col("_e.t"))
    annual = F.when(F.col("_i") == 0, float(MONTHS)).otherwise(1.0)
    return long.select(*keys, "_e.term", (finite(F.col("_e.coef")) * annual).alias("coef"), t.alias("t"),
                       _two_sided(t).alias("p"), "r2", "n")


def _two_sided(t: Column) -> Column:
    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        return v.map(lambda z: math.erfc(abs(z) / math.sqrt(2)), na_action="ignore")
    return tail(t)


def alpha_vs_benchmark(returns: DataFrame, *, bench: str = "equal_weight", value: str = "net",
                       least: int = 24, lags: int = 6, series: tuple[str, ...] = ("model",)
                       ) -> DataFrame:
    """Each series' net return on the benchmark's: alpha, HAC t, active return.

    The constant is a weighted sum of returns, alpha = sum(h*y); its HAC variance is
    that of the series h*residual, so lag windows replace matrix algebra.
    """
    keys = list(dict.fromkeys([*series, "model"]))
    months = returns.select(*keys, "yyyymm", F.col(value).alias("y"))
    base = (months.where(F.col("model") == bench).select("yyyymm", F.col("y").alias("x"))
            .dropDuplicates(["yyyymm"]))
    df = (months.where(F.col("model") != bench).join(F.broadcast(base), "yyyymm")
          .dropna(subset=["x", "y"]))
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("yyyymm")
    x, y = F.col("x"), F.col("y")
    n, mx, my = (f.over(whole) for f in (F.count(x), F.avg(x), F.avg(y)))
    beta = F.try_divide(F.covar_samp(x, y).over(whole), F.var_samp(x).over(whole))
    df = (df.withColumns({"_n": n, "_mx": mx, "_beta": beta, "_sxx": F.var_samp(x).over(whole)})
          .withColumn("_alpha", my - F.col("_beta") * mx).withColumn("_act", y - x)
          .withColumn("_resid", y - F.col("_alpha") - F.col("_beta") * x)
          .withColumn("_h", 1.0 / F.col("_n") - F.try_divide(
              F.col("_mx") * (x - F.col("_mx")), F.col("_sxx") * (F.col("_n") - 1))))
    df = df.withColumn("_he", F.col("_h") * F.col("_resid"))
    df = df.withColumn("_ahac", bartlett(F.col("_he"), ordered, lags, lags))
    df = with_mean_hac(df, keys, "yyyymm", "_act")
    alpha = F.first("_alpha")
    explained = F.covar_samp(x, y) * F.covar_samp(x, y)
    return df.groupBy(*keys).agg(
        (alpha * MONTHS).alias("alpha_ann"),
        F.try_divide(alpha, F.sqrt(F.sum("_ahac"))).alias("alpha_t"),
        F.first("_beta").alias("beta_bench"),
        F.try_divide(explained, F.var_samp(x) * F.var_samp(y)).alias("r2"),
        (F.avg("_act") * MONTHS).alias("active_ann"),
        sharpe(F.col("_act")).alias("info_ratio"), mean_t("_act").alias("t_active"),
        F.count("y").alias("_rows")).where(F.col("_rows") >= least).drop("_rows")
