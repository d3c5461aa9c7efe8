"""Result tables. Accounting runs once for all models, schemes and cost multiples;
every table below reads its monthly rows (or the weight book) and stays small."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.config import Settings
from panelyard.functions.months import decimal_year
from panelyard.functions.scalars import pearson, sharpe
from panelyard.operators import accounting, inference
from panelyard.operators.cross_section import Section, measure, rank_within
from panelyard.operators.weights import BENCHMARK, allocate, cap_weights
from panelyard.sources.store import materialise

# Digits kept per column in written tables.
DIGITS = {
    "oos_r2_pct": 3, "ic_mean": 4, "ic_t": 2, "ic_ir": 2, "ic_hit": 2, "ret_gross": 4,
    "ret_net": 4, "vol": 4, "sharpe_gross": 2, "sharpe_net": 2, "sharpe_net_se": 2, "t_net": 2,
    "max_dd": 3, "skew": 2, "turnover": 3, "cost_drag": 4, "hit_rate": 2, "breakeven_bps": 0,
    "alpha_ann": 4, "alpha_t": 2, "r2": 3, "switching_ann": 4, "carrying_ann": 4, "gross_ann": 4,
    "net_ann": 4, "beta_bench": 2, "info_ratio": 2, "t_active": 2, "active_ann": 4,
    "mean_tilt": 5, "mean_turnover": 3, "tilt": 5, "mean": 5, "cost_mult": 2, "cost_bps": 1,
    "spearman_vs_sharpe_net": 3, "p_value": 3,
}


def weight_book(predictions: DataFrame, settings: Settings = Settings(), *,
                schemes=("tilt",), series: tuple[str, ...] = ("model",),
                benchmark_of: str | None = None, section: Section | None = None) -> DataFrame:
    """Capped weights of every model and scheme plus the 1/N book, written once."""
    pc = settings.portfolio
    book = materialise(allocate(predictions, schemes, pc, series=series, section=section,
                                benchmark_of=benchmark_of), "book")
    if not pc.max_weight:
        return book
    keys = list(dict.fromkeys([*series, "model", "scheme", "yyyymm"]))
    return cap_weights(book, pc.max_weight, keys=keys)


def monthly_results(book: DataFrame, settings: Settings = Settings(), *,
                    series: tuple[str, ...] = ("model", "scheme"), multipliers=(1.0,),
                    groups: int | None = None) -> DataFrame:
    base = accounting.account(book, settings.costs, series=series, groups=groups)
    out = accounting.net_of_costs(base, multipliers)
    if settings.portfolio.vol_target:
        return accounting.vol_target(out, settings.portfolio.vol_target, series=series)
    return out


def statistical_table(predictions: DataFrame, target: str = "ret_next",
                      section: Section | None = None) -> DataFrame:
    live = predictions.dropna(subset=["score", target])
    fit = live.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_obs"),
        (100.0 * inference.scaled_r2(F.col("score"), F.col(target))).alias("oos_r2_pct"))
    ic = inference.ic_summary(inference.monthly_ic(live, target=target, section=section))
    return fit.join(ic, "model").orderBy(F.desc("ic_mean"))


def economic_table(monthly: DataFrame, keys=("model", "scheme")) -> DataFrame:
    return inference.performance_summary(monthly, keys).orderBy(F.desc("sharpe_net"))


def best_model(economic: DataFrame) -> str | None:
    row = economic.where(F.col("model") != BENCHMARK).orderBy(F.desc("sharpe_net")).first()
    return row["model"] if row else None


def top_models(economic: DataFrame, k: int = 4) -> DataFrame:
    return (economic.where(F.col("model") != BENCHMARK)
            .orderBy(F.desc("sharpe_net"), "model").limit(k))


STRATEGY = ("model", "scheme")


def base_costs(monthly: DataFrame) -> DataFrame:
    """The rows at the base cost, where a cost sweep is in the table."""
    return monthly.where(F.col("cost_mult") == 1.0) if "cost_mult" in monthly.columns else monthly


def of_scheme(monthly: DataFrame, scheme: str) -> DataFrame:
    """One scheme's rows, and the benchmark's."""
    return monthly.where((F.col("scheme") == scheme) | (F.col("model") == BENCHMARK))


def strategy_returns(monthly: DataFrame, models: list[str], scheme: str = "tilt") -> DataFrame:
    """Net return per month, one column per model, under one scheme."""
    return of_scheme(base_costs(monthly), scheme).groupBy("yyyymm").pivot("model", models).agg(
        F.first("net"))


def alpha_table(monthly: DataFrame, factors: DataFrame, cols: list[str] | None = None
                ) -> DataFrame:
    terms = cols or [c for c in inference.FACTORS if c in factors.columns]
    long = inference.factor_regression(base_costs(monthly), factors, cols=terms, series=STRATEGY)

    def pick(term: str, col: str):
        return F.max(F.when(F.col("term") == term, F.col(col)))

    return long.groupBy(*STRATEGY).agg(
        pick("const", "coef").alias("alpha_ann"), pick("const", "t").alias("alpha_t"),
        F.max("r2").alias("r2"), F.max("n").alias("n"),
        *[pick(t, "coef").alias(f"beta_{t}") for t in terms]).orderBy(F.desc("alpha_t"))


def cost_sensitivity(monthly: DataFrame, spread_bps: float = 25.0) -> DataFrame:
    """Net Sharpe and return at each cost multiple present in ``monthly``."""
    return monthly.groupBy(*STRATEGY, "cost_mult").agg(
        (F.col("cost_mult") * spread_bps).alias("cost_bps"),
        sharpe(F.col("net")).alias("sharpe_net"), (F.avg("net") * 12.0).alias("ret_net"))


def cost_curve(sensitivity: DataFrame, highlight: list[str], scheme: str = "tilt") -> DataFrame:
    """Highlighted models beside the band spanned by all the others, under one scheme."""
    sensitivity = of_scheme(sensitivity, scheme)
    rest = ~F.col("model").isin(*highlight, BENCHMARK)
    band = sensitivity.where(rest).groupBy("cost_bps").agg(
        F.min("sharpe_net").alias("others_low"), F.max("sharpe_net").alias("others_high"))
    lines = sensitivity.where(~rest).select("model", "cost_bps", "sharpe_net")
    return lines.join(band, "cost_bps", "left")


def turnover_profile(monthly: DataFrame) -> DataFrame:
    year = F.lit(12.0)
    return base_costs(monthly).groupBy(*STRATEGY).agg(
        F.avg("turnover").alias("turnover"), (F.avg("switching") * year).alias("switching_ann"),
        (F.avg("carrying") * year).alias("carrying_ann"), (F.avg("gross") * year).alias("gross_ann"),
        (F.avg("net") * year).alias("net_ann")).orderBy(F.desc("net_ann"))


def cost_decomposition(profile: DataFrame) -> DataFrame:
    """Stacked-bar offsets: net, then switching, then carrying."""
    left = F.greatest(F.col("net_ann"), F.lit(0.0))
    return profile.select(*STRATEGY, "net_ann", "switching_ann", "carrying_ann",
                          left.alias("switching_from"),
                          (left + F.col("switching_ann")).alias("carrying_from"))


def decay_analysis(monthly: DataFrame, breaks: tuple[int, ...] = (201501,), least: int = 12
                   ) -> DataFrame:
    models = base_costs(monthly).where(F.col("model") != BENCHMARK)
    return inference.subperiod_table(models, breaks, STRATEGY, least)


def alpha_vs_benchmark(monthly: DataFrame) -> DataFrame:
    return inference.alpha_vs_benchmark(base_costs(monthly), series=STRATEGY)


def tilt_by_cost_quintile(book: DataFrame, model: str, *, section: Section | None = None,
                          row_limit: int | None = None) -> DataFrame:
    """Average tilt from 1/N by within-month quintile of measured turnover."""
    mine = book.where((F.col("model") == model) & (F.col("scheme") == "tilt"))
    section = section or measure(mine, ["yyyymm"])
    ranked = rank_within(mine, ["yyyymm"], "turnover_raw", tie="signalname", section=section,
                         ordinal="_r", size="_m", row_limit=row_limit)
    place = F.ceil(F.try_divide((F.col("_r") - 1) * 5, F.col("_m") - 1))
    return (ranked.where(F.col("_r").isNotNull())
            .withColumn("cost_quintile", F.greatest(F.lit(1), F.coalesce(place, F.lit(1))))
            .groupBy("cost_quintile").agg(
                F.avg(F.col("weight") - 1.0 / F.col("n")).alias("mean_tilt"),
                F.avg("turnover_raw").alias("mean_turnover"), F.count(F.lit(1)).alias("n"))
            .select(F.lit(model).alias("model"), "*"))


def tilt_by_category(book: DataFrame, panel: DataFrame, model: str,
                     prefix: str = "cat_economic_") -> DataFrame:
    """Mean over months of the mean tilt within each category."""
    cats = [c for c in panel.columns if c.startswith(prefix)]
    first = panel.groupBy("signalname").agg(
        F.min_by(F.struct(*cats), "yyyymm").alias("_c")).select("signalname", "_c.*")
    mine = book.where((F.col("model") == model) & (F.col("scheme") == "tilt"))
    flags = F.array_compact(F.array(*[
        F.when(F.col(c) > 0, F.lit(c.removeprefix(prefix))) for c in cats]))
    tagged = (mine.join(first, "signalname")
              .select("yyyymm", (F.col("weight") - 1.0 / F.col("n")).alias("tilt"),
                      F.explode(flags).alias("category")))
    by_month = tagged.groupBy("yyyymm", "category").agg(F.avg("tilt").alias("tilt"))
    return (by_month.groupBy("category").agg(F.avg("tilt").alias("mean"),
                                             F.count(F.lit(1)).alias("count"))
            .select(F.lit(model).alias("model"), "*").orderBy(F.desc("mean")))


def _small_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average ranks of a table with one row per model."""
    w = Window.partitionBy(*keys).orderBy(value)
    upto = F.count(value).over(w.rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, (F.rank().over(w) + upto) / 2.0)


@F.pandas_udf(T.DoubleType())
def spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a rank correlation from Student's t with n-2 degrees.

    The tail probability is integrated over the angle atan(t / sqrt(df)).
    """
    import numpy as np

    def tail(r, m):
        df = m - 2
        if r is None or r != r or df < 1:
            return float("nan")
        if abs(r) >= 1:
            return 0.0
        theta = np.linspace(math.asin(abs(r)), math.pi / 2, 20001)
        power = np.cos(theta) ** (df - 1)
        log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
        return 2 * math.exp(log_c) * float(np.trapezoid(power, theta))

    return pd.Series([tail(r, m) for r, m in zip(rho, n)])


def accuracy_versus_value(statistical: DataFrame, economic: DataFrame) -> DataFrame:
    """Does forecast accuracy order the models as net Sharpe does?"""
    worth = economic.where(F.col("model") != BENCHMARK).select("model", "sharpe_net")
    merged = statistical.join(worth, "model").unpivot(
        ["model", "sharpe_net"], ["ic_mean", "ic_t", "oos_r2_pct"], "metric", "value")
    merged = merged.where(F.col("value").isNotNull() & F.col("sharpe_net").isNotNull())
    merged = _small_ranks(_small_ranks(merged, ["metric"], "value", "_a"),
                          ["metric"], "sharpe_net", "_b")
    return merged.groupBy("metric").agg(
        pearson(F.col("_a"), F.col("_b")).alias("spearman_vs_sharpe_net"),
        F.count(F.lit(1)).alias("n_models")).withColumn(
            "p_value", spearman_p(F.col("spearman_vs_sharpe_net"), F.col("n_models")))


def capacity_full(economic: DataFrame) -> DataFrame:
    """The long table of both universes."""
    return economic.select("universe", "model", "ret_gross", "ret_net", "sharpe_gross",
                           "sharpe_net", "t_net", "turnover")


def capacity_comparison(economic: DataFrame, wide: str, narrow: str) -> DataFrame:
    """Net Sharpe per model in two universes, with the change."""
    sharpes = economic.groupBy("model").pivot("universe", [wide, narrow]).agg(F.first("sharpe_net"))
    return sharpes.withColumn("delta", F.col(narrow) - F.col(wide)).orderBy(F.desc(wide))


def rank_agreement(table: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman correlation of two columns of a one-row-per-model table."""
    both = table.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_all", F.lit(1))
    both = _small_ranks(_small_ranks(both, ["_all"], a, "_a"), ["_all"], b, "_b")
    return both.agg(pearson(F.col("_a"), F.col("_b")).alias("rho"))


def common_months(monthly: DataFrame, by: str = "universe") -> DataFrame:
    """Keep the months every universe has."""
    seen = monthly.select(by, "yyyymm").distinct()
    total = seen.select(F.count_distinct(by).alias("_all"))
    shared = (seen.groupBy("yyyymm").agg(F.count(F.lit(1)).alias("_k"))
              .crossJoin(F.broadcast(total)).where(F.col("_k") == F.col("_all")))
    return monthly.join(F.broadcast(shared.select("yyyymm")), "yyyymm", "left_semi")


# ------------------------------------------------------- data behind charts
def growth_of_one(monthly: DataFrame, keys=("model", "scheme")) -> DataFrame:
    out = inference.equity_curve(monthly, list(keys))
    return out.select(*keys, "yyyymm", decimal_year(F.col("yyyymm")).alias("year"),
                      "equity", "drawdown")


def rolling_ic(ic: DataFrame, window: int = 36, series=("model",)) -> DataFrame:
    w = Window.partitionBy(*series).orderBy("yyyymm").rowsBetween(-(window - 1), 0)
    mean = F.when(F.count("ic").over(w) >= window // 2, F.avg("ic").over(w))
    out = ic.withColumn("rolling_ic", mean).where(F.col("rolling_ic").isNotNull())
    return out.select(*series, "yyyymm", decimal_year(F.col("yyyymm")).alias("year"), "rolling_ic")


def grouped_bars(df: DataFrame, index: str, columns: str, values: str, levels: list) -> DataFrame:
    return df.groupBy(index).pivot(columns, levels).agg(F.first(values))


def sharpe_by_bucket(table: DataFrame, models: list[str], bucket: str = "size_quintile",
                     scheme: str = "tilt") -> DataFrame:
    return grouped_bars(of_scheme(table, scheme).where(F.col("model").isin(models)), bucket, "model",
                        "sharpe_net", models)


def top_importance(importance: DataFrame, k: int = 25) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def rounded(df: DataFrame, digits: dict[str, int] = DIGITS, default: int | None = None
            ) -> DataFrame:
    """Round the table's floating columns for output."""
    out = {}
    for f in df.schema.fields:
        nd = digits.get(f.name, default)
        if nd is not None and f.dataType.typeName() in ("double", "float"):
            out[f.name] = F.round(F.col(f.name), nd)
    return df.withColumns(out) if out else df
