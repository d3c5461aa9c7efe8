"""From scores to weights, month by month.

Every scheme reads the same per-month rank, so any set of schemes costs one
ranking. Output is a long book: one row per (series, scheme, month, asset).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.config import Portfolio
from panelyard.operators.cross_section import Section, measure, rank_within, with_group_aggs
from panelyard.operators.universe import require_columns
from panelyard.sources.store import attach, materialise

SCHEMES = ("equal", "tilt", "neutral", "quantile", "simplex")
DEEPEST = 2000  # most leading weights of a month held in one row
MOST_PASSES = 50  # fixed value: the rule stops after this many rounds
CAPPED = ("tilt", "quantile")  # 1/N never exceeds a feasible cap
BENCHMARK = "equal_weight"


def _weight(scheme: str, pc: Portfolio) -> Column:
    n, dev, l1 = F.col("_n"), F.col("_dev"), F.col("_l1")
    equal = 1.0 / n
    flat = (n < 2) | (l1 == 0)
    if scheme == "equal":
        return equal
    if scheme == "tilt":
        return F.when(flat, equal).otherwise(equal + F.try_divide(pc.tilt_gross * dev, l1))
    if scheme == "neutral":
        return F.when(flat, 0.0).otherwise(F.try_divide(2.0 * pc.gross_leverage * dev, l1))
    if scheme == "quantile":
        q = pc.n_quantiles
        chosen = n - F.floor(n * (q - 1) / q)
        return (F.when(n < q, equal)
                .when(F.col("_ord") * q > n * (q - 1), 1.0 / chosen).otherwise(0.0))
    return F.col("_e") / F.col("_z")


def allocate(predictions: DataFrame, schemes, pc: Portfolio = Portfolio(), *,
             series: tuple[str, ...] = ("model",), benchmark_of: str | None = None,
             section: Section | None = None, row_limit: int | None = None) -> DataFrame:
    """Uncapped weights of each scheme.

    ``benchmark_of`` adds the 1/N book under the model name ``equal_weight``, built
    on the universe of that model.
    """
    unknown = sorted(set(schemes) - set(SCHEMES))
    if unknown:
        raise ValueError(f"unknown schemes {unknown}; have {sorted(SCHEMES)}")
    require_columns(predictions, [*series, "yyyymm", "signalname", "score", "ret_next"])
    keys = [*series, "yyyymm"]
    section = section or measure(predictions, keys)
    ranked_by = {"tilt", "neutral"} & set(schemes)
    df = rank_within(predictions, keys, "score", tie="signalname", section=section, size="_n",
                     average="_avg" if ranked_by else None,
                     ordinal="_ord" if "quantile" in schemes else None, row_limit=row_limit)
    if ranked_by:
        df = df.withColumn("_dev", F.col("_avg") - (F.col("_n") + 1) / 2.0)
        df = with_group_aggs(df, keys, section, row_limit, cheap=False,
                             _l1=F.sum(F.abs("_dev")))
    if "simplex" in schemes:
        df = with_group_aggs(df, keys, section, row_limit, _top=F.max("score"))
        heat = max(pc.temperature, 1e-8)
        df = df.withColumn("_e", F.exp((F.col("score") - F.col("_top")) / heat))
        df = with_group_aggs(df, keys, section, row_limit, _z=F.sum("_e"))

    def entry(model, scheme):
        return F.struct(model.alias("model"), F.lit(scheme).alias("scheme"),
                        _weight(scheme, pc).alias("weight"))

    model = F.col("model") if "model" in df.columns else F.lit("")
    books = [entry(model, s) for s in schemes]
    if benchmark_of is not None:
        books.append(F.when(model == benchmark_of, entry(F.lit(BENCHMARK), "equal")))
    carried = [c for c in ("ret_next", "carry_cost", "turnover_raw") if c in df.columns]
    others = [c for c in series if c != "model"]
    return (df.withColumn("_b", F.explode(F.array_compact(F.array(*books))))
            .select(*others, "_b.model", "_b.scheme", "yyyymm", "signalname", "_b.weight",
                    F.col("_n").alias("n"), *carried))


def cap_weights(book: DataFrame, cap: float, *, keys=("model", "scheme", "yyyymm"),
                schemes: tuple[str, ...] | None = CAPPED) -> DataFrame:
    """Hold every weight at or below ``cap`` and keep each month's total.

    Names over the cap are fixed there and the others scaled to the remaining
    budget, until no scaled name is over. The result is one scale per month: a name
    whose scaled weight exceeds the cap sits at the cap, any other takes its scaled
    weight. At most budget/cap names can sit at the cap, so the scale needs only the
    few largest weights of a month and the sum of the rest; the top rows are limited
    before the shuffle. Months whose cap is infeasible are left alone, and where the
    scaling would leave nothing to scale, the names over the cap stay at it.
    """
    keys = list(keys)
    if cap <= 0:
        raise ValueError("cap must be positive")
    w = F.col("weight")
    over = cap + 1e-12
    chosen = book if schemes is None else book.where(F.col("scheme").isin(*schemes))
    months = chosen.groupBy(*keys).agg(
        F.sum(w).alias("_budget"), F.max(w).alias("_max"), F.count(w).alias("_names"))
    binding = months.where((F.col("_max") > over) & (F.col("_names") * cap > F.col("_budget") + 1e-9))
    extent = binding.agg(F.max("_budget").alias("b"), F.count(F.lit(1)).alias("g")).first()
    if not extent["g"]:
        return book

    depth = max(1, math.ceil(extent["b"] / cap)) + 1
    rows = chosen.select(*keys, "signalname", "weight")
    if depth > DEEPEST:
        scales = _scales_by_passes(rows, binding, keys, cap, over, extent["g"])
    else:
        scales = _scales_from_tops(rows, binding, keys, cap, over, extent["g"], depth)
    scaled = w * F.col("_scale")
    return (attach(book, scales, keys, extent["g"])
            .withColumn("weight", F.when(F.col("_scale").isNull(), w)
                        .when(scaled > over, F.lit(float(cap))).otherwise(scaled))
            .drop("_scale"))


def _scales_from_tops(rows, binding, keys, cap, over, groups, depth) -> DataFrame:
    """Scale per month from its ``depth`` largest weights and the sum below them."""
    w = F.col("weight")
    rows = attach(rows, binding, keys, groups, how="inner")
    largest_first = Window.partitionBy(*keys).orderBy(F.desc("weight"))
    tops = (rows.withColumn("_k", F.row_number().over(largest_first))
            .where(F.col("_k") <= depth).groupBy(*keys)
            .agg(F.sort_array(F.collect_list("weight"), asc=False).alias("_top")))
    least = F.element_at("_top", -1)
    wide = None if groups is None else groups * (depth + 1)  # a broadcast holds the arrays
    tail = (attach(rows, tops, keys, wide, how="inner").groupBy(*keys).agg(
        F.first("_budget").alias("_budget"), F.first("_top").alias("_top"),
        F.coalesce(F.sum(F.when(w < least, w)), F.lit(0.0)).alias("_below"),
        F.sum((w == least).cast("long")).alias("_same")))
    inside = F.size(F.filter("_top", lambda x: x == least))
    tail = tail.withColumn("_rest", F.col("_below") + (F.col("_same") - inside) * least)

    def step(s, _):
        k = F.size(F.filter(F.col("_top"), lambda x: x * s["c"] > over))
        free = F.col("_rest") + F.aggregate(
            F.slice(F.col("_top"), k + 1, F.size("_top")), F.lit(0.0), lambda a, x: a + x)
        left = F.col("_budget") - k * cap
        stop = s["done"] | (k == s["k"]) | (free <= 0) | (left <= 0)
        return F.struct(F.when(stop, s["k"]).otherwise(k).alias("k"),
                        F.when(stop, s["c"]).otherwise(F.try_divide(left, free)).alias("c"),
                        stop.alias("done"))

    start = F.struct(F.lit(0).alias("k"), F.lit(1.0).alias("c"), F.lit(False).alias("done"))
    passes = F.array_repeat(F.lit(0), min(depth + 1, MOST_PASSES))
    return tail.select(*keys, F.aggregate(passes, start, step)["c"].alias("_scale"))


def _scales_by_passes(rows, binding, keys, cap, over, groups) -> DataFrame:
    """Same scale when very many names can sit at the cap: one aggregate per pass."""
    w = F.col("weight")
    state = materialise(binding.select(
        *keys, "_budget", F.lit(0).cast("long").alias("_k"), F.lit(1.0).alias("_c"),
        F.lit(False).alias("_done")), "cap")
    for _ in range(MOST_PASSES):
        hit = w * F.col("_c") > over
        seen = attach(rows, state.where(~F.col("_done")), keys, groups, how="inner")
        seen = seen.groupBy(*keys).agg(
            F.count(F.when(hit, 1)).alias("_hits"),
            F.coalesce(F.sum(F.when(~hit, w)), F.lit(0.0)).alias("_free"))
        left = F.col("_budget") - F.col("_hits") * cap
        stop = F.col("_done") | (F.col("_hits") == F.col("_k")) | (F.col("_free") <= 0) | (left <= 0)
        state = materialise(attach(state, seen, keys, groups).select(
            *keys, "_budget", F.when(stop, F.col("_k")).otherwise(F.col("_hits")).alias("_k"),
            F.when(stop, F.col("_c")).otherwise(F.try_divide(left, F.col("_free"))).alias("_c"),
            stop.alias("_done")), "cap")
        if state.where(~F.col("_done")).isEmpty():
            break
    return state.select(*keys, F.col("_c").alias("_scale"))
