"""Linear scores under any objective: values and gradients for many coefficient vectors at once.

Fold, model and window are keys of one set of rows, so a single pass gives the gradient of every fold,
model and objective: the part of a training step that is as large as the data. What steps the
coefficients from there is not built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.config import Costs
from panelyard.operators.cross_section import measure
from panelyard.operators.folds import month_windows, window_rows
from panelyard.operators.objectives import cell_of, evaluate_objective, score_gradient
from panelyard.sources.store import materialise


def training_rows(panel: DataFrame, features: list[str], folds: DataFrame, length: int,
                  stride: int | None = None, role: str = "train", target: str = "ret_next_dm",
                  costs: Costs = Costs()) -> DataFrame:
    """(fold, window, pos, signalname, y, carry, switch, x): each fold's months of ``role`` in windows."""
    months = folds.where(F.col("role") == role).select("fold", "yyyymm")
    labels = [r["fold"] for r in months.select("fold").distinct().orderBy("fold").collect()]  # by calendar
    if not labels:
        raise ValueError(f"no fold has months of role {role!r}")
    windows = reduce(DataFrame.unionByName, [
        month_windows(months.where(F.col("fold") == f).select("yyyymm"), length, stride)
        .withColumn("fold", F.lit(f)) for f in labels])
    carry = (F.col("carry_cost") if "carry_cost" in panel.columns else F.lit(costs.spread_bps / 1e4))
    zero = F.lit(0.0)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), zero) for c in features])
    rows = panel.select("yyyymm", "signalname", F.coalesce(F.col(target), zero).alias("y"), carry.alias("carry"),
                        F.lit(2 * costs.switch_bps / 1e4).alias("switch"), x.alias("x"))
    return window_rows(rows, windows).drop("yyyymm")


def scored(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Rows once per coefficient vector of their fold (fold, model, beta), with ``model`` naming both.

    The coefficients are folds x models rows.
    """
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    both = rows.join(F.broadcast(coefficients.withColumnRenamed("model", "_m")), "fold")
    return both.withColumns({"score": dot, "model": F.concat_ws("/", "fold", "_m")}).drop("beta", "_m", "fold")


def linear_gradients(rows: DataFrame, features: list[str], coefficients: DataFrame, names, *,
                     row_limit: int | None = None, **options) -> DataFrame:
    """(fold, model, objective, feature, gradient): derivative of the mean window loss to each coefficient."""
    lit = materialise(scored(rows, coefficients), "scored")
    section = measure(lit, cell_of(lit))
    windows = lit.groupBy("model").agg(F.count_distinct("window").alias("_windows"))
    out = []
    for name in names:
        slopes = score_gradient(lit, name, section=section, row_limit=row_limit, **options)
        sums = slopes.groupBy("model").agg(*[
            F.sum(F.get("x", i) * F.col("ds")).alias(f"g{i}") for i in range(len(features))])
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"g{i}").alias("g"))
                                    for i, c in enumerate(features)]))
        out.append(sums.join(windows, "model").select("model", F.lit(name).alias("objective"),
                                                      pairs.alias("p"), "_windows"))
    place = F.split("model", "/", 2)
    return reduce(DataFrame.unionByName, out).select(
        F.get(place, 0).alias("fold"), F.get(place, 1).alias("model"), "objective", "p.feature",
        (F.col("p.g") / F.col("_windows")).alias("gradient"))


def linear_values(rows: DataFrame, coefficients: DataFrame, names, **options) -> DataFrame:
    """(fold, model, objective, loss, n_months) of each coefficient vector."""
    lit = materialise(scored(rows, coefficients), "scored")
    place = F.split("model", "/", 2)
    return reduce(DataFrame.unionByName, [
        evaluate_objective(lit, name, **options).withColumn("objective", F.lit(name)) for name in names]).select(
        F.get(place, 0).alias("fold"), F.get(place, 1).alias("model"), "objective", "loss", "n_months")
