import numpy as np
import pandas as pd
import pytest

from panelyard.config import Split
from panelyard.operators import objectives as O
from panelyard.operators.folds import distinct_months, walk_forward_folds
from panelyard.operators.objective_fit import linear_gradients, linear_values, training_rows

from conftest import planted_panel


def batch(T=8, N=14, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    carry = rng.uniform(5e-5, 4e-3, N)
    for w in (0, 1):
        for t in range(1, T + 1):
            for i in range(N):
                if rng.random() < 0.85:
                    rows.append((w, t, f"A{i:02d}", rng.normal(), rng.normal(0, 0.04), carry[i],
                                 0.005))
    return pd.DataFrame(rows, columns=["window", "pos", "signalname", "score", "y", "carry",
                                       "switch"])


def loss(spark, df, name, **k):
    got = O.objective_by_window(spark.createDataFrame(df), name, **k)
    return {r["window"]: r["loss"] for r in got.collect()}


@pytest.mark.parametrize("name", ["ic", "sharpe", "utility"])
def test_invariant_to_scale_and_shift(spark, name):
    df = batch()
    a, b = loss(spark, df, name), loss(spark, df.assign(score=7 * df["score"] + 3), name)
    for w in a:
        assert abs(a[w] - b[w]) < 1e-9


def test_costs_only_hurt(spark):
    df = batch()
    values = [loss(spark, df.assign(carry=df["carry"] * m, switch=df["switch"] * m), "utility")[0]
              for m in (0, 1, 3)]
    assert values[0] < values[1] < values[2]
    penal = loss(spark, df, "sharpe", turnover_penalty=0.01)
    assert penal[0] > loss(spark, df, "sharpe")[0]


def test_cheap_assets_are_preferred(spark):
    df = batch()
    cheap, dear = df.assign(score=-df["carry"]), df.assign(score=df["carry"])
    flat = {"y": 0.0}
    assert (loss(spark, cheap.assign(**flat), "utility")[0]
            < loss(spark, dear.assign(**flat), "utility")[0])


def test_paths_for_narrow_and_wide_months_agree(spark):
    df = batch()
    for name in O.NAMES:
        a, b = loss(spark, df, name), loss(spark, df, name, row_limit=2)
        for w in a:
            assert abs(a[w] - b[w]) < 1e-10


def test_evaluate_weights_windows_by_months(spark):
    df = batch()
    df = df[(df["window"] == 0) | (df["pos"] <= 3)]
    per = loss(spark, df, "mse")
    row = O.evaluate_objective(spark.createDataFrame(df), "mse").first()
    assert abs(row["loss"] - (8 * per[0] + 3 * per[1]) / 11) < 1e-12


@pytest.mark.parametrize("name", O.NAMES)
@pytest.mark.parametrize("limit", [None, 3])
def test_gradient_matches_finite_differences(spark, name, limit):
    df = batch(T=5, N=9, seed=2)
    got = O.score_gradient(spark.createDataFrame(df), name, row_limit=limit).toPandas()
    got = got.sort_values(["window", "pos", "signalname"]).reset_index(drop=True)
    df = df.sort_values(["window", "pos", "signalname"]).reset_index(drop=True)
    picks = [0, 7, len(df) // 2, len(df) - 3]
    eps = 1e-5
    bumped = []
    for j, i in enumerate(picks):
        for sign in (-1, 1):
            b = df[df["window"] == df.loc[i, "window"]].copy()
            b.loc[i, "score"] += sign * eps
            bumped.append(b.assign(window=2 * j + (sign > 0)))
    values = loss(spark, pd.concat(bumped), name)
    for j, i in enumerate(picks):
        slope = (values[2 * j + 1] - values[2 * j]) / (2 * eps)
        assert abs(slope - got.loc[i, "ds"]) < 1e-5 * max(1, abs(slope)), (name, i)


def test_linear_gradients_of_all_folds(spark):
    """Against finite differences of the values, fold by fold; the planted feature has the steepest slope."""
    panel = spark.createDataFrame(planted_panel(n_months=48, n_assets=20, n_features=3, ic=0.5))
    split = Split(train_start=200001, first_test_year=2002, val_years=1, embargo_months=0,
                  min_train_months=12, min_val_months=12)
    folds = walk_forward_folds(distinct_months(panel), split)
    features, labels = ["f00", "f01", "f02"], [r["fold"] for r in folds.select("fold").distinct().collect()]
    assert len(labels) == 2
    rows = training_rows(panel, features, folds, 12)
    base, eps = np.array([0.2, -0.1, 0.3]), 1e-5
    schema = "fold string, model string, beta array<double>"
    names = ("ic", "sharpe", "utility")
    got = linear_gradients(rows, features, spark.createDataFrame(
        [(f, "b", base.tolist()) for f in labels], schema), names, turnover_penalty=0.01).toPandas()
    near = [(f, f"{i}{s:+d}", (base + s * eps * np.eye(3)[i]).tolist())
            for f in labels for i in range(3) for s in (-1, 1)]
    values = linear_values(training_rows(panel, features, folds, 12, 12), spark.createDataFrame(near, schema),
                           names, turnover_penalty=0.01).toPandas()
    assert len(got) == 18 and len(values) == 36
    # Windows of twelve months from twelve: the mean over windows is the mean by months.
    for f in labels[:1]:
        same = values[values["fold"] == f].set_index(["objective", "model"])["loss"]
        mine = got[got["fold"] == f].set_index(["objective", "feature"])["gradient"]
        if f.startswith("2002"):
            for name in names:
                for i, c in enumerate(features):
                    slope = (same[name, f"{i}+1"] - same[name, f"{i}-1"]) / (2 * eps)
                    assert abs(slope - mine[name, c]) < 1e-4 * max(1, abs(slope)), (name, c)
    flat = got[got["objective"] == "ic"].pivot(index="fold", columns="feature", values="gradient")
    assert (flat["f00"] < 0).all()
