import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelyard.operators import inference as I
from panelyard.plans import tables

from conftest import months_from


def series(seed=0, n=90, name="m"):
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.02, n + 1)
    net = e[1:] + 0.4 * e[:-1] + 0.004
    return pd.DataFrame({"model": name, "scheme": "tilt", "yyyymm": months_from(200001, n),
                         "net": net, "gross": net + 0.002, "cost": 0.002,
                         "turnover": rng.uniform(0.1, 0.5, n)})


def nw(x, lags=None):
    n = len(x)
    lags = int(np.floor(4 * (n / 100) ** (2 / 9))) if lags is None else lags
    e = x - x.mean()
    var = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n
                          for k in range(1, lags + 1))
    return x.mean() / math.sqrt(max(var, 1e-18) / n)


def test_newey_west(spark):
    df = pd.concat([series(1, 90, "a"), series(2, 250, "b"), series(3, 2, "c")])
    got = {r["model"]: r["t"] for r in
           I.newey_west(spark.createDataFrame(df), ["model"], "yyyymm", "net").collect()}
    for m in "ab":
        assert abs(got[m] - nw(df.loc[df["model"] == m, "net"].to_numpy())) < 1e-9
    assert got["c"] is None


def test_performance_summary(spark):
    df = series()
    row = I.performance_summary(spark.createDataFrame(df)).first()
    x = df["net"].to_numpy()
    sd = x.std(ddof=1)
    eq = np.cumprod(1 + x)
    assert abs(row["sharpe_net"] - x.mean() / sd * math.sqrt(12)) < 1e-10
    assert abs(row["max_dd"] - (eq / np.maximum.accumulate(eq) - 1).min()) < 1e-12
    z = (x - x.mean()) / x.std()
    sr, g3, g4 = x.mean() / sd, (z ** 3).mean(), (z ** 4).mean()
    se = math.sqrt((1 + .5 * sr ** 2 - g3 * sr + (g4 - 3) / 4 * sr ** 2) / len(x) * 12)
    assert abs(row["sharpe_net_se"] - se) < 1e-10 and abs(row["skew"] - g3) < 1e-10
    assert abs(row["breakeven_bps"] - df["gross"].mean() / df["turnover"].mean() * 1e4) < 1e-8


def test_constant_returns_have_no_sharpe(spark):
    df = series().assign(net=0.0, gross=0.0, turnover=0.0)
    row = I.performance_summary(spark.createDataFrame(df)).first()
    assert row["sharpe_net"] is None and row["sharpe_net_se"] is None
    assert row["breakeven_bps"] is None and row["max_dd"] == 0


def test_a_first_month_loss_is_no_drawdown(spark):
    df = series(n=3).assign(net=[-0.5, 0.1, 0.1])
    assert I.performance_summary(spark.createDataFrame(df)).first()["max_dd"] == 0


def test_subperiods(spark):
    df = series(n=60)
    got = I.subperiod_table(spark.createDataFrame(df), (200201, 200407)).toPandas()
    got = got.set_index("period")
    assert dict(got["n_months"]) == {"2000-2002": 24, "2002-2004": 30}  # six months drop out
    part = df.loc[df["yyyymm"] < 200201, "net"].to_numpy()
    assert abs(got.loc["2000-2002", "t_net"] - nw(part)) < 1e-9


def test_factor_regression(spark):
    rng = np.random.default_rng(4)
    df = series(n=120)
    f = pd.DataFrame(rng.normal(0, 0.03, (120, 2)), columns=["mktrf", "smb"])
    f.insert(0, "yyyymm", df["yyyymm"])
    df["net"] += 0.5 * f["mktrf"]
    got = I.factor_regression(spark.createDataFrame(df), spark.createDataFrame(f)).toPandas()
    got = got.set_index("term")
    x = np.column_stack([np.ones(120), f[["mktrf", "smb"]]])
    y = df["net"].to_numpy()
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    u = x * (y - x @ b)[:, None]
    s = u.T @ u
    for k in range(1, 7):
        g = u[k:].T @ u[:-k]
        s += (1 - k / 7) * (g + g.T)
    t = b / np.sqrt(np.diag(inv @ s @ inv))
    np.testing.assert_allclose(got.loc[["const", "mktrf", "smb"], "t"], t)
    assert abs(got.loc["const", "coef"] - 12 * b[0]) < 1e-12
    assert got["n"].iloc[0] == 120 and (got["p"].between(0, 1)).all()
    # One regressor: the lag-window form agrees with the matrix form.
    bench = pd.DataFrame({"model": "equal_weight", "scheme": "equal", "yyyymm": df["yyyymm"],
                          "net": f["mktrf"], "gross": 0.0, "cost": 0.0, "turnover": 0.0})
    row = I.alpha_vs_benchmark(spark.createDataFrame(pd.concat([df, bench]))).first()
    one = I.factor_regression(spark.createDataFrame(df), spark.createDataFrame(f), cols=["mktrf"])
    one = one.toPandas().set_index("term")
    assert abs(row["alpha_t"] - one.loc["const", "t"]) < 1e-8
    assert abs(row["beta_bench"] - one.loc["mktrf", "coef"]) < 1e-10
    assert abs(row["r2"] - one["r2"].iloc[0]) < 1e-10
    assert abs(row["t_active"] - nw((df["net"] - f["mktrf"]).to_numpy())) < 1e-8


def test_spearman_p_value(spark):
    df = spark.createDataFrame([(0.5, 10), (-0.8, 6), (1.0, 5)], "rho double, n long")
    got = [r[0] for r in df.select(tables.spearman_p(F.col("rho"), F.col("n"))).collect()]
    # Known values of the t distribution with 8 and 4 degrees of freedom.
    np.testing.assert_allclose(got, [0.14111, 0.05606, 0.0], atol=2e-4)


def test_rank_agreement_and_common_months(spark):
    t = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 2.0), ("c", 3.0, 1.0)],
                              "model string, x double, y double")
    assert abs(tables.rank_agreement(t, "x", "y").first()["rho"] + 1) < 1e-12
    m = spark.createDataFrame([("u", 1), ("u", 2), ("v", 2), ("v", 3)], "universe string, yyyymm int")
    assert {r["yyyymm"] for r in tables.common_months(m).collect()} == {2}


def test_rounded_tables_and_top_rows(spark):
    df = spark.createDataFrame([("a", 1.23456), ("b", 2.0)], "feature string, vol double")
    assert tables.rounded(df).first()["vol"] == 1.2346
    imp = df.withColumnRenamed("vol", "importance")
    assert tables.top_importance(imp, 1).first()["feature"] == "b"


def test_ic_is_the_same_through_cells(spark):
    rng = np.random.default_rng(8)
    df = pd.DataFrame({"model": "m", "yyyymm": np.repeat(months_from(200001, 5), 80),
                       "signalname": [f"A{i:03d}" for i in range(80)] * 5,
                       "score": rng.integers(0, 9, 400).astype(float),
                       "ret_next": rng.normal(size=400)})
    table = spark.createDataFrame(df)
    want = df.groupby("yyyymm")[["score", "ret_next"]].apply(
        lambda g: g["score"].rank().corr(g["ret_next"].rank()))
    for limit in (None, 10):
        got = I.monthly_ic(table, row_limit=limit).toPandas().set_index("yyyymm")["ic"]
        np.testing.assert_allclose(got.sort_index(), want)


def test_cost_quintiles_match_equal_frequency_cuts(spark):
    """Month n holds n assets, for every n a cross-section may have."""
    rng = np.random.default_rng(9)
    parts = []
    for n in range(5, 70):
        parts.append(pd.DataFrame({"yyyymm": n, "signalname": [f"A{i:03d}" for i in range(n)],
                                   "weight": rng.normal(size=n), "n": n,
                                   "turnover_raw": rng.permutation(n).astype(float)}))
    df = pd.concat(parts)
    cut = df.groupby("yyyymm")["turnover_raw"].transform(
        lambda s: pd.qcut(s.rank(method="first"), 5, labels=False) + 1)
    want = df.assign(q=cut, tilt=df["weight"] - 1 / df["n"]).groupby("q").agg(
        n=("tilt", "size"), tilt=("tilt", "mean"))
    book = spark.createDataFrame(df.assign(model="m", scheme="tilt"))
    for limit in (None, 10):
        got = tables.tilt_by_cost_quintile(book, "m", row_limit=limit).toPandas()
        got = got.set_index("cost_quintile").sort_index()
        assert list(got["n"]) == list(want["n"])
        np.testing.assert_allclose(got["mean_tilt"], want["tilt"])
