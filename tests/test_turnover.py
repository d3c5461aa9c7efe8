import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelyard.config import Costs
from panelyard.operators import turnover as T

from conftest import months_from


def signal_table(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for m in months_from(199911, 8):
        if m == 200003:  # a month nobody measured
            continue
        for p in rng.choice(90, size=70 if m != 200005 else 15, replace=False):
            rows.append((int(p), m, float(rng.integers(0, 25)), rng.normal() if p % 3 else None))
    return pd.DataFrame(rows, columns=["permno", "yyyymm", "s1", "s2"])


def brute_force(df, col, q=10):
    """Month after month with dictionaries."""
    out, prev = {}, None
    for m, g in df.dropna(subset=[col]).groupby("yyyymm"):
        g = g.sort_values([col, "permno"])
        n = len(g)
        if n < 2 * q:
            continue
        u = (np.arange(n) + 1) / n
        k = np.arange(n) + 1
        side = np.where(k * q > n * (q - 1), 1.0, np.where(k * q <= n, -1.0, 0.0))
        w = dict(zip(g["permno"], side / max(np.abs(side).sum(), 1) * 2))
        u = dict(zip(g["permno"], u))
        mi = m // 100 * 12 + m % 100
        if prev and prev[0] == mi - 1:
            turn = sum(abs(w.get(p, 0) - prev[1].get(p, 0)) for p in set(w) | set(prev[1]))
            common = sorted(set(u) & set(prev[2]))
            corr = (np.corrcoef([u[p] for p in common], [prev[2][p] for p in common])[0, 1]
                    if len(common) > 30 else None)
            out[m] = (turn, corr)
        prev = (mi, w, u)
    return out


def test_series_matches_brute_force(spark):
    df = signal_table()
    firms = spark.createDataFrame(df.astype({"s2": "float64"})).replace(float("nan"), None)
    for limit in (None, 12):
        book = T.decile_book(T.unpivot_signals(firms, ["s1", "s2"]), row_limit=limit)
        got = T.turnover_series(book).collect()
        for col in ("s1", "s2"):
            want = brute_force(df, col)
            mine = {r["yyyymm"]: r for r in got if r["signalname"] == col}
            assert set(mine) == set(want)
            for m, (turn, corr) in want.items():
                assert abs(mine[m]["turnover"] - turn) < 1e-12
                if corr is None:
                    assert mine[m]["rank_autocorr"] is None
                else:
                    assert abs(mine[m]["rank_autocorr"] - corr) < 1e-12


def test_measured_turnover_needs_no_book(spark):
    """Wide months beside each other give what the books give, in one exchange of the wide rows."""
    df = signal_table()
    df.loc[df["permno"] == 7, "s1"] = np.inf        # not finite: missing
    firms = spark.createDataFrame(df.astype({"s2": "float64"})).replace(float("nan"), None)
    unnamed = firms.withColumn("permno", F.when(F.col("permno") != 9, F.col("permno")))
    for table in (firms, unnamed, firms.withColumn("permno", F.col("permno").cast("string"))):
        whole = T.measured_turnover(table, ["s1", "s2"])
        text = whole._jdf.queryExecution().toString()
        assert "Window" not in text
        series = T.turnover_series(T.decile_book(T.unpivot_signals(table, ["s1", "s2"])))
        booked = T.measured_turnover(table, ["s1", "s2"], row_limit=12)
        want = {(r["signalname"], r["yyyymm"]): r for r in series.collect()}
        assert whole.dtypes == series.dtypes
        for got in (whole.collect(), booked.collect()):
            assert {(r["signalname"], r["yyyymm"]) for r in got} == set(want) and len(got) == len(want)
            for r in got:
                other = want[r["signalname"], r["yyyymm"]]
                assert abs(r["turnover"] - other["turnover"]) < 1e-12
                assert (r["rank_autocorr"] is None) == (other["rank_autocorr"] is None)
                assert r["rank_autocorr"] is None or abs(r["rank_autocorr"] - other["rank_autocorr"]) < 1e-12


def test_causal_turnover_never_sees_its_own_month(spark):
    months = months_from(200001, 30)
    df = spark.createDataFrame([("s", m, float(i)) for i, m in enumerate(months)],
                               "signalname string, yyyymm int, turnover double")
    got = [r["turnover_causal"] for r in T.causal_turnover(df).orderBy("yyyymm").collect()]
    assert got[:24] == [None] * 24
    assert got[24] == np.mean(range(24)) and got[29] == np.mean(range(29))


def test_costs_fill_forward_then_fall_back(spark):
    panel = spark.createDataFrame(
        [("a", 200001, None), ("a", 200002, 6.0), ("a", 200003, 6.0), ("b", 200001, 1.0)],
        "signalname string, yyyymm int, holding_months double")
    causal = spark.createDataFrame([("a", 200002, 0.6), ("b", 200001, 0.2)],
                                   "signalname string, yyyymm int, turnover_causal double")
    got = {(r["signalname"], r["yyyymm"]): r for r in
           T.attach_costs(panel, causal, Costs()).collect()}
    # Pooled median of the filled values 0.6, 0.6, 0.2.
    assert got["a", 200001]["turnover_raw"] == 0.6
    assert abs(got["a", 200003]["turnover_raw"] - 0.1) < 1e-12
    assert abs(got["b", 200001]["carry_cost"] - 0.2 * 25 / 1e4) < 1e-15
    flat = T.attach_costs(panel, None, flat_turnover=0.3).first()
    assert flat["turnover_raw"] == 0.3


def test_fallback_median_comes_from_counts_of_few_values(spark):
    """With a bound on the series no row of the panel is gathered for its median."""
    months = months_from(200001, 12)
    panel = spark.createDataFrame([(f"a{i}", m, 1.0) for i in range(9) for m in months],
                                  "signalname string, yyyymm int, holding_months double")
    causal = spark.createDataFrame(
        [(f"a{i}", m, (i * j % 7) / 8) for i in range(6) for j, m in enumerate(months) if (i + j) % 3],
        "signalname string, yyyymm int, turnover_causal double")
    for fallback in ("pooled", "month"):
        a, b = (T.attach_costs(panel, causal, Costs(), fallback=fallback, causal_rows=n) for n in (72, None))
        assert "row_number" in b._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in a._jdf.queryExecution().optimizedPlan().toString()
        a, b = (sorted((r["signalname"], r["yyyymm"], r["turnover_raw"]) for r in v.collect()) for v in (a, b))
        assert a == b and None not in {r[2] for r in a if fallback == "pooled"}
