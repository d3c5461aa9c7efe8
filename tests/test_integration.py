"""Raw returns to tables on a small panel with a known answer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.config import Costs, Portfolio, Settings, Split, Universe
from panelyard.operators import learners, transforms
from panelyard.operators.universe import feature_columns
from panelyard.plans import tables
from panelyard.plans.panel import build_panel
from panelyard.plans.walk_forward import run_walk_forward

from conftest import months_from, planted_panel

SETTINGS = Settings(
    split=Split(train_start=200001, first_test_year=2003, val_years=1, embargo_months=3,
                min_train_months=12, min_val_months=12),
    portfolio=Portfolio(max_weight=0.5, vol_target=None),
    costs=Costs(short_fee_bps_annual=0.0), universe=Universe(min_assets=2))
SPECS = [learners.ModelSpec(n) for n in ("ridge", "pls")]


def run(spark, ic, seed):
    df = planted_panel(n_months=84, n_assets=40, ic=ic, seed=seed)
    panel = spark.createDataFrame(df)
    built, names = transforms.build_features(panel, ["f00", "f01", "f02", "f03"])
    preds, _, _ = run_walk_forward(built.cache(), names, SETTINGS, SPECS)
    return preds.cache()


def test_planted_signal_is_found(spark):
    preds = run(spark, 0.25, 1)
    stats = tables.statistical_table(preds).toPandas()
    assert (stats["ic_t"] > 1.5).all() and (stats["ic_mean"] > 0.1).all()
    book = tables.weight_book(preds, SETTINGS, benchmark_of="ridge")
    monthly = tables.monthly_results(book, SETTINGS, multipliers=(0.0, 1.0, 4.0)).cache()
    base = monthly.where(F.col("cost_mult") == 1.0)
    econ = tables.economic_table(base).toPandas().set_index("model")
    assert set(econ.index) == {"equal_weight", "ridge", "pls"}
    assert (econ["n_months"] == 48).all()
    assert (econ["ret_net"] < econ["ret_gross"]).all()
    assert econ.loc["ridge", "sharpe_gross"] > econ.loc["equal_weight", "sharpe_gross"]
    assert econ.loc["equal_weight", "turnover"] < econ.loc["ridge", "turnover"]
    swept = tables.cost_sensitivity(monthly).toPandas().sort_values("cost_mult")
    for _, g in swept.groupby("model"):
        assert g["sharpe_net"].is_monotonic_decreasing
    assert tables.best_model(tables.economic_table(base)) in ("ridge", "pls")


def test_noise_is_not(spark):
    stats = tables.statistical_table(run(spark, 0.0, 99)).toPandas()
    assert (stats["ic_t"].abs() < 3).all()


@pytest.fixture(scope="module")
def built(spark):
    rng = np.random.default_rng(0)
    months = months_from(199801, 60)
    rows = [(f"s{i}", m, rng.normal(0, 0.03)) for i in range(8) for m in months
            if not (i == 3 and m == 200105)]
    returns = spark.createDataFrame(rows, "signalname string, yyyymm int, ret double")
    doc = spark.createDataFrame(
        [(f"s{i}", 1998.0 + i % 2 if i else None, 1970.0, 1990.0, 3.0, 0.5, 6.0 if i == 1 else None,
          10.0, "VW" if i % 2 else "EW", "value", "price", "cont") for i in range(8)],
        "signalname string, pub_year double, sample_start_year double, sample_end_year double, "
        "orig_tstat double, orig_ret double, holding_months double, ls_quantile double, "
        "stock_weight string, cat_economic string, cat_data string, cat_form string")
    panel = build_panel(returns, doc, None, SETTINGS, flat_turnover=0.6)
    return panel.cache(), pd.DataFrame(rows, columns=["signalname", "yyyymm", "ret"])


def test_panel_starts_after_publication(built):
    first = built[0].groupBy("signalname").agg(F.min("yyyymm").alias("m")).collect()
    first = {r["signalname"]: r["m"] for r in first}
    assert "s0" not in first  # no publication year
    assert first["s2"] == 199901 and first["s1"] == 200001


def test_a_gap_never_shifts_the_target(built):
    panel, raw = built
    got = panel.where("signalname = 's3'").toPandas().set_index("yyyymm")
    mine = raw[raw["signalname"] == "s3"].set_index("yyyymm")["ret"]
    assert 200104 not in got.index and 200105 not in got.index
    assert got.loc[200103, "ret_next"] == mine[200104]
    assert 200212 not in got.index  # nothing follows the last month


def test_trailing_features_match_pandas(built):
    panel, raw = built
    got = panel.where("signalname = 's5'").toPandas().set_index("yyyymm").sort_index()
    r = raw[(raw["signalname"] == "s5") & (raw["yyyymm"] >= 200001)].set_index("yyyymm")["ret"]
    lr = np.log1p(r)
    want = pd.DataFrame({
        "r_12": np.exp(lr.rolling(12).sum()) - 1,
        "r_12_2": np.exp(lr.rolling(12).sum() - lr) - 1,
        "vol_36": r.rolling(36, min_periods=18).std(),
        "dd_60": lr.cumsum() - lr.cumsum().rolling(60, min_periods=12).max()})
    for c in want:
        np.testing.assert_allclose(got[c], want.loc[got.index, c], atol=1e-12)


def test_costs_and_layout(built):
    panel, _ = built
    row = panel.where("signalname = 's1'").first()
    assert abs(row["turnover_raw"] - 0.1) < 1e-12 and abs(row["switch_cost"] - 0.005) < 1e-15
    assert panel.columns[:2] == ["signalname", "yyyymm"]
    names = feature_columns(panel)
    assert names == sorted(names) and panel.columns[-len(names):] == names
    assert {"cat_economic_value", "yrs_since_pub", "is_value_weighted"} <= set(names)
    assert not {"pub_year", "stock_weight", "cat_data"} & set(panel.columns)
    means = panel.groupBy("yyyymm").agg(F.avg("ret_next_dm").alias("m")).toPandas()["m"]
    assert means.abs().max() < 1e-12
