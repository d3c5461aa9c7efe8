import numpy as np
import pandas as pd

from panelyard.config import Costs, Portfolio
from panelyard.operators import accounting as A
from panelyard.operators.weights import allocate

from conftest import months_from

FREE = Costs(spread_bps=0, switch_bps=0, short_fee_bps_annual=0)


def ragged(seed=0, n=25, months=14):
    """Assets come and go; one month is missing altogether."""
    rng = np.random.default_rng(seed)
    rows = []
    for t, m in enumerate(months_from(199910, months)):
        if t == 5:
            continue
        for i in rng.choice(n, size=rng.integers(12, n), replace=False):
            rows.append(("m", m, f"A{i:03d}", rng.normal(), rng.normal(0, 0.05),
                         rng.uniform(0, 0.004)))
    return pd.DataFrame(rows, columns=["model", "yyyymm", "signalname", "score", "ret_next",
                                       "carry_cost"])


def by_hand(book, costs):
    """Month after month with series."""
    prev, out = pd.Series(dtype=float), []
    for m, g in book.groupby("yyyymm"):
        g = g.set_index("signalname")
        w, r = g["weight"], g["ret_next"].fillna(0)
        names = w.index.union(prev.index)
        move = (w.reindex(names).fillna(0) - prev.reindex(names).fillna(0)).abs().sum()
        out.append((m, (w * r).sum(), move, (g["carry_cost"] * w.abs()).sum(),
                    w[w < 0].abs().sum() * costs.short_fee_bps_annual / 1e4 / 12))
        prev = w * (1 + r) / (1 + (w * r).sum())
    return pd.DataFrame(out, columns=["formation_yyyymm", "gross", "turnover", "carrying", "borrow"])


def test_matches_month_by_month_loop(spark):
    df = spark.createDataFrame(ragged())
    for scheme in ("tilt", "neutral"):
        book = allocate(df, [scheme], Portfolio())
        want = by_hand(book.toPandas(), Costs())
        got = A.account(book, Costs()).toPandas().sort_values("formation_yyyymm")
        for c in want.columns:
            np.testing.assert_allclose(got[c], want[c], atol=1e-12)


def balanced(score=None, ret=0.03, seed=1, n=60, months=36):
    rng = np.random.default_rng(seed)
    m = months_from(200001, months)
    s = rng.normal(size=n * months) if score is None else np.full(n * months, score)
    carry = rng.uniform(0.0001, 0.002, n)
    return pd.DataFrame({"model": "m", "yyyymm": np.repeat(m, n),
                         "signalname": [f"A{i:03d}" for i in range(n)] * months, "score": s,
                         "ret_next": rng.normal(0, ret, n * months) if ret else 0.0,
                         "carry_cost": np.tile(carry, months)})


def run(spark, df, scheme="equal", costs=Costs(), **k):
    base = A.account(allocate(spark.createDataFrame(df), [scheme]), costs)
    return A.net_of_costs(base, **k)


def test_untouched_book_does_not_trade_without_returns(spark):
    got = run(spark, balanced(0.0, ret=0)).toPandas().sort_values("yyyymm")
    assert abs(got["turnover"].iloc[0] - 1) < 1e-12  # entry from cash
    assert got["turnover"].iloc[1:].max() < 1e-12
    assert (got["carrying"] > 0).all()  # holding still costs


def test_static_book_trades_only_drift(spark):
    got = run(spark, balanced(0.0)).toPandas().sort_values("yyyymm")
    assert got["turnover"].iloc[1:].max() < 0.1


def test_pnl_is_dated_to_the_next_month(spark):
    got = run(spark, balanced(0.0, months=3)).toPandas().sort_values("yyyymm")
    assert list(got["yyyymm"]) == [200002, 200003, 200004]
    dec = balanced(0.0, months=1).assign(yyyymm=199912)
    assert run(spark, dec).first()["yyyymm"] == 200001


def test_costs_scale_together_but_not_the_borrow_fee(spark):
    df = run(spark, balanced(), "neutral", multipliers=(0.0, 1.0, 2.0)).toPandas()
    by = df.groupby("cost_mult")
    assert np.isclose(by["cost"].sum()[0.0], by["borrow"].sum()[0.0])
    step = by["cost"].sum().diff().dropna()
    assert np.isclose(step.iloc[0], step.iloc[1])
    assert by["gross"].sum().nunique() == 1


def test_leverage_ignores_the_present(spark):
    df = balanced()
    base = run(spark, df, "tilt")
    late = df.copy()
    late.loc[late["yyyymm"] == late["yyyymm"].max(), "ret_next"] *= 10
    lev = [A.vol_target(b, 0.1).orderBy("yyyymm").toPandas()["leverage"]
           for b in (base, run(spark, late, "tilt"))]
    np.testing.assert_allclose(lev[0], lev[1])
    assert (lev[0].iloc[:12] == 1).all() and (lev[0] <= 3).all()


def test_free_costs_mean_net_is_gross(spark):
    df = run(spark, balanced().assign(carry_cost=0.0), "tilt", FREE).toPandas()
    np.testing.assert_allclose(df["net"], df["gross"])
