import numpy as np
import pandas as pd
import pytest

from panelyard.config import Portfolio
from panelyard.operators import weights as W

from conftest import months_from


def predictions(n_months=4, n=30, seed=0, model="m"):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "model": model, "yyyymm": np.repeat(months_from(200001, n_months), n),
        "signalname": [f"A{i:03d}" for i in range(n)] * n_months,
        "score": rng.normal(size=n * n_months), "ret_next": rng.normal(0, 0.03, n * n_months)})


def sums(book, f="sum"):
    return book.groupby(["scheme", "yyyymm"])["weight"].agg(f)


def test_budgets_and_shapes(spark):
    df = spark.createDataFrame(predictions(n=100))
    book = W.allocate(df, W.SCHEMES, Portfolio()).toPandas()
    total, size = sums(book), book.assign(weight=book["weight"].abs())
    for s, want in (("equal", 1), ("tilt", 1), ("quantile", 1), ("simplex", 1), ("neutral", 0)):
        np.testing.assert_allclose(total[s], want, atol=1e-12)
    tilt = size.assign(weight=(book["weight"] - 0.01).abs())
    np.testing.assert_allclose(sums(tilt)["tilt"], 1.0)
    np.testing.assert_allclose(sums(size)["neutral"], 2.0)
    top = book[(book["scheme"] == "quantile") & (book["weight"] > 0)]
    assert (top.groupby("yyyymm").size() == 20).all()


def test_tilt_ignores_monotone_transforms(spark):
    df = predictions()
    a = W.allocate(spark.createDataFrame(df), ["tilt"]).toPandas()
    b = W.allocate(spark.createDataFrame(df.assign(score=np.exp(3 * df["score"]))),
                   ["tilt"]).toPandas()
    key = ["yyyymm", "signalname"]
    np.testing.assert_allclose(a.sort_values(key)["weight"], b.sort_values(key)["weight"])


def test_ties_and_single_names_fall_back_to_equal(spark):
    df = predictions(n_months=1, n=10).assign(score=1.0)
    book = W.allocate(spark.createDataFrame(df), ["tilt", "neutral"]).toPandas()
    np.testing.assert_allclose(book.loc[book["scheme"] == "tilt", "weight"], 0.1)
    np.testing.assert_allclose(book.loc[book["scheme"] == "neutral", "weight"], 0.0)


def test_benchmark_rows_use_one_models_universe(spark):
    both = pd.concat([predictions(model="a"), predictions(n=20, model="b")])
    book = W.allocate(spark.createDataFrame(both), ["tilt"], benchmark_of="b").toPandas()
    bench = book[book["model"] == W.BENCHMARK]
    assert len(bench) == 80 and set(bench["scheme"]) == {"equal"}
    np.testing.assert_allclose(bench["weight"], 1 / 20)


def test_unknown_scheme_and_missing_columns(spark):
    df = spark.createDataFrame(predictions())
    with pytest.raises(ValueError):
        W.allocate(df, ["best"])
    with pytest.raises(KeyError):
        W.allocate(df.drop("score"), ["tilt"])


def cap_by_sets(w, cap, budget):
    """Grow the set of names over the cap until scaling the others adds none."""
    scale, over = 1.0, set()
    if len(w) * cap > budget + 1e-9:
        while True:
            now = {i for i, v in enumerate(w) if v * scale > cap + 1e-12}
            if now == over:
                break
            over = now
            rest = sum(v for i, v in enumerate(w) if i not in over)
            left = budget - cap * len(over)
            if rest <= 0 or left <= 0:
                break
            scale = left / rest
    return np.array([cap if i in over else v * scale for i, v in enumerate(w)])


def as_book(spark, months):
    rows = [("m", "tilt", t, f"A{i:03d}", float(v)) for t, w in enumerate(months)
            for i, v in enumerate(w)]
    return spark.createDataFrame(
        rows, "model string, scheme string, yyyymm int, signalname string, weight double")


@pytest.mark.parametrize("deepest", [2000, 1])
def test_cap_matches_the_iterative_rule(spark, monkeypatch, deepest):
    monkeypatch.setattr(W, "DEEPEST", deepest)
    rng = np.random.default_rng(3)
    months = [np.array([.5, .3, .15, .05]), np.array([.4, .35, .25]),
              np.array([.5, .5, 0, 0, 0, 0.]), np.array([.6, .6, .1, .1, -.4])]
    for _ in range(150):
        n = rng.integers(4, 60)
        w = rng.dirichlet(np.full(n, rng.choice([0.1, 0.5, 2.0])))
        if rng.random() < 0.4:  # a tilt, with shorts and ties
            dev = rng.integers(0, 5, n) - 2.0
            w = 1 / n + (dev - dev.mean()) / max(np.abs(dev - dev.mean()).sum(), 1e-9)
        months.append(w)
    for cap in (0.3, 0.05):
        got = W.cap_weights(as_book(spark, months), cap).toPandas()
        for t, w in enumerate(months):
            mine = got[got["yyyymm"] == t].sort_values("signalname")["weight"].to_numpy()
            np.testing.assert_allclose(mine, cap_by_sets(w, cap, w.sum()), atol=1e-9, err_msg=str(t))


def test_cap_micro_cases(spark):
    got = W.cap_weights(as_book(spark, [np.array([.5, .3, .15, .05])]), 0.3).toPandas()
    np.testing.assert_allclose(sorted(got["weight"]), [0.1, 0.3, 0.3, 0.3])
