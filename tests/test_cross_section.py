import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.operators import cross_section as X
from panelyard.operators import transforms
from panelyard.sources import store


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, a third of its values tied, some NULL."""
    v = (F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 2 == 0, F.lit(0.0))
         .otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0))
    return spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("g"), v.alias("v"))


@pytest.mark.parametrize("limit", [None, 40, 400])
def test_ranks_match_pandas(skewed, limit):
    section = X.measure(skewed, ["g"])
    got = X.rank_within(skewed, ["g"], "v", tie="id", section=section, average="a", ordinal="o",
                        size="n", row_limit=limit).toPandas().sort_values("id")
    by = got.sort_values(["v", "id"]).groupby("g")["v"]
    want = got.groupby("g")["v"].rank()
    np.testing.assert_array_equal(got["a"], want)
    first = by.rank(method="first")
    np.testing.assert_array_equal(got["o"], first.reindex(got.index))
    np.testing.assert_array_equal(got["n"], got.groupby("g")["v"].transform("count"))


def test_no_task_gets_a_large_group(skewed):
    """Rows meet only in cells near the limit, however large their group is."""
    live = skewed.where(F.col("v") > 0)
    section = X.measure(live, ["g"])
    assert section.largest > 500
    plan = X.rank_within(live, ["g"], "v", tie="id", section=section, average="a", row_limit=50)
    assert plan.select("a").count() == live.count()
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell" in text and "_salt" in text


def test_cuts_a_row_is_looked_up_in_stay_few(skewed, monkeypatch):
    """A small limit does not make every row carry a cut for each few rows of its group."""
    kept = []

    def keep(df, name="stage"):
        kept.extend([df] if name == "cuts" else [])
        return store.materialise(df, name)

    monkeypatch.setattr(X, "materialise", keep)
    section = X.measure(skewed, ["g"])
    assert section.largest > 8 * X.CUTS
    got = X.rank_within(skewed, ["g"], "v", tie="id", section=section, average="a", ordinal="o",
                        row_limit=4).toPandas().sort_values("id")
    np.testing.assert_array_equal(got["a"], got.groupby("g")["v"].rank())
    first = got.sort_values(["v", "id"]).groupby("g")["v"].rank(method="first")
    np.testing.assert_array_equal(got["o"], first.reindex(got.index))
    assert len(kept) == 2
    for plan in kept:
        assert plan.agg(F.max(F.size("__cuts"))).first()[0] <= X.CUTS


@pytest.mark.parametrize("limit", [None, 60])
def test_quantiles(skewed, limit):
    section = X.measure(skewed, ["g"])
    got = X.group_quantiles(skewed, ["g"], "v", {"lo": 0.1, "hi": 0.9}, tie="id", section=section,
                            interpolation="linear", row_limit=limit).toPandas().set_index("g")
    data = skewed.toPandas().groupby("g")["v"]
    for col, p in (("lo", 0.1), ("hi", 0.9)):
        np.testing.assert_allclose(got[col].sort_index(), data.quantile(p).sort_index())


def test_global_median_through_cells(spark):
    df = spark.range(1001).select("id", (F.col("id") * 1.0).alias("v"))
    got = X.group_quantiles(df, [], "v", {"m": 0.5}, tie="id", section=X.measure(df, []),
                            interpolation="linear", row_limit=50)
    assert got.first()["m"] == 500.0


def test_group_aggs_agree(skewed):
    section = X.measure(skewed, ["g"])
    a = X.with_group_aggs(skewed, ["g"], section, None, s=F.sum("v")).toPandas()
    b = X.with_group_aggs(skewed, ["g"], section, 10, s=F.sum("v")).toPandas()
    np.testing.assert_allclose(a.sort_values("id")["s"], b.sort_values("id")["s"])


def test_rank_normalise_single_row_month_is_zero(spark):
    df = spark.createDataFrame(pd.DataFrame(
        {"signalname": ["a", "b", "c"], "yyyymm": [1, 1, 2], "x": [1.0, 5.0, 9.0]}))
    got = transforms.rank_normalise(df, ["x"]).orderBy("signalname").toPandas()["x"]
    assert list(got) == [-1.0, 1.0, 0.0]


def test_split_binary(spark):
    df = spark.createDataFrame([(0.0, 1.0, None), (1.0, 2.0, None), (1.0, 3.0, None)],
                               "b double, c double, n double")
    assert transforms.split_binary(df, ["b", "c", "n"]) == (["c"], ["b", "n"])


def test_whole_months_are_ranked_without_a_window_per_column(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("a", 1, 2.0, 7), ("b", 1, 2.0, None), ("c", 1, nan, 3), ("d", 1, None, 3), ("e", 1, -0.0, 3),
         ("f", 1, 0.0, 9), ("a", 2, 5.0, None), ("b", 2, None, None)], "signalname string, yyyymm int, x double, k int")
    whole = transforms.rank_normalise(df, ["x", "k"])
    assert "Window" not in whole._jdf.queryExecution().toString()
    celled = transforms.rank_normalise(df, ["x", "k"], row_limit=2)
    key = ["yyyymm", "signalname"]
    a, b = (v.toPandas().sort_values(key).reset_index(drop=True) for v in (whole, celled))
    assert a.equals(b[a.columns])
    assert whole.schema == celled.select(whole.columns).schema or whole.dtypes == celled.dtypes
