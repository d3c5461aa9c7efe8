import numpy as np
import pandas as pd
import pytest

from panelyard.config import Split
from panelyard.operators import folds as L

from conftest import months_from, planted_panel

SPLIT = Split(train_start=200001, first_test_year=2009, val_years=3, embargo_months=6)


def calendar(spark, months):
    return spark.createDataFrame([(m,) for m in months], "yyyymm int")


def as_dict(folds):
    out = {}
    for r in folds.collect():
        out.setdefault(r["fold"], {}).setdefault(r["role"], []).append(r["yyyymm"])
    return {f: {k: sorted(v) for k, v in roles.items()} for f, roles in sorted(out.items())}


def index(m):
    return m // 100 * 12 + m % 100


def test_blocks_are_ordered_with_an_embargo(spark):
    got = L.walk_forward_folds(calendar(spark, months_from(200001, 144)), SPLIT)
    folds = as_dict(got)
    assert list(folds) == ["200901-200912", "201001-201012", "201101-201112"]
    for f in folds.values():
        assert index(f["val"][0]) - index(f["train"][-1]) == 7
        assert index(f["test"][0]) - index(f["val"][-1]) == 1
        assert len(f["val"]) == 36 and f["train"][0] == 200001
    assert L.leakage_violations(got).count() == 0


def test_rolling_training_block(spark):
    split = Split(first_test_year=2009, val_years=2, embargo_months=0, expanding=False,
                  train_years=5)
    folds = as_dict(L.walk_forward_folds(calendar(spark, months_from(200001, 132)), split))
    assert all(len(f["train"]) == 60 for f in folds.values())


def test_stops_at_the_first_year_without_months(spark):
    months = [m for m in months_from(200001, 168) if m // 100 != 2010]
    folds = as_dict(L.walk_forward_folds(calendar(spark, months), SPLIT))
    assert list(folds) == ["200901-200912"]


def test_too_short_a_sample_is_an_error(spark):
    with pytest.raises(ValueError):
        L.require_folds(L.walk_forward_folds(calendar(spark, months_from(200001, 3)), SPLIT))


def test_violations_are_found(spark):
    bad = spark.createDataFrame(
        [("a", "train", 5), ("a", "val", 5), ("a", "test", 6), ("b", "train", 1), ("b", "val", 2),
         ("b", "test", 6)], "fold string, role string, yyyymm int")
    assert {r["problem"] for r in L.leakage_violations(bad).collect()} == {
        "train overlaps val", "month tested twice"}


def test_breaches_of_the_embargo_are_found(spark):
    rows = [("a", "train", 200006), ("a", "val", 200101), ("b", "train", 200007), ("b", "val", 200101),
            ("c", "train", 199912), ("c", "train", 200012), ("c", "val", 200101)]
    folds = spark.createDataFrame(rows, "fold string, role string, yyyymm int")
    assert {r["fold"] for r in L.leakage_violations(folds, 6).collect()} == {"b", "c"}
    assert L.leakage_violations(folds, 6).select("problem").distinct().collect()[0][0] == "embargo breached"
    assert L.leakage_violations(folds).count() == 0


@pytest.mark.parametrize("n,length,stride", [(10, 4, None), (11, 4, 4), (3, 8, None), (8, 8, 2),
                                             (13, 5, 3)])
def test_windows(spark, n, length, stride):
    months = months_from(200001, n)
    step = stride or max(length // 2, 1)
    final = max(n - length, 0)
    want = [months[s:s + length] for s in sorted({*range(0, final + 1, step), final})]
    got = L.month_windows(calendar(spark, months), length, stride).toPandas()
    mine = [list(g.sort_values("pos")["yyyymm"]) for _, g in got.groupby("window")]
    assert mine == want


def test_densify_fills_absent_cells_with_zero(spark):
    df = planted_panel(n_months=6, n_assets=5)
    df = df.drop(df.index[[3, 11]])
    panel = spark.createDataFrame(df)
    windows = L.month_windows(L.distinct_months(panel), 3, 3)
    got = L.densify(panel, windows, ["f00", "f01"]).toPandas()
    assert len(got) == 30 and got["mask"].sum() == 28
    absent = got[got["mask"] == 0]
    assert (absent[["y", "carry", "switch"]] == 0).all().all()
    assert all(np.all(np.array(x) == 0) for x in absent["x"])


def test_codes_follow_sorted_order(spark):
    df = spark.createDataFrame(pd.DataFrame({"signalname": [f"s{i % 97:03d}" for i in range(500)]}))
    for limit in (None, 20):
        got = L.encode_ids(df, row_limit=limit).orderBy("signalname").toPandas()
        assert list(got["code"]) == list(range(97))
