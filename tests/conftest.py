from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").appName("tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def months_from(start: int, count: int) -> list[int]:
    first = start // 100 * 12 + start % 100 - 1
    return [(first + i) // 12 * 100 + (first + i) % 12 + 1 for i in range(count)]


def planted_panel(n_months=72, n_assets=40, n_features=4, ic=0.2, seed=0, start=200001):
    """Balanced panel whose first feature predicts the next return."""
    rng = np.random.default_rng(seed)
    months = months_from(start, n_months)
    x = rng.normal(size=(n_months, n_assets, n_features))
    noise = rng.normal(size=(n_months, n_assets))
    y = 0.04 * (ic * x[..., 0] + np.sqrt(1 - ic * ic) * noise)
    churn = 0.02 * 10 ** rng.uniform(0, 1, n_assets)
    df = pd.DataFrame({
        "signalname": np.tile([f"A{i:03d}" for i in range(n_assets)], n_months),
        "yyyymm": np.repeat(months, n_assets).astype("int32"),
        "ret": y.ravel(), "ret_next": y.ravel(), "turnover_raw": np.tile(churn, n_months)})
    df["carry_cost"] = df["turnover_raw"] * 25 / 1e4
    df["switch_cost"] = 0.005
    df["ret_next_dm"] = df["ret_next"] - df.groupby("yyyymm")["ret_next"].transform("mean")
    for k in range(n_features):
        df[f"f{k:02d}"] = x[..., k].ravel()
    return df
