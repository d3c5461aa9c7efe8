"""The study's inputs, derived from a star schema of orders and suppliers.

Asset = supplier, month = ship month, return = mean discount less five percent.
Means are taken over integer cents, so a result never depends on the order in
which partial sums arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.months import yyyymm

SIGNALS = ("sig_disc", "sig_price", "sig_qty", "sig_tax")  # in the order of suppkey mod 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(F.floor(c * 100 + 0.5)).cast("double")


def _mean_discount() -> Column:
    return _cents("l_discount") / (F.count("l_discount") * 100.0)


def asset_returns(spark: SparkSession, sf_dir: str, min_quantity: float | None = None) -> DataFrame:
    """(signalname, yyyymm, ret, log_breadth); ``min_quantity`` gives the narrower
    universe of larger lots."""
    lines = table(spark, sf_dir, "lineitem")
    if min_quantity is not None:
        lines = lines.where(F.col("l_quantity") >= min_quantity)
    return (lines.groupBy(F.col("l_suppkey").cast("string").alias("signalname"),
                          yyyymm(F.col("l_shipdate")).alias("yyyymm"))
            .agg((_mean_discount() - 0.05).alias("ret"),
                 F.log1p(F.count(F.lit(1)).cast("double")).alias("log_breadth")))


def firm_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(permno, yyyymm, four signals), one row per part and month."""
    n = F.count(F.lit(1))
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_partkey").alias("permno"), yyyymm(F.col("l_shipdate")).alias("yyyymm"))
            .agg(_mean_discount().alias("sig_disc"),
                 (_cents("l_extendedprice") / 100.0).alias("sig_price"),
                 (F.sum("l_quantity") / n).alias("sig_qty"),
                 (_cents("l_tax") / (n * 100.0)).alias("sig_tax")))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per asset. Nation and region are fixed small lists."""
    s = table(spark, sf_dir, "supplier")
    n = F.broadcast(table(spark, sf_dir, "nation"))
    r = F.broadcast(table(spark, sf_dir, "region"))
    key = F.col("s_suppkey")
    df = (s.join(n, s.s_nationkey == n.n_nationkey)
          .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    return df.select(
        key.cast("string").alias("signalname"),
        (1993 + key % 3).cast("double").alias("pub_year"),
        (1980 + key % 7).cast("double").alias("sample_start_year"),
        (1990 + key % 3).cast("double").alias("sample_end_year"),
        (F.col("s_acctbal") / 1000.0).alias("orig_tstat"),
        F.when(key % 5 != 0, F.col("s_acctbal") / 10000.0).alias("orig_ret"),
        F.when(key % 3 == 0, 1.0).when(key % 3 == 1, 6.0).otherwise(12.0).alias("holding_months"),
        F.when(key % 4 == 0, 5.0).otherwise(10.0).alias("ls_quantile"),
        F.when(key % 2 == 0, "VW").otherwise("EW").alias("stock_weight"),
        F.col("r_name").alias("cat_economic"), F.col("n_name").alias("cat_data"),
        F.when(F.col("s_acctbal") < 0, "short").otherwise("long").alias("cat_form"))


def asset_signal(asset: Column) -> Column:
    """Name of the firm signal an asset is built on."""
    return F.element_at(F.array(*[F.lit(s) for s in SIGNALS]),
                        (asset.cast("long") % len(SIGNALS) + 1).cast("int"))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly stand-in factors: mean discount overall and by return flag."""
    flag = {f: F.when(F.col("l_returnflag") == f, F.col("l_discount")) for f in "AR"}

    def mean(c: Column) -> Column:
        return F.try_divide(_cents(c), F.count(c) * 100.0) - 0.05

    return (table(spark, sf_dir, "lineitem").groupBy(yyyymm(F.col("l_shipdate")).alias("yyyymm"))
            .agg(mean(F.col("l_discount")).alias("mktrf"), mean(flag["A"]).alias("smb"),
                 mean(flag["R"]).alias("hml")))
