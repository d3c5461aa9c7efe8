"""Joining what is known about an asset when it enters the universe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.scalars import slug

CATEGORIES = ("cat_economic", "cat_data", "cat_form")
RAW_COLUMNS = (*CATEGORIES, "stock_weight", "pub_year", "sample_start_year", "sample_end_year")


def common_levels(df: DataFrame, cols: list[str], k: int = 10) -> dict[str, list[str]]:
    """The ``k`` most frequent non-null levels of each column, ties by name, in one job."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("level")) for c in cols])
    counts = (df.select(F.explode(pairs).alias("p")).select("p.*")
              .where(F.col("level").isNotNull()).groupBy("col", "level").count())
    order = Window.partitionBy("col").orderBy(F.desc("count"), F.asc("level"))
    top = counts.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
    out: dict[str, list[str]] = {c: [] for c in cols}
    for row in sorted(top.collect(), key=lambda x: x["_k"]):  # k names per column
        out[row["col"]].append(row["level"])
    return out


def one_hot(df: DataFrame, col: str, levels: list[str]) -> DataFrame:
    return df.select("*", *[(F.col(col) == v).cast("double").alias(f"{col}_{slug(v)}")
                            for v in levels])


def attach_metadata(df: DataFrame, metadata: DataFrame, levels: dict[str, list[str]] | None = None,
                    drop_raw: bool = True) -> DataFrame:
    """Publication age, original effect size, strategy shape, category indicators.

    Calendar levels that would nearly name an asset are dropped after the relative
    versions are taken.
    """
    out = df.join(metadata, "signalname", "left")
    year = F.floor(F.col("yyyymm") / 100)
    out = out.select(
        "*",
        (year - F.col("pub_year")).cast("double").alias("yrs_since_pub"),
        (year - F.col("sample_end_year")).cast("double").alias("yrs_since_sample_end"),
        (F.col("sample_end_year") - F.col("sample_start_year")).cast("double")
        .alias("orig_sample_years"),
        (F.upper("stock_weight") == "VW").cast("double").alias("is_value_weighted"))
    cats = [c for c in CATEGORIES if c in out.columns]
    chosen = dict(levels or {})
    unknown = [c for c in cats if c not in chosen]
    if unknown:
        chosen |= common_levels(out, unknown)
    for col in cats:
        out = one_hot(out, col, chosen[col])
    return out.drop(*RAW_COLUMNS) if drop_raw else out
