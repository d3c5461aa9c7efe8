"""Cross-sectional feature transforms, all computed within one month."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.cross_section import Section, group_quantiles, measure, rank_within
from panelyard.operators.universe import demean
from panelyard.sources.store import attach, materialise


CELL_LIMIT = 16_000_000     # rows times columns of a month that one task ranks (128 MB of numbers)


def _to_unit(rank: Column, n: Column, fill: float) -> Column:
    scaled = F.when(n > 1, 2.0 * (rank - 1) / (n - 1) - 1.0).otherwise(0.0)
    return F.coalesce(scaled, F.lit(fill)).cast("float")


def _unit_ranks(x: np.ndarray) -> np.ndarray:
    """Tie-averaged ranks of the numbers, rescaled to [-1, 1]; NaN is the largest number."""
    n = len(x)
    if n <= 1:
        return np.zeros(n)
    order = np.argsort(x)
    s = x[order]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) & ~np.isnan(s[:-1])]))
    last = np.append(new[1:], n)
    out = np.empty(n)
    out[order] = np.repeat((new + 1 + last) / 2.0, last - new)
    return 2.0 * (out - 1) / (n - 1) - 1.0


def _ranked_months(df: DataFrame, cols: list[str], group: str, fill: float) -> DataFrame:
    """Every column of a month ranked at once, behind one exchange and sort."""
    places = [df.columns.index(c) for c in cols]

    def run(table: pa.Table) -> pa.Table:
        done = list(table.columns)
        for i in places:
            column = table.column(i)
            live = ~column.is_null().to_numpy()
            x = column.drop_null().cast(pa.float64()).to_numpy()
            out = np.full(len(column), fill if len(x) > 1 else 0.0)
            out[live] = _unit_ranks(x)
            done[i] = pa.array(out.astype(np.float32))
        return pa.table(done, names=names)

    names = df.columns
    kinds = ", ".join(f"`{f.name}` {'float' if f.name in cols else f.dataType.simpleString()}"
                      for f in df.schema.fields)
    return df.groupBy(group).applyInArrow(run, kinds)


def rank_normalise(df: DataFrame, cols: list[str], *, group: str = "yyyymm",
                   asset: str = "signalname", fill: float = 0.0, section: Section | None = None,
                   row_limit: int | None = None) -> DataFrame:
    """Map each column to its within-month average rank, rescaled to [-1, 1].

    Months whose rows times columns fit a task are ranked whole, all columns behind one exchange. Wider
    months are ranked in long form, so every (feature, month) spreads over cells.
    """
    section = section or measure(df, [group])
    if section.largest * len(cols) <= (CELL_LIMIT if row_limit is None else row_limit):
        return _ranked_months(df, cols, group, fill)

    keys = [asset, group]
    df = materialise(df, "features")
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    long = long.unpivot(keys, cols, "_feature", "_value")
    wide_section = Section(section.groups * len(cols), section.largest)
    ranked = rank_within(long, [group, "_feature"], "_value", tie=asset, section=wide_section,
                         average="_r", size="_n", row_limit=row_limit, stored=True)
    ranked = ranked.select(*keys, "_feature", _to_unit(F.col("_r"), F.col("_n"), fill).alias("_u"))
    wide = ranked.groupBy(*keys).pivot("_feature", cols).agg(F.first("_u"))
    return df.drop(*cols).join(wide, keys).select(*df.columns)


def null_shares(df: DataFrame, cols: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
    return row.asDict()


def missingness_flags(df: DataFrame, cols: list[str], min_var: float = 0.01
                      ) -> tuple[DataFrame, list[str]]:
    """Add ``<col>_isna`` where the share of nulls varies enough to inform."""
    if not cols:
        return df, []
    shares = null_shares(df, cols)
    keep = [c for c in cols if min_var <= (shares[c] or 0.0) <= 1 - min_var]
    flags = [F.col(c).isNull().cast("float").alias(f"{c}_isna") for c in keep]
    return df.select("*", *flags), [f"{c}_isna" for c in keep]


def split_binary(df: DataFrame, cols: list[str]) -> tuple[list[str], list[str]]:
    """(continuous, binary): binary columns hold at most two distinct values.

    Two plain scans (extremes, then values off both extremes) replace one distinct
    count per column, which would multiply the rows by the number of columns.
    """
    if not cols:
        return [], []
    ends = df.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in cols
                    for n, f in (("lo", F.min), ("hi", F.max))]).first()
    off = df.agg(*[F.count(F.when((F.col(c) != F.lit(ends[f"lo_{c}"]))
                                  & (F.col(c) != F.lit(ends[f"hi_{c}"])), 1)).alias(c)
                   for c in cols]).first()
    binary = [c for c in cols if not off[c]]
    return [c for c in cols if off[c]], binary


def winsorise(df: DataFrame, cols: list[str], *, group: str = "yyyymm", asset: str = "signalname",
              lower: float = 0.01, upper: float = 0.99, interpolation: str = "nearest",
              section: Section | None = None, row_limit: int | None = None) -> DataFrame:
    """Clip columns at their within-month quantiles, all found in one long pass."""
    section = section or measure(df, [group])
    long = df.select(asset, group, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [asset, group], cols, "_feature", "_value").where(F.col("_value").isNotNull())
    bounds = group_quantiles(
        long, [group, "_feature"], "_value", {"_lo": lower, "_hi": upper}, tie=asset,
        section=Section(section.groups * len(cols), section.largest),
        interpolation=interpolation, row_limit=row_limit)
    per_month = bounds.groupBy(group).agg(F.map_from_entries(F.collect_list(
        F.struct("_feature", F.struct("_lo", "_hi")))).alias("_bounds"))
    df = attach(df, per_month, [group], section.groups * len(cols))

    def clip(c: str):
        v, b = F.col(c), F.try_element_at("_bounds", F.lit(c))
        return F.when(v.isNotNull(), F.greatest(F.least(v, b["_hi"]), b["_lo"]))

    return df.withColumns({c: clip(c) for c in cols}).drop("_bounds")


def build_features(df: DataFrame, cols: list[str], *, section: Section | None = None,
                   row_limit: int | None = None) -> tuple[DataFrame, list[str]]:
    """Flags, then ranks for continuous columns, 0/1 floats for the rest."""
    continuous, binary = split_binary(df, cols)
    df, flags = missingness_flags(df, continuous)
    df = rank_normalise(df, continuous, section=section, row_limit=row_limit)
    df = df.withColumns({c: F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float"))
                         for c in binary})
    if "ret_next_dm" not in df.columns:
        df = demean(df)
    return df, sorted(continuous) + sorted(binary) + sorted(flags)
