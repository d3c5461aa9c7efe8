"""Registered queries: each runs an operator over the whole driver tables.

Intermediate stages (panel, predictions, weight book, monthly results) are written
once per session and source version, as the pipeline itself does between its steps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from panelyard.config import Settings, Split, Universe
from panelyard.functions.months import from_month_index, month_index
from panelyard.operators import accounting, folds, inference, learners, objectives, transforms
from panelyard.operators import trailing, turnover, universe, weights
from panelyard.operators.cross_section import Section, measure
from panelyard.operators.metadata import attach_metadata, common_levels
from panelyard.plans import oracle, tables
from panelyard.plans.oracle import drawdowns, performance, r, statement, t_stat
from panelyard.plans.panel import build_panel
from panelyard.plans.walk_forward import read_predictions, run_walk_forward
from panelyard.sources import driver_tables as src
from panelyard.sources.files import (DOC_FIELDS, build_factors, load_metadata, long_short_returns,
                                     read_factor_text, read_portfolio_returns,
                                     signals_csv_to_parquet, write_csv)
from panelyard.sources.store import (materialise, refresh_months, stage_dir, stored,
                                     write_stage)

Query = Callable[[SparkSession, str], DataFrame]

MIN_ASSETS = 5
MODELS = ("lowvol", "momentum", "reversal")
BENCH_OF = "momentum"
SETTINGS = Settings(
    universe=Universe(min_assets=MIN_ASSETS),
    split=Split(train_start=199401, first_test_year=2000, val_years=1, embargo_months=6,
                min_train_months=24, min_val_months=12))
FEATURES = ("r_1", "r_3", "r_12", "r_12_2", "vol_12", "beta_idx", "turnover_monthly")

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = statement(sql, extra)
        return fn
    return register


def out(df: DataFrame, *cols: str, digits: int = 8, coarse: dict[str, int] | None = None
        ) -> DataFrame:
    """Chosen columns with floats rounded (and no negative zero). A small offset keeps
    exact decimal halves off the rounding boundary."""
    df = df.select(*cols) if cols else df
    items = []
    for f in df.schema.fields:
        nd = (coarse or {}).get(f.name, digits)
        items.append(f"round(cast(`{f.name}` as double) + 0.123e-{nd}D, {nd}) + 0D AS `{f.name}`"
                     if f.dataType.typeName() in ("double", "float") else f"`{f.name}`")
    return df.selectExpr(*items)


# ------------------------------------------------------------------- stages
_stages: dict[tuple, tuple[str, object]] = {}


def _version(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple:
    """One-row fingerprint of the source files (a listing; no content is read)."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(
        [f"{sf_dir}/{n}.parquet" for n in names])
    mark = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
    return tuple(listed.agg(F.count(F.lit(1)), F.sum("length"), F.sum(mark)).first())


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage table, rebuilt in a new session or when a source file changed."""
    key = (spark.sparkContext.applicationId, stage_dir(spark), sf_dir, name,
           _version(spark, sf_dir, ("lineitem", "supplier", "nation", "region")))
    if key in _stages:
        path, schema = _stages[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # the shared folder was cleared
            del _stages[key]
    df = build()
    _stages[key] = (write_stage(df, name), df.schema)
    path, schema = _stages[key]
    return spark.read.schema(schema).parquet(path)


def turnover_stage(spark, sf_dir) -> DataFrame:
    return stage(spark, sf_dir, "turnover",
                 lambda: turnover.causal_turnover(measured_turnover(spark, sf_dir)))


def firms_stage(spark, sf_dir) -> DataFrame:
    return stage(spark, sf_dir, "firms", lambda: src.firm_signals(spark, sf_dir))


def measured_turnover(spark, sf_dir) -> DataFrame:
    return turnover.measured_turnover(firms_stage(spark, sf_dir), list(src.SIGNALS))


def deciles(spark, sf_dir, row_limit: int | None = None) -> DataFrame:
    """Decile books of all signals. The wide firm table is kept; its long form is only
    ever streamed, and a month's rows bound every signal's cross-section."""
    firms = firms_stage(spark, sf_dir)
    months = measure(firms, ["yyyymm"])
    values = turnover.unpivot_signals(firms, list(src.SIGNALS))
    return turnover.decile_book(values, Section(months.groups * len(src.SIGNALS), months.largest),
                                stored=True, row_limit=row_limit)


def panel_stage(spark, sf_dir, min_quantity: float | None = None) -> DataFrame:
    def build():
        causal = turnover_stage(spark, sf_dir).withColumnRenamed("signalname", "signal")
        return build_panel(
            src.asset_returns(spark, sf_dir, min_quantity), src.metadata(spark, sf_dir), causal,
            SETTINGS, cost_keys=("signal", "yyyymm"), causal_rows=len(src.SIGNALS) * 2400,
            with_keys=lambda d: d.withColumn("signal", src.asset_signal(F.col("signalname"))))
    name = "panel" if min_quantity is None else f"panel-{min_quantity:g}"
    return stage(spark, sf_dir, name, build)


def score_models(panel: DataFrame) -> DataFrame:
    """Three lagged features standing in for model scores, on identical rows."""
    scores = {"lowvol": -F.col("vol_12"), "momentum": F.col("r_12_2"), "reversal": -F.col("ret")}
    pairs = F.array(*[F.struct(F.lit(m).alias("model"),
                               (F.round(c, 10) + F.lit(0.0)).alias("score"))
                      for m, c in scores.items()])
    kept = panel.where(F.col("r_12_2").isNotNull() & F.col("vol_12").isNotNull())
    cols = ["signalname", "yyyymm", "ret_next", "ret_next_dm", "carry_cost", "switch_cost",
            "turnover_raw"]
    return kept.select(*cols, F.explode(pairs).alias("_m")).select(*cols, "_m.*")


def prediction_stage(spark, sf_dir) -> DataFrame:
    return stage(spark, sf_dir, "predictions", lambda: score_models(panel_stage(spark, sf_dir)))


def book_stage(spark, sf_dir) -> DataFrame:
    return stage(spark, sf_dir, "book", lambda: tables.weight_book(
        prediction_stage(spark, sf_dir), SETTINGS, benchmark_of=BENCH_OF))


def monthly_stage(spark, sf_dir) -> DataFrame:
    """Monthly rows at every cost multiple."""
    return stage(spark, sf_dir, "monthly", lambda: tables.monthly_results(
        book_stage(spark, sf_dir), SETTINGS, multipliers=SETTINGS.costs.multipliers,
        groups=2400 * (len(MODELS) + 1)))


def base_case(spark, sf_dir) -> DataFrame:
    return monthly_stage(spark, sf_dir).where(F.col("cost_mult") == 1.0)


def returns_in_universe(spark, sf_dir) -> DataFrame:
    return universe.post_publication(src.asset_returns(spark, sf_dir), src.metadata(spark, sf_dir),
                                     SETTINGS.universe)


# ------------------------------------------------------ sources and universe
_SIG = ("sig_disc", "sig_price", "sig_qty", "sig_tax")


@query("signals_csv_source", f"""
    SELECT CAST(permno AS INTEGER) AS permno, yyyymm, {r(*_SIG, digits=3)}
    FROM (SELECT permno, yyyymm,
                 CASE WHEN permno % 3 <> 0 THEN CAST(sig_disc AS FLOAT) END AS sig_disc,
                 CAST(sig_price AS FLOAT) AS sig_price, CAST(sig_qty AS FLOAT) AS sig_qty,
                 CAST(sig_tax AS FLOAT) AS sig_tax FROM firm)""")
def signals_csv_source(spark, sf_dir):
    wide = src.firm_signals(spark, sf_dir).withColumn("permno", F.col("permno").cast("int"))
    wide = wide.withColumn("sig_disc", F.when(F.col("permno") % 3 == 0, float("nan")).otherwise(
        F.col("sig_disc")))  # written as the text NaN, read as NULL
    path = _written(wide, "signals")
    return out(signals_csv_to_parquet(spark, path, f"{path}.parquet"), digits=3)


def _written(df: DataFrame, name: str, fmt: str = "csv") -> str:
    path = f"{stage_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("header", True).format(fmt).save(path)
    return path


@query("portfolio_returns_source", f"""
    SELECT 'ex_price5' AS universe, signalname, yyyymm, {r('ret', 'log_breadth', digits=7)}
    FROM rets WHERE ret <> 0""")
def portfolio_returns_source(spark, sf_dir):
    """Percent returns with a date string, ``NA`` for missing, other legs mixed in."""
    df = src.asset_returns(spark, sf_dir)
    size = F.expm1("log_breadth")
    legs = F.explode(F.array(F.lit("LS"), F.lit("01")))
    text = df.select(
        "signalname", legs.alias("port"),
        F.format_string("%d-%02d-28", F.floor(F.col("yyyymm") / 100), F.col("yyyymm") % 100)
        .alias("date"),
        F.when(F.col("ret") == 0, F.lit("NA")).otherwise((F.col("ret") * 100).cast("string"))
        .alias("ret"), size.alias("Nlong"), F.lit(0.0).alias("Nshort"))
    raw = read_portfolio_returns(spark, _written(text, "ports"), "ex_price5")
    return out(long_short_returns(raw), "universe", "signalname", "yyyymm", "ret", "log_breadth",
               digits=7)


@query("metadata_source", f"""
    SELECT signalname, pub_year, sample_start_year, sample_end_year, holding_months, stock_weight,
           cat_economic, {r('orig_tstat', 'orig_ret')} FROM meta""")
def metadata_source(spark, sf_dir):
    df = src.metadata(spark, sf_dir)
    back = {v: k for k, v in DOC_FIELDS.items()}
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(back[c])
                       for c in df.columns])
    raw = spark.read.option("header", True).csv(_written(text, "doc"))
    return out(load_metadata(raw), "signalname", "pub_year", "sample_start_year",
               "sample_end_year", "holding_months", "stock_weight", "cat_economic", "orig_tstat",
               "orig_ret")


@query("factor_text_source", f"""
    SELECT yyyymm, {r("CAST(printf('%.6f', mktrf * 100) AS DOUBLE) / 100>mktrf",
                      "CASE WHEN smb > 0 THEN CAST(printf('%.6f', smb * 100) AS DOUBLE) / 100 END>smb")}
    FROM factors""")
def factor_text_source(spark, sf_dir):
    """Stacked tables with a prose header; missing coded -99.99; later block ignored."""
    def lines(df, key):
        smb = F.when(F.col("smb") > 0, F.col("smb") * 100).otherwise(-99.99)
        text = F.format_string("%d, %.6f, %.6f", F.col(key), F.col("mktrf") * 100, smb)
        return df.select(F.col(key).cast("int").alias("k"), text.alias("value"))

    monthly = src.factors(spark, sf_dir).select("yyyymm", "mktrf", "smb")
    yearly = monthly.groupBy(F.floor(F.col("yyyymm") / 100).alias("year")).agg(
        F.avg("mktrf").alias("mktrf"), F.avg("smb").alias("smb"))
    fixed = spark.createDataFrame(
        [(0, "Made from line items; percent per month."), (1, ",Mkt-RF,SMB"), (300000, ""),
         (300001, "Annual averages"), (300002, ",Mkt-RF,SMB")], "k int, value string")
    later = lines(yearly, "year").withColumn("k", F.col("k") + 300003)
    text = fixed.unionByName(lines(monthly, "yyyymm")).unionByName(later)  # a line per month
    path = _written(text.orderBy("k").coalesce(1).select("value"), "factors", "text")
    return out(read_factor_text(spark, path))


@query("factor_text_files", f"""
    SELECT yyyymm, {r("CAST(printf('%.6f', mktrf * 100) AS DOUBLE) / 100>mktrf",
                      "CASE WHEN smb > 0 THEN CAST(printf('%.6f', smb * 100) AS DOUBLE) / 100 END>smb",
                      "CASE WHEN yyyymm >= 199501 THEN CAST(printf('%.6f', hml * 100) AS DOUBLE) / 100 END>hml")}
    FROM factors""")
def factor_text_files(spark, sf_dir):
    """Two files of unlike headers, widths and months in one read; the second has no prose."""
    rows = src.factors(spark, sf_dir).dropna()
    month, hundred = F.col("yyyymm"), F.lit(100)
    smb = F.when(F.col("smb") > 0, F.col("smb") * hundred).otherwise(-99.99)
    first = rows.select(month.alias("k"), F.format_string("%d, %.6f, %.6f", month, F.col("mktrf") * hundred, smb)
                        .alias("value"))
    second = rows.where(month >= 199501).select(month.alias("k"), F.format_string(
        "%d, %.6f", month, F.col("hml") * hundred).alias("value"))
    kinds = "k int, value string"
    head = spark.createDataFrame([(0, "Two factors."), (1, ",Mkt-RF,SMB"), (300000, ""), (300001, ",HML"),
                                  (300002, "199001, 5.0")], kinds)
    tops = spark.createDataFrame([(0, ",HML"), (300000, ""), (300001, "199001, 1.0")], kinds)
    paths = [_written(text.orderBy("k").coalesce(1).select("value"), name, "text") for text, name in (
        (head.unionByName(first), "factors-a"), (tops.unionByName(second), "factors-b"))]   # a line per month
    return out(read_factor_text(spark, paths), "yyyymm", "mktrf", "smb", "hml")


@query("asset_returns", f"SELECT signalname, yyyymm, {r('ret', 'log_breadth')} FROM rets")
def asset_returns(spark, sf_dir):
    return out(src.asset_returns(spark, sf_dir))


@query("pit_universe", f"SELECT signalname, yyyymm, {r('ret')} FROM pit")
def pit_universe(spark, sf_dir):
    return out(returns_in_universe(spark, sf_dir), "signalname", "yyyymm", "ret")


@query("min_breadth", f"""
    SELECT signalname, yyyymm, {r('ret')} FROM rets
    QUALIFY count(*) OVER (PARTITION BY yyyymm) >= (
        SELECT median(n) FROM (SELECT count(*) AS n FROM rets GROUP BY yyyymm))""")
def min_breadth(spark, sf_dir):
    df = src.asset_returns(spark, sf_dir)
    middle = universe.panel_summary(df).first()["median_assets"]
    return out(universe.min_breadth(df, middle), "signalname", "yyyymm", "ret")


@query("next_month_target", f"""
    SELECT signalname, yyyymm, {r('ret', 'ret_next', 'ret_next_dm')} FROM target""")
def next_month_target(spark, sf_dir):
    df = universe.add_target(returns_in_universe(spark, sf_dir), MIN_ASSETS)
    return out(df, "signalname", "yyyymm", "ret", "ret_next", "ret_next_dm")


@query("demean_target", f"""
    SELECT signalname, yyyymm, {r('ret - avg(ret) OVER (PARTITION BY yyyymm)>ret_dm')} FROM rets""")
def demean_target(spark, sf_dir):
    df = universe.demean(src.asset_returns(spark, sf_dir), "ret", "ret_dm")
    return out(df, "signalname", "yyyymm", "ret_dm")


@query("panel_summary", """
    SELECT count(*) AS n_rows, count(DISTINCT signalname) AS n_assets,
           count(DISTINCT yyyymm) AS n_months, min(yyyymm) AS first_month,
           max(yyyymm) AS last_month, (SELECT min(n) FROM sizes) AS min_assets,
           (SELECT CAST(median(n) AS DOUBLE) FROM sizes) AS median_assets,
           (SELECT max(n) FROM sizes) AS max_assets FROM pit""",
       {"sizes": "SELECT yyyymm, count(*) AS n FROM pit GROUP BY yyyymm"})
def panel_summary(spark, sf_dir):
    return universe.panel_summary(returns_in_universe(spark, sf_dir))


# ------------------------------------------------------------------ features
_TRAILING = ("r_1", "r_3", "r_6", "r_12", "r_24", "r_36", "r_60", "r_12_2", "vol_12", "vol_36",
             "vol_60", "sharpe_36", "sharpe_60", "dd_60")


@query("return_features", f"""
    SELECT signalname, yyyymm, {r(*_TRAILING)}, {r('skew_36', digits=5)} FROM feat""")
def return_features(spark, sf_dir):
    df = trailing.add_return_features(trailing.spread_assets(returns_in_universe(spark, sf_dir)))
    return out(df, "signalname", "yyyymm", *_TRAILING, "skew_36", coarse={"skew_36": 5})


_REFRESHED = ("r_1", "r_12", "r_12_2", "vol_60", "sharpe_60", "dd_60")


@query("month_refresh", f"SELECT signalname, yyyymm, {r(*_REFRESHED, digits=7)} FROM feat")
def month_refresh(spark, sf_dir):
    """A table of trailing features without its last two months, brought up to date month by month."""
    live = materialise(returns_in_universe(spark, sf_dir), "universe")
    months = [m["yyyymm"] for m in folds.distinct_months(live).orderBy(F.desc("yyyymm")).limit(2).collect()]
    path = f"{stage_dir(spark)}/by-month-{uuid.uuid4().hex}"

    def build(rows):
        return trailing.add_return_features(trailing.spread_assets(rows)).select(
            "signalname", "yyyymm", *_REFRESHED)

    stored(spark, path, lambda: build(live.where(F.col("yyyymm") < min(months))), partition_by=("yyyymm",))
    for month in sorted(months):
        table = refresh_months(spark, path, live, [month], build, max(trailing.RETURN_WINDOWS))
    return out(table, "signalname", "yyyymm", *_REFRESHED, digits=7)


_LOSS = {
    "lossy": """SELECT signalname, yyyymm, mi, CASE WHEN yyyymm % 100 = 6 AND CAST(signalname AS BIGINT) % 2 = 0
                       THEN -1e0 ELSE ret END AS ret FROM rets""",
    "spans": "SELECT *, " + ", ".join(
        f"CASE WHEN count(*) OVER {oracle.frame(w)} >= {w} THEN product(1 + ret) OVER {oracle.frame(w)} - 1 "
        f"END AS r_{w}" for w in (3, 12, 36)) + " FROM lossy"}


@query("total_loss_features", f"""
    SELECT signalname, yyyymm, {r('r_3', 'r_12', 'r_36', digits=7)} FROM spans""", _LOSS)
def total_loss_features(spark, sf_dir):
    """Trailing returns where every second asset loses everything each June."""
    june = (F.col("yyyymm") % 100 == 6) & (F.col("signalname").cast("long") % 2 == 0)
    df = src.asset_returns(spark, sf_dir).withColumn("ret", F.when(june, -1.0).otherwise(F.col("ret")))
    df = trailing.add_return_features(trailing.spread_assets(df))
    return out(df, "signalname", "yyyymm", "r_3", "r_12", "r_36", digits=7)


@query("index_features", f"""
    SELECT signalname, yyyymm, n_available,
           {r('idx_ret', 'beta_idx', 'corr_idx', 'idx_r_12', digits=7)} FROM idxfeat""")
def index_features(spark, sf_dir):
    df = materialise(returns_in_universe(spark, sf_dir), "universe")
    df = trailing.add_index_features(trailing.spread_assets(df))
    return out(df, "signalname", "yyyymm", "n_available", "idx_ret", "beta_idx", "corr_idx",
               "idx_r_12", digits=7)


_ONE_HOT = ("cat_economic_africa", "cat_economic_america", "cat_economic_asia",
            "cat_economic_europe", "cat_economic_middle_east", "cat_form_long", "cat_form_short")


@query("metadata_features", """
    SELECT signalname, yyyymm, CAST(yyyymm // 100 - pub_year AS DOUBLE) AS yrs_since_pub,
           CAST(yyyymm // 100 - sample_end_year AS DOUBLE) AS yrs_since_sample_end,
           CAST(sample_end_year - sample_start_year AS DOUBLE) AS orig_sample_years,
           CASE WHEN stock_weight = 'VW' THEN 1e0 ELSE 0e0 END AS is_value_weighted, """
       + ", ".join(f"CASE WHEN lower(replace(cat_{k}, ' ', '_')) = '{v}' THEN 1e0 ELSE 0e0 END "
                   f"AS cat_{k}_{v}" for k, v in (c[4:].split("_", 1) for c in _ONE_HOT))
       + " FROM pit JOIN meta USING (signalname)")
def metadata_features(spark, sf_dir):
    live, meta = returns_in_universe(spark, sf_dir), src.metadata(spark, sf_dir)
    levels = common_levels(live.join(meta, "signalname"), ["cat_economic", "cat_data", "cat_form"])
    df = attach_metadata(live, meta, levels)
    return df.select("signalname", "yyyymm", "yrs_since_pub", "yrs_since_sample_end",
                     "orig_sample_years", "is_value_weighted", *_ONE_HOT)


@query("category_levels", """
    SELECT cat_data AS level, n, k FROM (
        SELECT cat_data, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cat_data) AS k
        FROM pit JOIN meta USING (signalname) GROUP BY cat_data) WHERE k <= 10""")
def category_levels(spark, sf_dir):
    from pyspark.sql import Window
    df = returns_in_universe(spark, sf_dir).join(src.metadata(spark, sf_dir), "signalname")
    kept = df.where(F.col("cat_data").isin(common_levels(df, ["cat_data"])["cat_data"]))
    order = Window.orderBy(F.desc("n"), "level")  # at most ten rows
    return (kept.groupBy(F.col("cat_data").alias("level")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("k", F.row_number().over(order).cast("long")))


_PANEL = ("ret", "ret_next", "ret_next_dm", "carry_cost", "switch_cost", "turnover_raw",
          "r_12_2", "vol_12", "dd_60", "beta_idx", "idx_r_12")


@query("build_panel", f"""
    SELECT signalname, yyyymm, n_available, {r(*_PANEL, digits=7)} FROM panel""")
def panel_query(spark, sf_dir):
    return out(panel_stage(spark, sf_dir), "signalname", "yyyymm", "n_available", *_PANEL, digits=7)


_RANKED = ("r_1", "r_12_2", "vol_12")
_RANK_IN = {"ranked_in": "SELECT signalname, yyyymm, " + ", ".join(
    f"round({c}, 10) AS {c}" for c in _RANKED) + " FROM panel"}


def _unit_rank_sql(c: str) -> str:
    return (f"CAST(CASE WHEN {c} IS NULL OR count({c}) OVER (PARTITION BY yyyymm) <= 1 THEN 0e0 "
            f"ELSE 2e0 * (rank() OVER (PARTITION BY yyyymm ORDER BY {c} NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY yyyymm, {c}) - 1) / 2e0 - 1) "
            f"/ (count({c}) OVER (PARTITION BY yyyymm) - 1) - 1 END AS FLOAT)>{c}")


_RANK_SQL = ("SELECT signalname, yyyymm, "
             + r(*[_unit_rank_sql(c) for c in _RANKED], digits=6) + " FROM ranked_in")


def _rank_input(spark, sf_dir):
    return panel_stage(spark, sf_dir).select(
        "signalname", "yyyymm", *[F.round(c, 10).alias(c) for c in _RANKED])


@query("rank_normalise", _RANK_SQL, _RANK_IN)
def rank_normalise(spark, sf_dir):
    return out(transforms.rank_normalise(_rank_input(spark, sf_dir), list(_RANKED)), digits=6)


@query("rank_normalise_cells", _RANK_SQL, _RANK_IN)
def rank_normalise_cells(spark, sf_dir):
    """The path for months too wide for a task, forced by a small row limit."""
    return out(transforms.rank_normalise(_rank_input(spark, sf_dir), list(_RANKED), row_limit=16),
               digits=6)


@query("missingness_flags", """
    SELECT signalname, yyyymm, CASE WHEN vol_36 IS NULL THEN 1e0 ELSE 0e0 END AS vol_36_isna,
           CASE WHEN r_60 IS NULL THEN 1e0 ELSE 0e0 END AS r_60_isna,
           CASE WHEN orig_ret IS NULL THEN 1e0 ELSE 0e0 END AS orig_ret_isna
    FROM panel JOIN meta USING (signalname)""")
def missingness_flags(spark, sf_dir):
    df, flags = transforms.missingness_flags(
        panel_stage(spark, sf_dir), ["vol_36", "r_60", "orig_ret", "ret"])
    return df.select("signalname", "yyyymm", *[F.col(c).cast("double").alias(c) for c in flags])


@query("winsorise", f"""
    SELECT signalname, yyyymm, {r('greatest(least(x, hi), lo)>ret')} FROM (
        SELECT signalname, yyyymm, ret AS x,
               max(CASE WHEN k = floor((n - 1) * 1e-1 + 5e-1) THEN ret END) OVER m AS lo,
               max(CASE WHEN k = floor((n - 1) * 9e-1 + 5e-1) THEN ret END) OVER m AS hi
        FROM (SELECT *, row_number() OVER (PARTITION BY yyyymm ORDER BY ret, signalname) - 1 AS k,
                     count(*) OVER (PARTITION BY yyyymm) AS n FROM rets)
        WINDOW m AS (PARTITION BY yyyymm))""")
def winsorise(spark, sf_dir):
    df = materialise(src.asset_returns(spark, sf_dir).select("signalname", "yyyymm", "ret"))
    return out(transforms.winsorise(df, ["ret"], lower=0.1, upper=0.9))


@query("winsorise_linear_cells", f"""
    SELECT signalname, yyyymm, {r('greatest(least(ret, hi), lo)>ret')} FROM rets JOIN (
        SELECT yyyymm, quantile_cont(ret, 1e-1) AS lo, quantile_cont(ret, 9e-1) AS hi
        FROM rets GROUP BY yyyymm) USING (yyyymm)""")
def winsorise_linear_cells(spark, sf_dir):
    df = materialise(src.asset_returns(spark, sf_dir).select("signalname", "yyyymm", "ret"))
    return out(transforms.winsorise(df, ["ret"], lower=0.1, upper=0.9, interpolation="linear",
                                    row_limit=16))


@query("build_features", f"""
    SELECT signalname, yyyymm, {r('ret_next_dm')}, {r(_unit_rank_sql('vol_12'), digits=6)},
           CASE WHEN stock_weight = 'VW' THEN 1e0 ELSE 0e0 END AS is_value_weighted,
           CASE WHEN vol_12 IS NULL THEN 1e0 ELSE 0e0 END AS vol_12_isna
    FROM (SELECT signalname, yyyymm, ret_next_dm, round(vol_12, 10) AS vol_12, stock_weight
          FROM panel JOIN meta USING (signalname))""")
def build_features(spark, sf_dir):
    df = panel_stage(spark, sf_dir).select(
        "signalname", "yyyymm", "ret_next_dm", F.round("vol_12", 10).alias("vol_12"),
        "is_value_weighted")
    built, names = transforms.build_features(df, ["vol_12", "is_value_weighted"])
    return out(built, "signalname", "yyyymm", "ret_next_dm", *names, coarse={"vol_12": 6})


# --------------------------------------------------------- turnover and costs
@query("decile_book", f"SELECT signalname, permno, yyyymm, {r('side', 'u', 'w')} FROM dbook")
def decile_book(spark, sf_dir):
    return out(deciles(spark, sf_dir), "signalname", "permno", "yyyymm", "side",
               "u", "w")


@query("decile_book_cells", f"SELECT signalname, permno, yyyymm, {r('side', 'u', 'w')} FROM dbook")
def decile_book_cells(spark, sf_dir):
    """Ranks through cells, forced by a small row limit."""
    return out(deciles(spark, sf_dir, row_limit=100), "signalname", "permno", "yyyymm", "side",
               "u", "w")


@query("decile_turnover", f"""
    SELECT signalname, yyyymm, {r('turnover', 'rank_autocorr', digits=7)}
    FROM dturn LEFT JOIN dcorr USING (signalname, mi)""")
def decile_turnover(spark, sf_dir):
    series = measured_turnover(spark, sf_dir)
    return out(series, "signalname", "yyyymm", "turnover", "rank_autocorr", digits=7)


@query("causal_turnover", f"""
    SELECT signalname, yyyymm, {r('turnover', 'turnover_causal', digits=7)} FROM causal""")
def causal_turnover(spark, sf_dir):
    return out(turnover_stage(spark, sf_dir), "signalname", "yyyymm", "turnover",
               "turnover_causal", digits=7)


@query("attach_costs", f"""
    SELECT signalname, yyyymm, {r('turnover_raw', 'turnover_raw * 25 / 1e4>carry_cost',
                                  '5e-3>switch_cost')} FROM costed""")
def attach_costs(spark, sf_dir):
    causal = turnover_stage(spark, sf_dir).withColumnRenamed("signalname", "signal")
    held = src.metadata(spark, sf_dir).select("signalname", "holding_months")
    df = returns_in_universe(spark, sf_dir).join(held, "signalname", "left")
    df = materialise(df.withColumn("signal", src.asset_signal(F.col("signalname"))))
    priced = turnover.attach_costs(df, causal, SETTINGS.costs, on=("signal", "yyyymm"),
                                   causal_rows=len(src.SIGNALS) * 2400)
    return out(priced, "signalname", "yyyymm", "turnover_raw", "carry_cost", "switch_cost")


@query("attach_costs_month_fallback", f"""
    SELECT signalname, yyyymm, {r("coalesce(tc, mid) / greatest(holding_months, 1)>turnover_raw")}
    FROM filled JOIN meta USING (signalname)
         LEFT JOIN (SELECT yyyymm, median(tc) AS mid FROM filled GROUP BY yyyymm) USING (yyyymm)""")
def attach_costs_month_fallback(spark, sf_dir):
    causal = turnover_stage(spark, sf_dir).withColumnRenamed("signalname", "signal")
    held = src.metadata(spark, sf_dir).select("signalname", "holding_months")
    df = returns_in_universe(spark, sf_dir).join(held, "signalname", "left")
    df = materialise(df.withColumn("signal", src.asset_signal(F.col("signalname"))))
    priced = turnover.attach_costs(df, causal, SETTINGS.costs, on=("signal", "yyyymm"),
                                   fallback="month", causal_rows=len(src.SIGNALS) * 2400)
    return out(priced, "signalname", "yyyymm", "turnover_raw")


@query("cost_rate", f"""
    SELECT s.signalname, s.yyyymm, {r('tc / greatest(coalesce(holding_months, 1), 1)>turnover_monthly',
           'tc / greatest(coalesce(holding_months, 1), 1) * 25>carry_bps', '50>switch_bps', digits=7)}
    FROM (SELECT signalname, yyyymm, tc FROM filled) s JOIN meta USING (signalname)""")
def cost_rate(spark, sf_dir):
    from pyspark.sql import Window
    causal = turnover_stage(spark, sf_dir).withColumnRenamed("signalname", "signal")
    df = returns_in_universe(spark, sf_dir).withColumn(
        "signal", src.asset_signal(F.col("signalname")))
    df = df.join(F.broadcast(causal.select("signal", "yyyymm", "turnover_causal")),
                 ["signal", "yyyymm"], "left")  # four signals, calendar-bounded
    upto = universe.by_asset().rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("turnover_causal", F.last("turnover_causal", ignorenulls=True).over(upto))
    spread = turnover.attach_holding_period(df, src.metadata(spark, sf_dir))
    return out(turnover.cost_rate(spread, SETTINGS.costs), "signalname", "yyyymm",
               "turnover_monthly", "carry_bps", "switch_bps", digits=7)


# --------------------------------------------------------------- weight books
def _weights(scheme: str):
    def run(spark, sf_dir):
        book = weights.allocate(prediction_stage(spark, sf_dir), [scheme], SETTINGS.portfolio)
        return out(book, "model", "yyyymm", "signalname", "n", "weight")
    return run


for _scheme in ("tilt", "neutral", "quantile", "simplex"):
    query(f"weights_{_scheme}", f"""
        SELECT model, yyyymm, signalname, n, {r('weight')} FROM w_{_scheme}""")(_weights(_scheme))


@query("weights_equal", f"SELECT model, yyyymm, signalname, n, {r('weight')} FROM w_equal")
def weights_equal(spark, sf_dir):
    book = weights.allocate(prediction_stage(spark, sf_dir), [], SETTINGS.portfolio,
                            benchmark_of=BENCH_OF)
    return out(book, "model", "yyyymm", "signalname", "n", "weight")


@query("weights_cells", f"""
    SELECT model, scheme, yyyymm, signalname, {r('weight')} FROM (
        SELECT * FROM w_tilt UNION ALL SELECT * FROM w_quantile UNION ALL SELECT * FROM w_simplex)""")
def weights_cells(spark, sf_dir):
    """All ranks through cells, forced by a small row limit."""
    book = weights.allocate(prediction_stage(spark, sf_dir), ["tilt", "quantile", "simplex"],
                            SETTINGS.portfolio, row_limit=16)
    return out(book, "model", "scheme", "yyyymm", "signalname", "weight")


def _cap_passes(cap: float, passes: int = 12) -> dict[str, str]:
    """The iterative rule, one pass per part."""
    k = "model, scheme, yyyymm"
    over = f"{cap} + 1e-12"
    parts = {
        "cap_in": "SELECT * FROM w_tilt UNION ALL SELECT * FROM w_quantile",
        "pass_0": f"""SELECT {k}, sum(weight) AS budget, 0 AS k, 1e0 AS c,
                             count(*) * CAST({cap} AS DOUBLE) <= sum(weight) + 1e-9 AS done
                      FROM cap_in GROUP BY {k}"""}
    for i in range(1, passes + 1):
        parts[f"pass_{i}"] = f"""
            SELECT {k}, budget, CASE WHEN stop THEN k ELSE k2 END AS k,
                   CASE WHEN stop THEN c ELSE (budget - k2 * {cap}) / rest END AS c, stop AS done
            FROM (SELECT *, done OR k2 = k OR rest <= 0 OR budget - k2 * {cap} <= 0 AS stop
                  FROM (SELECT {k}, p.budget, p.k, p.c, p.done,
                               count(CASE WHEN weight * p.c > {over} THEN 1 END) AS k2,
                               coalesce(sum(CASE WHEN NOT weight * p.c > {over} THEN weight END), 0) AS rest
                        FROM cap_in JOIN pass_{i - 1} p USING ({k})
                        GROUP BY {k}, p.budget, p.k, p.c, p.done))"""
    parts["scaled"] = f"""
        SELECT {k}, signalname, CASE WHEN free THEN weight WHEN weight * c > {over} THEN {cap}
                                     ELSE weight * c END AS weight
        FROM cap_in JOIN pass_{passes} USING ({k})
             JOIN (SELECT {k}, done AS free FROM pass_0) USING ({k})"""
    return parts


@query("cap_weights", f"SELECT model, scheme, yyyymm, signalname, {r('weight')} FROM scaled",
       _cap_passes(0.025))
def cap_weights(spark, sf_dir):
    book = materialise(weights.allocate(prediction_stage(spark, sf_dir), ["tilt", "quantile"],
                                        SETTINGS.portfolio))
    capped = weights.cap_weights(book, 0.025)
    return out(capped, "model", "scheme", "yyyymm", "signalname", "weight")


@query("drifted_weights", f"SELECT model, scheme, o, signalname, {r('drifted')} FROM held")
def drifted_weights(spark, sf_dir):
    book = book_stage(spark, sf_dir)
    keys = ["model", "scheme", "yyyymm"]
    earned = book.groupBy(*keys).agg(
        F.sum(F.col("weight") * F.coalesce("ret_next", F.lit(0.0))).alias("_earned"))
    months = earned.join(accounting.month_ordinals(book, keys[:2]), keys)
    held = accounting.with_drift(book, months, keys, 2400 * (len(MODELS) + 1))
    return out(held.withColumn("o", F.col("_ord").cast("long")), "model", "scheme", "o",
               "signalname", "drifted")


# ---------------------------------------------------------------- accounting
_BASE = ("gross", "turnover", "switching", "carrying", "borrow")
_MONTHLY = ("gross", "cost", "net", "turnover", "switching", "carrying", "leverage")


@query("net_accounting", f"""
    SELECT model, scheme, formation_yyyymm, yyyymm, n, {r(*_BASE)} FROM base""")
def net_accounting(spark, sf_dir):
    base = accounting.account(book_stage(spark, sf_dir), SETTINGS.costs)
    return out(base, "model", "scheme", "formation_yyyymm", "yyyymm", "n", *_BASE)


@query("vol_target", f"""
    SELECT model, scheme, cost_mult, yyyymm, {r(*_MONTHLY, digits=7)} FROM swept""")
def vol_target(spark, sf_dir):
    return out(monthly_stage(spark, sf_dir), "model", "scheme", "cost_mult", "yyyymm", *_MONTHLY,
               digits=7)


@query("borrow_cost_neutral", f"""
    SELECT model, scheme, yyyymm, {r(*_BASE)} FROM nbase""",
       oracle._accounting("w_neutral", "n"))
def borrow_cost_neutral(spark, sf_dir):
    book = materialise(weights.allocate(prediction_stage(spark, sf_dir), ["neutral"],
                                        SETTINGS.portfolio))
    return out(accounting.account(book, SETTINGS.costs), "model", "scheme", "yyyymm", *_BASE)


# ------------------------------------------------------------ forecast tables
_IC = {
    "ic_ranks": """
        SELECT model, yyyymm, rank() OVER (PARTITION BY model, yyyymm ORDER BY score)
               + (count(*) OVER (PARTITION BY model, yyyymm, score) - 1) / 2e0 AS a,
               rank() OVER (PARTITION BY model, yyyymm ORDER BY ret_next)
               + (count(*) OVER (PARTITION BY model, yyyymm, ret_next) - 1) / 2e0 AS b FROM preds""",
    "ics": "SELECT model, yyyymm, corr(a, b) AS ic FROM ic_ranks GROUP BY model, yyyymm",
    "ic_sums": f"""
        SELECT model, avg(ic) AS ic_mean, avg(ic) / stddev_samp(ic) AS ic_ir,
               avg(CASE WHEN ic > 0 THEN 1e0 ELSE 0 END) AS ic_hit, max(t) AS ic_t
        FROM ics JOIN ({t_stat('ics', 'model', 'ic')}) USING (model) GROUP BY model""",
    "fits": """
        SELECT model, count(*) AS n_obs, 100 * (1 - sum(pow(ret_next - my - beta * (score - mx), 2))
               / sum(ret_next * ret_next)) AS oos_r2_pct
        FROM preds JOIN (SELECT model, avg(score) AS mx, avg(ret_next) AS my,
                                regr_slope(ret_next, score) AS beta FROM preds GROUP BY model)
             USING (model) GROUP BY model""",
}


@query("monthly_ic", f"SELECT model, yyyymm, {r('ic')} FROM ics", _IC)
def monthly_ic(spark, sf_dir):
    return out(inference.monthly_ic(prediction_stage(spark, sf_dir)), "model", "yyyymm", "ic")


@query("monthly_ic_pearson", f"""
    SELECT model, yyyymm, {r('corr(score, ret_next)>ic')} FROM preds GROUP BY model, yyyymm""")
def monthly_ic_pearson(spark, sf_dir):
    return out(inference.monthly_ic(prediction_stage(spark, sf_dir), method="pearson"),
               "model", "yyyymm", "ic")


@query("statistical_table", f"""
    SELECT model, n_obs, {r('oos_r2_pct', 'ic_mean', 'ic_t', 'ic_ir', 'ic_hit', digits=7)}
    FROM fits JOIN ic_sums USING (model)""", _IC)
def statistical_table(spark, sf_dir):
    return out(tables.statistical_table(prediction_stage(spark, sf_dir)), "model", "n_obs",
               "oos_r2_pct", "ic_mean", "ic_t", "ic_ir", "ic_hit", digits=7)


@query("oos_r2", f"""
    SELECT model, {r('1 - sum(pow(ret_next_dm - score, 2)) / sum(ret_next_dm * ret_next_dm)>r2')}
    FROM preds GROUP BY model""")
def oos_r2(spark, sf_dir):
    df = prediction_stage(spark, sf_dir).groupBy("model").agg(
        inference.oos_r2(F.col("ret_next_dm"), F.col("score")).alias("r2"))
    return out(df)


@query("scale_to_target", f"""
    SELECT model, signalname, yyyymm, {r('my + beta * (score - mx)>fitted')}
    FROM preds JOIN (SELECT model, avg(score) AS mx, avg(ret_next) AS my,
                            regr_slope(ret_next, score) AS beta FROM preds GROUP BY model)
         USING (model)""")
def scale_to_target(spark, sf_dir):
    df = inference.scale_to_target(prediction_stage(spark, sf_dir), models=len(MODELS))
    return out(df, "model", "signalname", "yyyymm", "fitted")


@query("newey_west", f"""
    SELECT model, scheme, {r('t', digits=6)} FROM ({t_stat('monthly', 'model, scheme', 'turnover')})""")
def newey_west(spark, sf_dir):
    df = inference.newey_west(base_case(spark, sf_dir), ["model", "scheme"], "yyyymm", "turnover")
    return out(df, "model", "scheme", "t", digits=6)


@query("rolling_ic", f"""
    SELECT model, yyyymm, {r('yyyymm // 100 + (yyyymm % 100 - 1) / 12e0>year', 'rolling_ic')}
    FROM (SELECT *, CASE WHEN count(ic) OVER w >= 18 THEN avg(ic) OVER w END AS rolling_ic FROM ics
          WINDOW w AS (PARTITION BY model ORDER BY yyyymm ROWS BETWEEN 35 PRECEDING AND CURRENT ROW))
    WHERE rolling_ic IS NOT NULL""", _IC)
def rolling_ic(spark, sf_dir):
    return out(tables.rolling_ic(inference.monthly_ic(prediction_stage(spark, sf_dir))))


# --------------------------------------------------------- performance tables
_PERF = ("ret_gross", "ret_net", "vol", "sharpe_gross", "sharpe_net", "sharpe_net_se", "t_net",
         "max_dd", "skew", "turnover", "cost_drag", "hit_rate", "breakeven_bps")
_ECON = {"econ": performance("monthly", "model, scheme")}


@query("economic_table", f"""
    SELECT model, scheme, n_months, {r(*_PERF, digits=6)} FROM econ""", _ECON)
def economic_table(spark, sf_dir):
    return out(tables.economic_table(base_case(spark, sf_dir)), "model", "scheme", "n_months",
               *_PERF, digits=6)


@query("economic_table_schemes", f"""
    SELECT model, scheme, n_months, {r(*_PERF, digits=6)} FROM s_econ""",
       {"sbook": "SELECT * FROM w_tilt UNION ALL SELECT * FROM w_neutral UNION ALL "
                 "SELECT * FROM w_quantile UNION ALL SELECT * FROM w_equal"}
       | oracle._accounting("sbook", "s") | {"s_econ": performance("smonthly", "model, scheme")})
def economic_table_schemes(spark, sf_dir):
    book = materialise(tables.weight_book(
        prediction_stage(spark, sf_dir), SETTINGS, schemes=("tilt", "neutral", "quantile"),
        benchmark_of=BENCH_OF), "book")
    monthly = materialise(tables.monthly_results(book, SETTINGS), "monthly")
    return out(tables.economic_table(monthly), "model", "scheme", "n_months", *_PERF, digits=6)


@query("top_models", f"""
    SELECT model, {r('sharpe_net', digits=6)} FROM econ WHERE model <> 'equal_weight'
    ORDER BY sharpe_net DESC, model LIMIT 2""", _ECON)
def top_models(spark, sf_dir):
    econ = tables.economic_table(base_case(spark, sf_dir))
    return out(tables.top_models(econ, 2), "model", "sharpe_net", digits=6)


# Two schemes beside each other, so that no table mixes them.
_TWO = ({"sbook": "SELECT * FROM w_tilt UNION ALL SELECT * FROM w_neutral UNION ALL "
                  "SELECT * FROM w_equal"} | oracle._accounting("sbook", "s"))


def schemes_stage(spark, sf_dir) -> DataFrame:
    """Monthly rows of two schemes at every cost multiple."""
    def build():
        book = materialise(tables.weight_book(
            prediction_stage(spark, sf_dir), SETTINGS, schemes=("tilt", "neutral"),
            benchmark_of=BENCH_OF), "book")
        return tables.monthly_results(book, SETTINGS, multipliers=SETTINGS.costs.multipliers,
                                      groups=2400 * (2 * len(MODELS) + 1))
    return stage(spark, sf_dir, "schemes", build)


@query("strategy_returns", "SELECT yyyymm, " + r(*[
    f"max(CASE WHEN model = '{m}' AND scheme <> 'tilt' THEN net END)>{m}"
    for m in ("equal_weight", *MODELS)]) + " FROM smonthly GROUP BY yyyymm", _TWO)
def strategy_returns(spark, sf_dir):
    return out(tables.strategy_returns(schemes_stage(spark, sf_dir), ["equal_weight", *MODELS],
                                       "neutral"))


@query("cost_sensitivity", f"""
    SELECT model, scheme, {r('cost_mult', 'cost_mult * 25>cost_bps',
                             'avg(net) / stddev_samp(net) * sqrt(12e0)>sharpe_net',
                             'avg(net) * 12>ret_net', digits=6)}
    FROM sswept GROUP BY model, scheme, cost_mult""", _TWO)
def cost_sensitivity(spark, sf_dir):
    return out(tables.cost_sensitivity(schemes_stage(spark, sf_dir)), digits=6)


@query("cost_curve", f"""
    SELECT model, {r('cost_bps', 'sharpe_net', 'others_low', 'others_high', digits=6)}
    FROM curve LEFT JOIN (SELECT cost_bps, min(sharpe_net) AS others_low, max(sharpe_net) AS others_high
         FROM curve WHERE model IN ('lowvol', 'reversal') GROUP BY cost_bps) USING (cost_bps)
    WHERE model IN ('momentum', 'equal_weight')""",
       {"curve": """SELECT model, cost_mult * 25 AS cost_bps,
                           avg(net) / stddev_samp(net) * sqrt(12e0) AS sharpe_net
                    FROM swept GROUP BY model, cost_mult"""})
def cost_curve(spark, sf_dir):
    swept = tables.cost_sensitivity(monthly_stage(spark, sf_dir))
    return out(tables.cost_curve(swept, ["momentum"]), digits=6)


_PROFILE = {"profile": """
    SELECT model, scheme, avg(turnover) AS turnover, avg(switching) * 12 AS switching_ann,
           avg(carrying) * 12 AS carrying_ann, avg(gross) * 12 AS gross_ann, avg(net) * 12 AS net_ann
    FROM smonthly GROUP BY model, scheme"""} | _TWO


@query("turnover_profile", f"""
    SELECT model, scheme, {r('turnover', 'switching_ann', 'carrying_ann', 'gross_ann', 'net_ann', digits=7)}
    FROM profile""", _PROFILE)
def turnover_profile(spark, sf_dir):
    return out(tables.turnover_profile(schemes_stage(spark, sf_dir)), digits=7)


@query("cost_decomposition", f"""
    SELECT model, scheme, {r('net_ann', 'switching_ann', 'carrying_ann', 'greatest(net_ann, 0)>switching_from',
                     'greatest(net_ann, 0) + switching_ann>carrying_from', digits=7)}
    FROM profile""", _PROFILE)
def cost_decomposition(spark, sf_dir):
    profile = tables.turnover_profile(schemes_stage(spark, sf_dir))
    return out(tables.cost_decomposition(profile), digits=7)


_BLOCKS = {
    "blocks": """
        SELECT *, CASE WHEN yyyymm < 199807
                       THEN (min(yyyymm) OVER (PARTITION BY model, scheme)) // 100 || '-1998'
                       ELSE '1998-' || (max(yyyymm) OVER (PARTITION BY model, scheme)) // 100 END AS period
        FROM smonthly WHERE model <> 'equal_weight'""",
    "block_t": t_stat("blocks", "model, scheme, period", "net"),
    "block_dd": drawdowns("blocks", "model, scheme, period"),
} | _TWO


@query("decay_analysis", f"""
    SELECT model, scheme, period, count(net) AS n_months,
           {r('avg(net) * 12>ret_net', 'avg(net) / stddev_samp(net) * sqrt(12e0)>sharpe_net',
              'max(t)>t_net', 'min(dd)>max_dd', digits=6)}
    FROM block_dd JOIN block_t USING (model, scheme, period)
    GROUP BY model, scheme, period""", _BLOCKS)
def decay_analysis(spark, sf_dir):
    return out(tables.decay_analysis(schemes_stage(spark, sf_dir), (199807,)), "model", "scheme", "period",
               "n_months", "ret_net", "sharpe_net", "t_net", "max_dd", digits=6)


@query("sharpe_by_period", "SELECT period, " + r(*[
    f"max(CASE WHEN model = '{m}' THEN s END)>{m}" for m in MODELS], digits=6) + """
    FROM (SELECT model, period, avg(net) / stddev_samp(net) * sqrt(12e0) AS s FROM blocks
          WHERE scheme = 'tilt' GROUP BY model, period) GROUP BY period""", _BLOCKS)
def sharpe_by_period(spark, sf_dir):
    decay = tables.decay_analysis(schemes_stage(spark, sf_dir), (199807,))
    return out(tables.sharpe_by_bucket(decay, list(MODELS), "period"), digits=6)


@query("equity_curve", f"""
    SELECT model, scheme, yyyymm, {r('yyyymm // 100 + (yyyymm % 100 - 1) / 12e0>year', 'equity',
                                     'dd>drawdown')}
    FROM ({drawdowns('monthly', 'model, scheme')})""")
def equity_curve(spark, sf_dir):
    return out(tables.growth_of_one(base_case(spark, sf_dir)))


_VERSUS = {
    "pairs": """
        SELECT a.model, a.scheme, a.yyyymm, a.net AS y, b.net AS x, a.net - b.net AS act,
               row_number() OVER (PARTITION BY a.model, a.scheme ORDER BY a.yyyymm) AS o
        FROM smonthly a JOIN smonthly b ON b.yyyymm = a.yyyymm AND b.model = 'equal_weight'
        WHERE a.model <> 'equal_weight'""",
    "lines": """
        SELECT model, scheme, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b,
               regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, avg(act) AS act,
               stddev_samp(act) AS sd_act FROM pairs GROUP BY model, scheme""",
    "shares": """
        SELECT model, scheme, o, (1e0 / n - mx * (x - mx) / sxx) * (y - a - b * x) AS he
        FROM pairs JOIN lines USING (model, scheme)""",
    "errors": """
        SELECT p.model, p.scheme, sqrt(sum(CASE WHEN p.o = q.o THEN p.he * q.he
                                      ELSE 2 * (1 - (p.o - q.o) / 7e0) * p.he * q.he END)) AS se
        FROM shares p JOIN shares q ON p.model = q.model AND p.scheme = q.scheme
             AND q.o <= p.o AND p.o - q.o <= 6
        GROUP BY p.model, p.scheme""",
} | _TWO
_ALPHA = ("alpha_ann", "alpha_t", "beta_bench", "r2", "active_ann", "info_ratio", "t_active")


@query("alpha_vs_benchmark", f"""
    SELECT model, scheme, {r('a * 12>alpha_ann', 'a / se>alpha_t', 'b>beta_bench', 'r2', 'act * 12>active_ann',
                     'act / sd_act * sqrt(12e0)>info_ratio', 't>t_active', digits=6)}
    FROM lines JOIN errors USING (model, scheme)
         JOIN ({t_stat('pairs', 'model, scheme', 'act')}) USING (model, scheme)""",
       _VERSUS)
def alpha_vs_benchmark(spark, sf_dir):
    return out(tables.alpha_vs_benchmark(schemes_stage(spark, sf_dir)), "model", "scheme", *_ALPHA,
               digits=6)


_TERMS = {"mktrf": "mktrf", "smb": "smb", "hml": "hml", "const": "1e0"}


def _orthogonal_parts(last: str = "const", p: str = "") -> dict[str, str]:
    """Factors and constant by successive projection; the term that comes ``last`` gets
    its coefficient and, from its residual, the HAC weights."""
    one, two, three, four = [v for k, v in _TERMS.items() if k != last] + [_TERMS[last]]
    parts = _TWO | {
        f"{p}reg0": f"""
            SELECT model, scheme, yyyymm, net AS y, {one} AS z1, {two} AS x2, {three} AS x3, {four} AS x4,
                   net - avg(net) OVER (PARTITION BY model, scheme) AS yc
            FROM smonthly JOIN factors USING (yyyymm)"""}
    dot = ("sum({a} * {b}) OVER (PARTITION BY model, scheme) "
           "/ sum({b} * {b}) OVER (PARTITION BY model, scheme)")
    names = [["x2", "x3", "x4", "y"], ["x3", "x4", "y"], ["x4", "y"], ["y"]]
    for i, targets in enumerate(names, 1):
        z = f"z{i}"
        new = [f"{t} - ({dot.format(a=t, b=z)}) * {z} AS "
               + (f"z{i + 1}" if j == 0 and t != "y" else t) for j, t in enumerate(targets)]
        keep = [f"z{k}" for k in range(1, i + 1)] + ["model", "scheme", "yyyymm", "yc"]
        if i == 4:
            new.append(f"{dot.format(a='y', b=z)} AS alpha")
        parts[f"{p}reg{i}"] = f"SELECT {', '.join(keep + new)} FROM {p}reg{i - 1}"
    parts[f"{p}weights4"] = f"""
        SELECT model, scheme, alpha, y, yc,
               z4 / sum(z4 * z4) OVER (PARTITION BY model, scheme) * y AS he,
               row_number() OVER (PARTITION BY model, scheme ORDER BY yyyymm) AS o FROM {p}reg4"""
    parts[f"{p}hac4"] = f"""
        SELECT p.model, p.scheme, sum(CASE WHEN p.o = q.o THEN p.he * q.he
                                 ELSE 2 * (1 - (p.o - q.o) / 7e0) * p.he * q.he END) AS v
        FROM {p}weights4 p JOIN {p}weights4 q ON p.model = q.model AND p.scheme = q.scheme
             AND q.o <= p.o AND p.o - q.o <= 6
        GROUP BY p.model, p.scheme"""
    return parts


@query("factor_alpha", f"""
    SELECT model, scheme, max(n) AS n, {r('max(alpha) * 12>alpha_ann', 'max(alpha) / sqrt(max(v))>alpha_t',
                                  '1 - max(rss) / max(tss)>r2', digits=6)}
    FROM (SELECT model, scheme, max(alpha) AS alpha, count(*) AS n, sum(y * y) AS rss,
                 sum(yc * yc) AS tss FROM weights4 GROUP BY model, scheme)
         JOIN hac4 USING (model, scheme) GROUP BY model, scheme""",
       _orthogonal_parts())
def factor_alpha(spark, sf_dir):
    monthly = schemes_stage(spark, sf_dir)
    return out(tables.alpha_table(monthly, src.factors(spark, sf_dir), ["mktrf", "smb", "hml"]),
               "model", "scheme", "n", "alpha_ann", "alpha_t", "r2", digits=6)


@query("factor_regression_terms", " UNION ALL ".join(f"""
    SELECT model, scheme, '{t}' AS term, max(n) AS n,
           {r(f"max(alpha) * {12 if t == 'const' else 1}>coef", 'max(alpha) / sqrt(max(v))>t',
              '1 - max(rss) / max(tss)>r2', digits=6)}
    FROM (SELECT model, scheme, max(alpha) AS alpha, count(*) AS n, sum(y * y) AS rss,
                 sum(yc * yc) AS tss FROM {t}_weights4 GROUP BY model, scheme)
         JOIN {t}_hac4 USING (model, scheme) GROUP BY model, scheme""" for t in _TERMS),
       {k: v for t in _TERMS for k, v in _orthogonal_parts(t, f"{t}_").items()})
def factor_regression_terms(spark, sf_dir):
    """Every term's coefficient and HAC t."""
    long = inference.factor_regression(
        tables.base_costs(schemes_stage(spark, sf_dir)), src.factors(spark, sf_dir),
        cols=["mktrf", "smb", "hml"], series=tables.STRATEGY)
    return out(long, "model", "scheme", "term", "n", "coef", "t", "r2", digits=6)


@query("factor_table", f"""
    SELECT yyyymm, {r('mktrf', 'smb', 'hml', 'umd')} FROM factors LEFT JOIN (
        SELECT yyyymm, avg(ret_next) AS umd FROM preds WHERE model = 'momentum' AND score > 0
        GROUP BY yyyymm) USING (yyyymm)""")
def factor_table(spark, sf_dir):
    up = prediction_stage(spark, sf_dir).where((F.col("model") == "momentum") & (F.col("score") > 0))
    momentum = up.groupBy("yyyymm").agg(F.avg("ret_next").alias("mom"))
    five = src.factors(spark, sf_dir).withColumnRenamed("mktrf", "mkt_rf")
    return out(build_factors(five, momentum), "yyyymm", "mktrf", "smb", "hml", "umd")


@query("tilt_by_cost", f"""
    SELECT 'momentum' AS model, cost_quintile, count(*) AS n,
           {r('avg(weight - 1e0 / n)>mean_tilt', 'avg(turnover_raw)>mean_turnover')}
    FROM (SELECT *, CAST(greatest(1, ceil((k - 1) * 5 / (n - 1e0))) AS BIGINT) AS cost_quintile
          FROM (SELECT *, row_number() OVER (PARTITION BY yyyymm ORDER BY turnover_raw, signalname) AS k
                FROM (SELECT * REPLACE (round(turnover_raw, 10) AS turnover_raw) FROM w_tilt)
                WHERE model = 'momentum'))
    GROUP BY cost_quintile""")
def tilt_by_cost(spark, sf_dir):
    book = book_stage(spark, sf_dir).withColumn("turnover_raw", F.round("turnover_raw", 10))
    table = tables.tilt_by_cost_quintile(book, "momentum")
    return out(table, "model", "cost_quintile", "n", "mean_tilt", "mean_turnover")


@query("tilt_by_category", f"""
    SELECT 'momentum' AS model, category, count(*) AS count, {r('avg(tilt)>mean')}
    FROM (SELECT yyyymm, lower(replace(cat_economic, ' ', '_')) AS category,
                 avg(weight - 1e0 / n) AS tilt
          FROM w_tilt JOIN meta USING (signalname) WHERE model = 'momentum' GROUP BY ALL)
    GROUP BY category""")
def tilt_by_category(spark, sf_dir):
    table = tables.tilt_by_category(book_stage(spark, sf_dir), panel_stage(spark, sf_dir),
                                    "momentum")
    return out(table, "model", "category", "count", "mean")


def _metric_rank(metric: str) -> str:
    return f"""SELECT '{metric}' AS metric, {metric} AS v, sharpe_net AS s
               FROM fits JOIN ic_sums USING (model) JOIN econ USING (model)"""


@query("accuracy_versus_value", f"""
    SELECT metric, n_models, {r('rho>spearman_vs_sharpe_net',
        'CASE WHEN abs(rho) > 1 - 1e-12 THEN 0 ELSE 1 - 2 / pi() * atan(abs(rho) / sqrt(1 - rho * rho)) END>p_value',
        digits=6)}
    FROM (SELECT metric, count(*) AS n_models, corr(a, b) AS rho
    FROM (SELECT metric, rank() OVER (PARTITION BY metric ORDER BY v) AS a,
                 rank() OVER (PARTITION BY metric ORDER BY s) AS b
          FROM ({" UNION ALL ".join(_metric_rank(m) for m in ("ic_mean", "ic_t", "oos_r2_pct"))}))
    GROUP BY metric)""", _IC | _ECON)
def accuracy_versus_value(spark, sf_dir):
    """With three models the t distribution has one degree of freedom: an arc tangent."""
    table = tables.accuracy_versus_value(
        tables.statistical_table(prediction_stage(spark, sf_dir)),
        tables.economic_table(base_case(spark, sf_dir)))
    return out(table, "metric", "n_models", "spearman_vs_sharpe_net", "p_value", digits=6)


def two_universes(spark, sf_dir) -> DataFrame:
    """Predictions of all lots and of large lots, as one table."""
    wide = score_models(panel_stage(spark, sf_dir)).withColumn("universe", F.lit("all"))
    narrow = score_models(panel_stage(spark, sf_dir, 20.0)).withColumn("universe", F.lit("large"))
    return wide.unionByName(narrow)


def _narrow_parts() -> dict[str, str]:
    """The whole chain again on lots of at least twenty, every name prefixed ``x_``."""
    import re
    names = ["rets", "pit", "feat0", "feat", "idx", "idxfeat0", "idxfeat", "filled", "costed",
             "ahead", "target", "panel", "preds", "ranked", "devs", "w_equal", "w_tilt", "book",
             "mo", "held", "trade", "base", "netted", "sd", "swept", "monthly"]
    parts = {}
    for n in names:
        sql = oracle.PARTS[n]
        for m in names:
            sql = re.sub(rf"\b(FROM|JOIN)(\s+){m}\b", rf"\1\2x_{m}", sql)
        sql = sql.replace("SELECT rets.*", "SELECT x_rets.*")
        if n == "rets":
            sql = sql.replace("FROM lineitem", "FROM lineitem WHERE l_quantity >= 20")
        parts[f"x_{n}"] = sql
    return parts


_SHARPE = "avg(net) / stddev_samp(net) * sqrt(12e0)"


@query("capacity_comparison", f"""
    SELECT model, {r('a>all', 'b>large', 'b - a>delta', digits=6).replace("AS all", 'AS "all"')}
    FROM (SELECT model, {_SHARPE} AS a FROM monthly GROUP BY model)
    FULL JOIN (SELECT model, {_SHARPE} AS b FROM x_monthly GROUP BY model) USING (model)""",
       _narrow_parts())
def capacity_comparison(spark, sf_dir):
    preds = materialise(two_universes(spark, sf_dir), "universes")
    book = materialise(tables.weight_book(preds, SETTINGS, series=("universe", "model"),
                                          benchmark_of=BENCH_OF))
    series = ("universe", "model", "scheme")
    monthly = tables.monthly_results(book, SETTINGS, series=series)
    economic = tables.economic_table(monthly, series)
    return out(tables.capacity_comparison(economic, "all", "large"), digits=6)


_FULL = ("ret_gross", "ret_net", "sharpe_gross", "sharpe_net", "t_net", "turnover")


@query("capacity_full", f"""
    SELECT 'all' AS universe, model, {r(*_FULL, digits=6)} FROM e_all
    UNION ALL SELECT 'large', model, {r(*_FULL, digits=6)} FROM e_large""",
       _narrow_parts() | {
           "shared": "SELECT DISTINCT yyyymm FROM monthly SEMI JOIN x_monthly USING (yyyymm)",
           "m_all": "SELECT monthly.* FROM monthly SEMI JOIN shared USING (yyyymm)",
           "m_large": "SELECT x_monthly.* FROM x_monthly SEMI JOIN shared USING (yyyymm)",
           "e_all": performance("m_all", "model"), "e_large": performance("m_large", "model")})
def capacity_full(spark, sf_dir):
    """Both universes over the months they share."""
    preds = materialise(two_universes(spark, sf_dir), "universes")
    book = materialise(tables.weight_book(preds, SETTINGS, series=("universe", "model"),
                                          benchmark_of=BENCH_OF))
    series = ("universe", "model", "scheme")
    monthly = materialise(tables.monthly_results(book, SETTINGS, series=series), "monthly")
    economic = tables.economic_table(tables.common_months(monthly), series)
    return out(tables.capacity_full(economic), digits=6)


@query("capacity_rank_agreement", f"""
    SELECT {r('corr(ra, rb)>rho')} FROM (
        SELECT rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb
        FROM (SELECT model, {_SHARPE} AS a FROM monthly GROUP BY model)
        JOIN (SELECT model, {_SHARPE} AS b FROM x_monthly GROUP BY model) USING (model))""",
       _narrow_parts())
def capacity_rank_agreement(spark, sf_dir):
    return out(tables.rank_agreement(capacity_comparison(spark, sf_dir), "all", "large"))


# -------------------------------------------------------------------- folds
_FOLD_PARTS = {
    "cal": "SELECT DISTINCT yyyymm, yyyymm // 100 * 12 + yyyymm % 100 AS mi FROM panel",
    "marks": """
        SELECT y, y * 12 + 1 AS t0 FROM (SELECT unnest(generate_series(2000, 2001)) AS y)""",
    "fold_raw": """
        SELECT y, CASE WHEN mi >= t0 THEN 'test' WHEN mi >= t0 - 12 THEN 'val' ELSE 'train' END AS role,
               yyyymm FROM cal JOIN marks ON mi <= t0 + 11 AND mi >= 1994 * 12 + 1
                      AND (mi >= t0 - 12 OR mi < t0 - 18)""",
    "fold_keep": """
        SELECT y, min(CASE WHEN role = 'test' THEN yyyymm END) || '-'
                  || max(CASE WHEN role = 'test' THEN yyyymm END) AS fold
        FROM fold_raw GROUP BY y HAVING count(CASE WHEN role = 'train' THEN 1 END) >= 24
             AND count(CASE WHEN role = 'val' THEN 1 END) >= 12""",
    "folds": "SELECT fold, role, yyyymm FROM fold_raw JOIN fold_keep USING (y)",
}


def _folds(spark, sf_dir) -> DataFrame:
    months = folds.distinct_months(panel_stage(spark, sf_dir))
    return folds.walk_forward_folds(months, SETTINGS.split)


@query("walk_forward_folds", "SELECT fold, role, yyyymm FROM folds", _FOLD_PARTS)
def walk_forward_folds(spark, sf_dir):
    return _folds(spark, sf_dir)


_PLANTED = _FOLD_PARTS | {"planted": """
    SELECT fold, role, yyyymm FROM folds
    UNION ALL SELECT fold, 'train', yyyymm FROM folds WHERE role = 'val' AND fold LIKE '2000%'
    UNION ALL SELECT fold, 'val', yyyymm FROM folds WHERE role = 'test'
    UNION ALL SELECT 'again', role, yyyymm FROM folds WHERE role = 'test' AND fold LIKE '2000%'"""}


@query("leakage_check", """
    SELECT a.fold, 'train overlaps val' AS problem FROM planted a JOIN planted b ON a.fold = b.fold
           AND a.role = 'train' AND b.role = 'val' AND a.yyyymm >= b.yyyymm GROUP BY a.fold
    UNION ALL
    SELECT a.fold, 'val overlaps test' FROM planted a JOIN planted b ON a.fold = b.fold
           AND a.role = 'val' AND b.role = 'test' AND a.yyyymm >= b.yyyymm GROUP BY a.fold
    UNION ALL
    SELECT min(fold), 'month tested twice' FROM planted WHERE role = 'test' GROUP BY yyyymm
    HAVING count(*) > 1""", _PLANTED)
def leakage_check(spark, sf_dir):
    """The folds with overlaps of every sort planted among them."""
    good = _folds(spark, sf_dir)
    val, test = good.where("role = 'val'"), good.where("role = 'test'")
    early = F.col("fold").startswith("2000")
    return folds.leakage_violations(
        good.unionByName(val.where(early).withColumn("role", F.lit("train")))
        .unionByName(test.withColumn("role", F.lit("val")))
        .unionByName(test.where(early).withColumn("fold", F.lit("again"))))


_BREACHED = _FOLD_PARTS | {"breached": """
    SELECT fold, role, yyyymm FROM folds
    UNION ALL SELECT fold, 'train', CAST((t0 - 18 + k - 1) // 12 * 100 + (t0 - 18 + k - 1) % 12 + 1 AS INTEGER)
    FROM fold_keep JOIN marks USING (y), (SELECT unnest([1, 3]) AS k) WHERE y = 2001"""}


@query("embargo_check", """
    SELECT t.fold, 'embargo breached' AS problem
    FROM (SELECT fold, max(yyyymm // 100 * 12 + yyyymm % 100) AS hi FROM breached WHERE role = 'train' GROUP BY fold) t
    JOIN (SELECT fold, min(yyyymm // 100 * 12 + yyyymm % 100) AS lo FROM breached WHERE role = 'val' GROUP BY fold) v
         USING (fold) WHERE lo - hi - 1 < 6""", _BREACHED)
def embargo_check(spark, sf_dir):
    """The folds, with months of the last one's embargo planted among those it learns from."""
    good = _folds(spark, sf_dir)
    late = good.where((F.col("role") == "train") & F.col("fold").startswith("2001")).groupBy("fold", "role").agg(
        F.max(month_index(F.col("yyyymm"))).alias("hi"))
    planted = late.select("fold", "role", F.explode(F.array(F.col("hi") + 1, F.col("hi") + 3)).alias("mi"))
    planted = planted.select("fold", "role", from_month_index(F.col("mi")).alias("yyyymm"))
    return folds.leakage_violations(good.unionByName(planted), SETTINGS.split.embargo_months)


@query("fold_rows", f"""
    SELECT fold, role, count(*) AS n, {r('avg(ret_next)>mean_ret')}
    FROM panel JOIN folds USING (yyyymm) GROUP BY fold, role""", _FOLD_PARTS)
def fold_rows(spark, sf_dir):
    months = panel_stage(spark, sf_dir).groupBy("yyyymm").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ret_next").alias("s"), F.count("ret_next").alias("k"))
    rows = folds.fold_rows(months, _folds(spark, sf_dir))
    return out(rows.groupBy("fold", "role").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("s"), F.sum("k")).alias("mean_ret")))


_WINDOW_PARTS = {
    "ords": """SELECT yyyymm, row_number() OVER (ORDER BY yyyymm) AS k, count(*) OVER () AS n
               FROM (SELECT DISTINCT yyyymm FROM panel)""",
    "begins": """
        SELECT DISTINCT s FROM (SELECT max(n) AS n FROM ords) m, (
            SELECT unnest(generate_series(0, 2400, {stride})) AS s UNION ALL
            SELECT greatest(max(n) - {length}, 0) AS s FROM ords)
        WHERE s <= greatest(n - {length}, 0)""",
    "wins": """SELECT CAST(s AS INTEGER) AS win, CAST(k - s AS INTEGER) AS pos, yyyymm
               FROM ords JOIN begins ON k > s AND k <= s + {length}""",
}


def _window_parts(length: int, stride: int) -> dict[str, str]:
    return {n: q.replace("{length}", str(length)).replace("{stride}", str(stride))
            for n, q in _WINDOW_PARTS.items()}


@query("month_windows", 'SELECT win AS "window", pos, yyyymm FROM wins', _window_parts(32, 16))
def month_windows(spark, sf_dir):
    return folds.month_windows(folds.distinct_months(panel_stage(spark, sf_dir)), 32)


@query("densify", f"""
    SELECT win AS "window", c.pos, c.yyyymm, c.signalname,
           CASE WHEN p.ret IS NULL THEN 0 ELSE 1 END AS mask,
           {r('coalesce(ret_next_dm, 0)>y', 'coalesce(carry_cost, 0)>carry',
              'CASE WHEN p.ret IS NULL THEN 0 ELSE 5e-3 END>switch')},
           {r('coalesce(vol_12, 0)>x0', digits=5)}
    FROM (SELECT w.win, w.pos, w.yyyymm, a.signalname FROM wins w JOIN (
              SELECT DISTINCT win, signalname FROM panel JOIN wins USING (yyyymm)) a USING (win)) c
    LEFT JOIN panel p USING (signalname, yyyymm)""", _window_parts(32, 16))
def densify(spark, sf_dir):
    panel = panel_stage(spark, sf_dir)
    windows = folds.month_windows(folds.distinct_months(panel), 32)
    cells = folds.densify(panel, windows, ["vol_12"], SETTINGS.costs)
    flat = cells.withColumn("x0", F.get("x", 0))
    return out(flat, "window", "pos", "yyyymm", "signalname", "mask", "y", "carry", "switch", "x0",
               coarse={"x0": 5})


@query("encode_ids", """
    SELECT signalname, CAST(row_number() OVER (ORDER BY signalname) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT signalname FROM panel)""")
def encode_ids(spark, sf_dir):
    return folds.encode_ids(panel_stage(spark, sf_dir))


# ---------------------------------------------------------------- objectives
_OBJ_PARTS = _window_parts(24, 24) | {
    "orows": """
        SELECT model, win, pos, signalname, score, ret_next_dm AS y, carry_cost AS carry, 5e-3 AS sw,
               count(*) OVER m AS n, avg(score) OVER m AS mean
        FROM preds JOIN wins USING (yyyymm) WINDOW m AS (PARTITION BY model, win, pos)""",
    "ow": """
        SELECT *, 1e0 / n + (score - mean) / greatest(sum(abs(score - mean)) OVER (
                  PARTITION BY model, win, pos), 1e-8) AS w FROM orows""",
    "onav": """
        SELECT model, win, signalname, pos + 1 AS pos, w * (1 + y) / greatest(1 + sum(w * y) OVER (
               PARTITION BY model, win, pos), 1e-1) AS prior FROM ow""",
    "omonths": """
        SELECT model, win, pos, sum(w * y) AS gross, sum(move) AS turnover,
               sum(sw * move + carry * abs(w)) AS cost
        FROM (SELECT ow.*, sqrt(pow(w - coalesce(prior, 0), 2) + 1e-8) - 1e-4 AS move
              FROM ow LEFT JOIN onav USING (model, win, signalname, pos)) GROUP BY model, win, pos""",
    "oic": """
        SELECT model, win, pos, sum((score - mean) * (y - my)) / (
                   sqrt(greatest(sum(pow(score - mean, 2)), 1e-8))
                   * sqrt(greatest(sum(pow(y - my, 2)), 1e-8))) AS ic
        FROM (SELECT *, avg(y) OVER (PARTITION BY model, win, pos) AS my FROM orows)
        GROUP BY model, win, pos""",
}
_OBJ_SQL = {
    "mse": "SELECT model, win, count(DISTINCT pos) AS n_months, avg(pow(score - y, 2)) AS loss "
           "FROM orows GROUP BY model, win",
    "huber": """SELECT model, win, count(DISTINCT pos) AS n_months, avg(CASE WHEN abs(score - y) <= 2e-2
        THEN 5e-1 * pow(score - y, 2) ELSE 2e-2 * (abs(score - y) - 1e-2) END) AS loss
        FROM orows GROUP BY model, win""",
    "ic": "SELECT model, win, count(*) AS n_months, -avg(ic) AS loss FROM oic GROUP BY model, win",
    "sharpe": """SELECT model, win, count(*) AS n_months, -avg(gross - cost)
        / greatest(stddev_samp(gross - cost), 1e-8) * sqrt(12e0) AS loss
        FROM omonths GROUP BY model, win""",
    "utility": """SELECT model, win, count(*) AS n_months, -(avg(gross - cost)
        - 5 * var_samp(gross - cost)) AS loss FROM omonths GROUP BY model, win""",
}


def objective_rows(spark, sf_dir, length: int = 24) -> DataFrame:
    """Every model's scores in non-overlapping windows of the panel's months."""
    preds = prediction_stage(spark, sf_dir)
    windows = folds.month_windows(folds.distinct_months(panel_stage(spark, sf_dir)), length, length)
    rows = folds.window_rows(preds, windows)
    return materialise(rows.select(
        "model", "window", "pos", "signalname", "score", F.col("ret_next_dm").alias("y"),
        F.col("carry_cost").alias("carry"), F.col("switch_cost").alias("switch")), "rows")


def _objective(name: str):
    def run(spark, sf_dir):
        rows = objective_rows(spark, sf_dir)
        return out(objectives.objective_by_window(rows, name), "model", "window", "n_months", "loss", digits=7)
    return run


for _name, _sql in _OBJ_SQL.items():
    query(f"objective_{_name}", f"""
        SELECT model, win AS "window", n_months, {r('loss', digits=7)} FROM ({_sql})""",
          _OBJ_PARTS)(_objective(_name))


@query("objective_portfolio_months", f"""
    SELECT model, win AS "window", pos, {r('gross', 'cost', 'turnover', digits=7)} FROM omonths""", _OBJ_PARTS)
def objective_portfolio_months(spark, sf_dir):
    rows = objective_rows(spark, sf_dir)
    section = measure(rows, objectives.cell_of(rows))
    held = objectives.with_prior(objectives.raw_weights(rows, "tilt", section=section), section)
    return out(objectives.portfolio_months(held), digits=7)


@query("objective_raw_weights", f"""
    SELECT model, win AS "window", pos, signalname, {r('w>tilt', '2 * (w - 1e0 / n)>neutral')} FROM ow""",
       _OBJ_PARTS)
def objective_raw_weights(spark, sf_dir):
    rows = objective_rows(spark, sf_dir)
    section = measure(rows, objectives.cell_of(rows))
    tilt = objectives.raw_weights(rows, "tilt", section=section).withColumnRenamed("w", "tilt")
    both = objectives.raw_weights(tilt.drop("dev", "l1", "_cells"), "neutral", section=section)
    return out(both.withColumnRenamed("w", "neutral"), "model", "window", "pos", "signalname", "tilt",
               "neutral")


@query("evaluate_objective", f"""
    SELECT model, CAST(sum(n_months) AS BIGINT) AS n_months,
           {r('sum(loss * n_months) / sum(n_months)>loss', digits=7)}
    FROM ({_OBJ_SQL['sharpe']}) GROUP BY model""", _OBJ_PARTS)
def evaluate_objective(spark, sf_dir):
    rows = objective_rows(spark, sf_dir)
    return out(objectives.evaluate_objective(rows, "sharpe"), "model", "n_months", "loss", digits=7)


# Derivatives of a window's loss to a row's score, written out.
_SLOPES = {
    "mse": """SELECT *, 2 * (score - y) / count(*) OVER (PARTITION BY model, win) AS ds FROM orows""",
    "huber": """SELECT *, greatest(least(score - y, 2e-2), -2e-2)
                       / count(*) OVER (PARTITION BY model, win) AS ds FROM orows""",
    "ic": """
        SELECT *, -((y - my) - CASE WHEN pp > 1e-8 THEN pt * (score - mean) / pp ELSE 0 END)
                  / sqrt(greatest(pp, 1e-8) * greatest(tt, 1e-8)) / months AS ds
        FROM (SELECT *, sum(pow(score - mean, 2)) OVER m AS pp, sum(pow(y - my, 2)) OVER m AS tt,
                     sum((score - mean) * (y - my)) OVER m AS pt,
                     max(pos) OVER (PARTITION BY model, win) AS months
              FROM (SELECT *, avg(y) OVER (PARTITION BY model, win, pos) AS my FROM orows)
              WINDOW m AS (PARTITION BY model, win, pos))""",
}


def _gradient(name: str):
    def run(spark, sf_dir):
        rows = objective_rows(spark, sf_dir)
        return out(objectives.score_gradient(rows, name), "model", "window", "pos", "signalname",
                   "ds", coarse={"ds": 7})
    return run


for _name, _sql in _SLOPES.items():
    query(f"objective_gradient_{_name}", f"""
        SELECT model, win AS "window", pos, signalname, {r('ds', digits=7)} FROM ({_sql})""",
          _OBJ_PARTS)(_gradient(_name))


# ------------------------------------------------------------------ learners
_XS = ("vol_12", "r_12_2")
_FIT_PARTS = _FOLD_PARTS | {
    "xy": """SELECT fold, role, yyyymm, signalname, ret_next_dm * 100 AS y,
                    coalesce(vol_12, 0) * 100 AS a, coalesce(r_12_2, 0) * 100 AS b
             FROM panel JOIN folds USING (yyyymm)""",
    "mm": """SELECT fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, regr_sxx(y, a) AS aa,
                    regr_sxx(y, b) AS bb, regr_sxy(b, a) AS ab, regr_sxy(y, a) AS ay,
                    regr_sxy(y, b) AS byy, count(*) AS n FROM xy WHERE role = 'train' GROUP BY fold""",
    "coefs": " UNION ALL ".join(
        [f"""SELECT fold, 'ridge' AS model, '{name}' AS param,
                    ((bb + {a}) * ay - ab * byy) / ((aa + {a}) * (bb + {a}) - ab * ab) AS b1,
                    ((aa + {a}) * byy - ab * ay) / ((aa + {a}) * (bb + {a}) - ab * ab) AS b2 FROM mm"""
         for a, name in ((1e1, "10"), (1e2, "100"), (1e3, "1000"), (1e4, "10000"), (1e5, "100000"))]
        + ["""SELECT fold, 'ols', '', (bb * ay - ab * byy) / (aa * bb - ab * ab),
                     (aa * byy - ab * ay) / (aa * bb - ab * ab) FROM mm""",
           "SELECT fold, model, param, b1, b2 FROM nets",
           """SELECT fold, 'pls', '1', ay * q, byy * q FROM (
                  SELECT *, (ay * ay + byy * byy) / (ay * ay * aa + 2 * ay * byy * ab + byy * byy * bb)
                         AS q FROM mm)""",
           """SELECT fold, 'pls', '2', (bb * ay - ab * byy) / (aa * bb - ab * ab),
                     (aa * byy - ab * ay) / (aa * bb - ab * ab) FROM mm"""]),
    "grid": "SELECT a, l FROM unnest([1e-5, 1e-4, 1e-3]) AS t(a), unnest([1e-1, 5e-1, 9e-1]) AS u(l)",
    "descent": """
        SELECT * FROM (WITH RECURSIVE step AS (
            SELECT fold, a, l, 0 AS i, 0e0 AS b1, 0e0 AS b2 FROM mm, grid
            UNION ALL
            SELECT s.fold, s.a, s.l, i + 1,
                   sign(ay / n - ab / n * s.b2) * greatest(abs(ay / n - ab / n * s.b2) - s.a * s.l, 0)
                       / (aa / n + s.a * (1 - s.l)),
                   sign(byy / n - ab / n * s.b1) * greatest(abs(byy / n - ab / n * s.b1) - s.a * s.l, 0)
                       / (bb / n + s.a * (1 - s.l))
            FROM step s JOIN mm USING (fold) WHERE i < 400)
        SELECT * FROM step WHERE i = 400)""",
    "nets": "SELECT fold, 'enet' AS model, a || '-' || l AS param, b1, b2 FROM descent",
    "tried": """
        SELECT c.fold, c.model, c.param, c.b1, c.b2, max(my - b1 * ma - b2 * mb) AS b0,
               avg(pow(y - (my - b1 * ma - b2 * mb) - b1 * a - b2 * b, 2)) AS mse
        FROM coefs c JOIN mm USING (fold) JOIN xy USING (fold) WHERE role = 'val' GROUP BY ALL""",
    "picked": """
        SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY fold, model ORDER BY mse) = 1""",
}


def _moment_panel(spark, sf_dir) -> DataFrame:
    keep = ["signalname", "yyyymm", "ret_next"]
    return panel_stage(spark, sf_dir).select(
        *keep, *[(F.col(c) * 100).alias(c) for c in ("ret_next_dm", *_XS)])


_LEAST_SQUARES = tuple(learners.ModelSpec(n) for n in ("ols", "ridge", "enet", "pls"))


@query("baseline_fits", f"""
    SELECT fold, model, {r('b0>intercept', 'b1', 'b2', digits=6)} FROM picked""", _FIT_PARTS)
def baseline_fits(spark, sf_dir):
    _, fits, _ = run_walk_forward(_moment_panel(spark, sf_dir), list(_XS), SETTINGS, _LEAST_SQUARES)
    flat = fits.withColumns({"b1": F.get("beta", 0), "b2": F.get("beta", 1)})
    return out(flat, "fold", "model", "intercept", "b1", "b2", digits=6)


@query("walk_forward_predictions", f"""
    SELECT signalname, yyyymm, fold, model, {r('CAST(b0 + b1 * a + b2 * b AS FLOAT)>score', digits=4)}
    FROM xy JOIN picked USING (fold) WHERE role = 'test'""", _FIT_PARTS)
def walk_forward_predictions(spark, sf_dir):
    preds, _, _ = run_walk_forward(_moment_panel(spark, sf_dir), list(_XS), SETTINGS,
                                   _LEAST_SQUARES)
    return out(preds, "signalname", "yyyymm", "fold", "model", "score", digits=4)


@query("predictions_roundtrip", f"""
    SELECT model, yyyymm, signalname, {r('score', 'ret_next')} FROM preds WHERE model <> 'lowvol'""")
def predictions_roundtrip(spark, sf_dir):
    """Written by model and read back for some of the models."""
    path = f"{stage_dir(spark)}/run-{uuid.uuid4().hex}"
    prediction_stage(spark, sf_dir).write.partitionBy("model").parquet(f"{path}/predictions")
    return out(read_predictions(spark, path, ["momentum", "reversal"]), "model", "yyyymm",
               "signalname", "score", "ret_next")


@query("rounded_table_csv", """
    SELECT model, scheme, n_months, round(ret_net + 1e-12, 4) + 0e0 AS ret_net,
           round(turnover + 1e-12, 3) + 0e0 AS turnover, round(skew + 1e-12, 2) + 0e0 AS skew FROM econ""",
       _ECON)
def rounded_table_csv(spark, sf_dir):
    """A finished table, rounded, written as CSV and read back."""
    path = f"{stage_dir(spark)}/table-{uuid.uuid4().hex}"
    write_csv(tables.rounded(tables.economic_table(base_case(spark, sf_dir))), path)
    return spark.read.csv(path, header=True, inferSchema=True).select(
        "model", "scheme", F.col("n_months").cast("long").alias("n_months"),
        *[(F.col(c).cast("double") + 0.0).alias(c) for c in ("ret_net", "turnover", "skew")])


@query("ensemble_average", f"""
    SELECT yyyymm, signalname, {r('avg((score - mu) / greatest(sd, 1e-6))>score')}
    FROM preds JOIN (SELECT model, yyyymm, avg(score) AS mu, stddev_pop(score) AS sd FROM preds
                     GROUP BY model, yyyymm) USING (model, yyyymm) GROUP BY yyyymm, signalname""")
def ensemble_average(spark, sf_dir):
    averaged = learners.ensemble_average(prediction_stage(spark, sf_dir), member="model",
                                         groups=len(MODELS) * 2400)
    return out(averaged)


from panelyard.plans import learner_queries  # noqa: E402,F401  (registers more queries)
