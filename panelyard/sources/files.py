"""Text and CSV inputs, table outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.config import PORTFOLIO_SETS
from panelyard.functions.scalars import finite
from panelyard.sources.store import attach

# Columns of the signal documentation and the names used here.
DOC_FIELDS = {
    "Acronym": "signalname", "Year": "pub_year", "SampleEndYear": "sample_end_year",
    "SampleStartYear": "sample_start_year", "T-Stat": "orig_tstat", "Return": "orig_ret",
    "Portfolio Period": "holding_months", "LS Quantile": "ls_quantile",
    "Stock Weight": "stock_weight", "Cat.Economic": "cat_economic", "Cat.Data": "cat_data",
    "Cat.Form": "cat_form",
}
DOC_NUMBERS = ("pub_year", "sample_end_year", "sample_start_year", "orig_tstat", "orig_ret",
               "holding_months", "ls_quantile")
MISSING_BELOW = -99.0  # factor files code missing values as -99.99


def header_of(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def signals_schema(columns: list[str], ids=("permno", "yyyymm")) -> T.StructType:
    return T.StructType([T.StructField(c, T.IntegerType() if c in ids else T.FloatType())
                         for c in columns])


def read_signals_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Wide firm-signal CSV: integer ids, every other column a nullable, finite float."""
    schema = signals_schema(columns or header_of(spark, path))
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*[finite(F.col(f"`{f.name}`")).cast("float").alias(f.name)
                       if f.dataType == T.FloatType() else F.col(f"`{f.name}`")
                       for f in schema.fields])


def signals_csv_to_parquet(spark: SparkSession, source: str, target: str) -> DataFrame:
    df = read_signals_csv(spark, source)
    df.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def read_portfolio_returns(spark: SparkSession, path: str, universe: str = "op") -> DataFrame:
    """Portfolio returns with a fixed schema; ``NA`` and empty fields are NULL."""
    if universe not in PORTFOLIO_SETS:
        raise KeyError(f"unknown portfolio set {universe!r}; have {sorted(PORTFOLIO_SETS)}")
    numbers = {"ret", "nlong", "nshort", "signallag"}
    schema = T.StructType([
        T.StructField(c, T.DoubleType() if c.lower() in numbers else T.StringType())
        for c in header_of(spark, path)])
    df = (spark.read.schema(schema).option("header", True).option("nullValue", "NA")
          .option("emptyValue", None).csv(path))
    numeric = [f.name for f in schema.fields if f.dataType == T.DoubleType()]
    df = df.withColumns({c: finite(F.col(c)) for c in numeric})
    return df.withColumn("universe", F.lit(universe))


def long_short_returns(df: DataFrame) -> DataFrame:
    """(signalname, yyyymm, ret[, log_breadth][, universe]) of the long-short leg.

    Input returns are in percent. A repeated key keeps one row, the smallest by value,
    so reruns agree.
    """
    for c in df.columns:
        if c.lower() in ("port", "date", "ret") and c != c.lower():
            df = df.withColumnRenamed(c, c.lower())
    if "port" in df.columns:
        df = df.where(F.upper(F.col("port").cast("string")) == "LS")
    digits = F.regexp_replace(F.col("date").cast("string"), "-", "")
    keys = [c for c in ("universe",) if c in df.columns] + ["signalname", "yyyymm"]
    values = [(F.col("ret") / 100.0).alias("ret")]
    if {"Nlong", "Nshort"} <= set(df.columns):
        names = F.col("Nlong").cast("double") + F.col("Nshort").cast("double")
        values.append(F.log1p(names).alias("log_breadth"))
    df = df.withColumn("yyyymm", F.substring(digits, 1, 6).cast("int"))
    df = df.select(*keys, *values).where(F.col("ret").isNotNull())
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_v")).select(*keys, "_v.*")


def load_metadata(df: DataFrame) -> DataFrame:
    """Documented fields under their short names, one row per asset."""
    have = {k: v for k, v in DOC_FIELDS.items() if k in df.columns}
    out = df.select(*[
        (F.col(f"`{k}`").try_cast("double") if v in DOC_NUMBERS else F.col(f"`{k}`")).alias(v)
        for k, v in have.items()])
    rest = [c for c in out.columns if c != "signalname"]
    return (out.groupBy("signalname").agg(F.min(F.struct(*rest)).alias("_v"))
            .select("signalname", "_v.*"))


def factor_values(lines: DataFrame) -> DataFrame:
    """(file, yyyymm, place, factor, value) of the first block of monthly rows of each file.

    ``lines`` has (file, line, text). A file's block is its first run of lines whose first field is six
    digits; its column names come from its first line with as many fields as the block's first
    line and an empty first one. Each file is one window partition of a few hundred kilobytes, and
    any number of files goes through one plan.
    """
    fields = F.transform(F.split("text", ","), lambda s: F.trim(s))
    df = lines.withColumn("_f", fields).withColumn("_k", F.get(F.col("_f"), 0))
    whole = Window.partitionBy("file")
    so_far = whole.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("_k").rlike(r"^\d{6}$")
    df = df.withColumn("_hit", hit).withColumn("_started", F.max(hit.cast("int")).over(so_far))
    ended = (F.col("_started") == 1) & ~F.col("_hit")
    df = df.withColumn("_ended", F.max(ended.cast("int")).over(so_far))
    inside = (F.col("_started") == 1) & (F.col("_ended") == 0)
    df = df.withColumn("_in", inside)
    df = df.withColumn("_width", F.min(F.when(F.col("_in"), F.struct("line", F.size("_f").alias("w"))))
                       .over(whole)["w"])
    heads = (F.size("_f") == F.col("_width")) & (F.col("_k") == "")
    df = df.withColumn("_names", F.min(F.when(heads, F.struct("line", "_f"))).over(whole)["_f"])
    cells = df.where("_in").select("file", F.col("_k").cast("int").alias("yyyymm"), "_names",
                                   F.posexplode("_f").alias("place", "_text")).where("place > 0")
    name = F.regexp_replace(F.lower(F.get("_names", F.col("place"))), "-", "")
    v = F.col("_text").try_cast("double")
    return cells.select("file", "yyyymm", "place", F.coalesce(name, F.concat(F.lit("f"), F.col("place") - 1))
                        .alias("factor"), F.when(v > MISSING_BELOW, v / 100.0).alias("value"))


def parse_factor_text(lines: DataFrame, header: list[str] | None = None) -> DataFrame:
    """(yyyymm, one column per factor): the blocks of all files side by side, by name.

    Where two files have a month of one factor, the first file by name that has a value gives it.
    With ``header`` the columns of every file get these names in order and nothing is read
    ahead; else the factors' names are looked up once.
    """
    cells = factor_values(lines)
    if header is not None:
        names = list(dict.fromkeys(header))
        cells = cells.withColumn("factor", F.get(F.array(*map(F.lit, header)), F.col("place") - 1))
    else:
        found = cells.groupBy("factor").agg(F.min(F.struct("file", "place")).alias("at"))
        names = [r["factor"] for r in found.orderBy("at").collect()]   # one row per column
        if not names:
            raise ValueError("no monthly block found")
    given = F.when(F.col("value").isNotNull(), F.col("file"))
    return cells.groupBy("yyyymm").agg(*[
        F.min_by(F.when(F.col("factor") == n, F.col("value")), F.when(F.col("factor") == n, given)).alias(n)
        for n in names])


def read_factor_text(spark: SparkSession, path: str | list[str], header: list[str] | None = None) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")))
    return parse_factor_text(whole.toDF("file", "line", "text"), header)


def build_factors(five: DataFrame, momentum: DataFrame) -> DataFrame:
    """Factors with momentum as ``umd`` and the market column named ``mktrf``."""
    second = next(c for c in momentum.columns if c != "yyyymm")
    umd = momentum.select("yyyymm", F.col(second).alias("umd"))
    out = attach(five, umd, ["yyyymm"], 2400)
    if "mktrf" not in out.columns:
        market = [c for c in out.columns if c.startswith("mkt")]
        if market:
            out = out.withColumnRenamed(market[0], "mktrf")
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """A finished (small, already rounded) table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
