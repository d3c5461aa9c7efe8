import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyard.operators.metadata import common_levels
from panelyard.sources import files as S
from panelyard.sources.store import refresh_months, stage_dir, stored

TEXT = """This file was made up for a test.
Missing data are coded -99.99.

,Mkt-RF,SMB,RF
192607,  2.96, -2.30, 0.22
192608,  2.64, -99.99, 0.25

  Annual Factors:
,Mkt-RF,SMB,RF
  1927, 29.47, -2.46, 3.12
192701, 1, 2, 3
"""


def test_factor_text(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text(TEXT)
    got = S.read_factor_text(spark, str(path)).orderBy("yyyymm").toPandas()
    assert list(got.columns) == ["yyyymm", "mktrf", "smb", "rf"]
    assert list(got["yyyymm"]) == [192607, 192608]
    assert abs(got["mktrf"].iloc[0] - 0.0296) < 1e-12 and pd.isna(got["smb"].iloc[1])


def test_factor_text_without_a_block(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("nothing\nhere\n")
    with pytest.raises(ValueError):
        S.read_factor_text(spark, str(path))


def test_factors_join_momentum(spark):
    five = spark.createDataFrame([(1, 0.1), (2, 0.2)], "yyyymm int, mkt_rf double")
    mom = spark.createDataFrame([(1, 0.5)], "yyyymm int, mom double")
    got = S.build_factors(five, mom).orderBy("yyyymm").collect()
    assert got[0].asDict() == {"yyyymm": 1, "mktrf": 0.1, "umd": 0.5} and got[1]["umd"] is None


def test_portfolio_returns(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("signalname,port,date,ret,Nlong,Nshort\n"
                    "BM,LS,1999-12-31,1.5,10,20\nBM,01,1999-12-31,9,1,1\n"
                    "BM,ls,2000-01-31,NA,10,20\nAcc,LS,2000-02-29,,3,4\n"
                    "BM,LS,1999-12-31,1.5,10,20\n")
    df = S.read_portfolio_returns(spark, str(path), "ex_price5")
    rows = S.long_short_returns(df).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["yyyymm"], row["universe"]) == (199912, "ex_price5")
    assert abs(row["ret"] - 0.015) < 1e-15 and abs(row["log_breadth"] - 3.4339872) < 1e-6
    with pytest.raises(KeyError):
        S.read_portfolio_returns(spark, str(path), "everything")


def test_signals_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("permno,yyyymm,BM,Mom\n1,200001,0.5,\n2,200001,,3\n")
    got = S.signals_csv_to_parquet(spark, str(tmp_path / "s.csv"), str(tmp_path / "s.parquet"))
    assert [f.dataType.typeName() for f in got.schema] == ["integer", "integer", "float", "float"]
    rows = {r["permno"]: r for r in got.collect()}
    assert rows[1]["BM"] == 0.5 and rows[1]["Mom"] is None and rows[2]["BM"] is None


def test_metadata(spark):
    raw = spark.createDataFrame(
        [("BM", "1980", "n/a", "x"), ("BM", "1980", "n/a", "x"), ("Mom", "1993", "2.5", "y")],
        "Acronym string, Year string, `T-Stat` string, `Cat.Economic` string")
    got = {r["signalname"]: r for r in S.load_metadata(raw).collect()}
    assert got["BM"]["pub_year"] == 1980.0 and got["BM"]["orig_tstat"] is None
    assert got["Mom"]["orig_tstat"] == 2.5 and got["Mom"]["cat_economic"] == "y"


def test_common_levels_break_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,), (None,), (None,)], "k string")
    assert common_levels(df, ["k"], 2) == {"k": ["c", "a"]}


def test_stored_tables_are_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    assert stored(spark, path, build).count() == 3 and stored(spark, path, build).count() == 3
    assert len(calls) == 1
    stored(spark, path, build, force=True)
    assert len(calls) == 2


def test_killed_writes_are_built_again(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    (tmp_path / "t" / "_SUCCESS").unlink()            # as a killed write leaves it
    assert stored(spark, path, lambda: spark.range(3)).count() == 3

    def broken():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        stored(spark, path, broken, force=True)
    assert stored(spark, path, broken).count() == 3   # the old table is still there
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_a_month_is_refreshed_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(a, m, float(m + i)) for i, a in enumerate("xyz") for m in range(200001, 200011)
                                  if (i + m) % 4], "signalname string, yyyymm int, v double")

    def build(df):
        own = Window.partitionBy("signalname").orderBy("yyyymm")
        return df.select("signalname", "yyyymm", F.sum("v").over(own.rowsBetween(-2, 0)).alias("s"))

    stored(spark, path, lambda: build(rows.where("yyyymm < 200010")), partition_by=("yyyymm",))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    got = refresh_months(spark, path, rows, [200010], build, 2)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert all(after[p] == t for p, t in before.items())
    assert {p.parent.name for p in set(after) - set(before)} == {"yyyymm=200010"}
    assert sorted(map(tuple, got.select("signalname", "yyyymm", "s").collect())) == sorted(map(tuple, build(rows).collect()))
    changed = rows.withColumn("v", F.when(F.col("yyyymm") == 200005, 0.0).otherwise(F.col("v")))
    got = refresh_months(spark, path, changed, range(200005, 200011), build, 2)
    assert sorted(map(tuple, got.select("signalname", "yyyymm", "s").collect())) == sorted(map(tuple, build(changed).collect()))
    (tmp_path / "t" / "_SUCCESS").unlink()
    with pytest.raises(ValueError):
        refresh_months(spark, path, rows, [200010], build, 2)
    assert stored(spark, path, lambda: build(rows), partition_by=("yyyymm",)).count() == rows.count()


def test_factor_files_of_unlike_headers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Prose, with commas\n,Mkt-RF,SMB\n200001, 1.0, -99.99\n200002, 2.0, 3.0\n\n,HML\n200003, 9.0\n")
    (tmp_path / "b.txt").write_text(",SMB,RMW,CMA\r\n200001, 5.0, x, 7.0\r\n200004, 8.0, 1.0, 2.0\r\n")
    (tmp_path / "c.txt").write_text("nothing monthly here\n")
    got = {r["yyyymm"]: r.asDict() for r in S.read_factor_text(spark, str(tmp_path)).collect()}
    assert list(next(iter(got.values()))) == ["yyyymm", "mktrf", "smb", "rmw", "cma"]
    assert sorted(got) == [200001, 200002, 200004]
    assert got[200001] == {"yyyymm": 200001, "mktrf": 0.01, "smb": 0.05, "rmw": None, "cma": 0.07}
    assert got[200002]["smb"] == 0.03 and got[200004]["mktrf"] is None and got[200004]["rmw"] == 0.01


def test_stage_folder_is_the_clusters(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert shared is None or stage_dir(spark).startswith(f"{shared.rstrip('/')}/stages-")


def test_csv_sink(spark, tmp_path):
    S.write_csv(spark.createDataFrame([(1, 2.5)], "a int, b double"), str(tmp_path / "o"))
    assert spark.read.csv(str(tmp_path / "o"), header=True).first()["b"] == "2.5"
