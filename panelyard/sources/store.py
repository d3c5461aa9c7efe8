"""Stage tables: where a plan is cut, and how a small side is attached.

A stage that several later passes read is written once as parquet into the
shared folder the cluster names in ``spark.checkpoint.dir``. Unlike a cached or
locally checkpointed frame it survives lost executors, and unlike
``checkpoint()`` it keeps column pruning and row-group filters for its readers.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A side is hinted as broadcast only when its row count is proven to be below
# this; otherwise the planner decides from real sizes (AQE, skew-join splits).
BROADCAST_ROWS = 500_000

_own_dirs: dict[str, str] = {}
_owned: set[str] = set()


def _own(spark: SparkSession, base: str) -> None:
    """The application owns its stages: its file system removes them when it ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    _owned.add(base)


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for stage tables; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if shared:
        base = f"{shared.rstrip('/')}/stages-{sc.applicationId}"
        if base not in _owned:
            _own(spark, base)
        return base
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = sc.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-stages-")
    return _own_dirs[app]


def write_stage(df: DataFrame, name: str = "stage") -> str:
    path = f"{stage_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back."""
    return df.sparkSession.read.schema(df.schema).parquet(write_stage(df, name))


def _files(spark: SparkSession, path: str):
    """The file system of ``path``, and ``path`` in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _marker(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")


def is_finished(spark: SparkSession, path: str) -> bool:
    """Whether a table's write was committed: a single file, or a folder with the writer's marker."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return False
    return fs.getFileStatus(at).isFile() or fs.exists(_marker(spark, path))


def stored(spark: SparkSession, path: str, build, force: bool = False,
           partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Read the finished table at ``path``; build and write it first if there is none, or ``force``.

    It is written beside and then renamed, so a write that was killed leaves no table, or the old one;
    what an unfinished write left at ``path`` is replaced.
    """
    if force or not is_finished(spark, path):
        fs, at = _files(spark, path)
        beside = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
        build().write.option("compression", "zstd").partitionBy(*partition_by).parquet(beside)
        fs.delete(at, True)
        if not fs.rename(_files(spark, beside)[1], at):
            raise OSError(f"could not rename {beside} to {path}")
    return spark.read.parquet(path)


def refresh(spark: SparkSession, path: str, rows: DataFrame, key: str = "yyyymm") -> DataFrame:
    """Replace the partitions of ``key`` that ``rows`` has, and no others.

    The table counts as unfinished until this is committed: if it is killed, ``stored`` builds anew.
    """
    if not is_finished(spark, path):
        raise ValueError(f"no finished table at {path}")
    fs, _ = _files(spark, path)
    fs.delete(_marker(spark, path), False)
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy(key).parquet(path))
    if not fs.exists(_marker(spark, path)):      # whatever the writer's settings for its marker
        fs.create(_marker(spark, path)).close()
    return spark.read.parquet(path)


def with_history(rows: DataFrame, months, length: int, asset: str = "signalname",
                 key: str = "yyyymm") -> DataFrame:
    """The rows of ``months`` and all between, after each asset's last ``length`` rows before them."""
    first, last = min(months), max(months)
    before = rows.where(F.col(key) < first)
    place = F.row_number().over(Window.partitionBy(asset).orderBy(F.desc(key)))
    before = before.withColumn("_place", place).where(F.col("_place") <= length).drop("_place")
    return before.unionByName(rows.where(F.col(key).between(first, last)))


def refresh_months(spark: SparkSession, path: str, rows: DataFrame, months, build, history: int,
                   asset: str = "signalname", key: str = "yyyymm") -> DataFrame:
    """Bring the partitions of ``months`` up to date in a table of trailing features.

    ``build`` makes the table from source rows and looks back at most ``history`` rows of an asset,
    so it runs on these months and that much before them. Later months that look back at
    the changed ones are the caller's to name.
    """
    made = build(with_history(rows, months, history, asset, key))
    return refresh(spark, path, made.where(F.col(key).isin(sorted(months))), key)


def attach(df: DataFrame, table: DataFrame, keys, rows: int | None, how: str = "left") -> DataFrame:
    """Join a per-group ``table`` holding at most ``rows`` rows back onto ``df``."""
    keys = list(keys)
    if not keys:
        return df.crossJoin(F.broadcast(table))  # one row by construction
    if rows is not None and rows <= BROADCAST_ROWS:
        table = F.broadcast(table)
    return df.join(table, keys, how)
