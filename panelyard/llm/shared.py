"""What several operators share: columns in, worker code shipped, linked groups.

Every operator reads only the columns it is told to read and gives its own names to
them first, so further columns of the caller, whatever they are called, cannot clash.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from panelyard.sources.store import materialise

# Fixed value: what separates words (space, tab to carriage return).
GAPS = "[\\x20\\x09-\\x0D]+"

# Bytes of texts that go to a Python worker together, unless the session says otherwise.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", f"{4 << 20}b"
DEFAULT_BYTES = f"{64 << 20}b"         # Spark's own

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where they do not share its folder.

    A batch of texts is held by the executor and, twice, by its worker: it is kept small.
    """
    if spark.conf.get(BATCH) == DEFAULT_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    app = spark.sparkContext.applicationId
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if app in _shipped or root in map(os.path.abspath, filter(None, known)):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-code-")), "panelyard.zip")
    with zipfile.ZipFile(path, "w") as z:
        top = os.path.join(root, "panelyard")
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              **more: str) -> DataFrame:
    """(doc_id, text, ...) under fixed names, nothing else."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                     *[F.col(c).alias(name) for name, c in more.items()])


def texts_as_bytes(docs: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, raw UTF-8) for Python workers; a null text becomes empty."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    return docs.select("doc_id", raw, *columns)


def out_schema(docs: DataFrame, fields: str, *kept: str) -> StructType:
    """The identifier with the caller's type, kept columns, then ``fields``."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    named = [StructField(c, kinds[c]) for c in ("doc_id", *kept)]
    return StructType(named + StructType.fromDDL(fields).fields)


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node met in ``edges`` with the smallest node it can reach.

    Labels fall to the smallest label next door and then to their label's own label, so
    the number of rounds follows the logarithm of the longest path. Each round is
    one written table; a hub's rows are joined (and can be split) and summed map-side.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = materialise(both.unionByName(both.select(F.col("other").alias("node"),
                                                    F.col("node").alias("other")))
                       .where("node <> other").distinct(), "edges")
    labels = materialise(both.groupBy("node").agg(
        F.least(F.first("node"), F.min("other")).alias("root")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "other"), "other")
                .groupBy("node").agg(F.min("root").alias("near")))
        low = labels.join(near, "node").select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("next"))
        new = materialise(low.join(jump, "mid").select(
            "node", "was", F.least("mid", "next").alias("root")), "labels")
        if new.where("root <> was").limit(1).count() == 0:
            return new.select("node", "root")
        labels = new.select("node", "root")


def with_starts(df: DataFrame, sizes: str, starts: str) -> DataFrame:
    """Add the running sums before each element of an array column.

    Two levels, so that a long array is not copied once for each of its elements.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def running(xs, base):
        state = F.struct(base.alias("p"), none.alias("out"))
        return F.aggregate(xs, state, lambda a, x: F.struct(
            (a["p"] + x).alias("p"), F.concat(a["out"], F.array(a["p"])).alias("out")))["out"]

    n = F.size(sizes)
    cut = F.transform(F.sequence(F.lit(0), F.ceil(n / 256).cast("int") - 1),
                      lambda c: F.transform(F.slice(F.col(sizes), c * 256 + 1, 256),
                                            lambda x: x.cast("long")))
    chunks = F.when(n > 0, cut).otherwise(F.array().cast("array<array<bigint>>"))
    out = df.withColumn("_chunks", chunks)
    out = out.withColumn("_sums", F.transform("_chunks", lambda c: F.aggregate(
        c, zero, lambda s, x: s + x)))
    out = out.withColumn("_bases", running(F.col("_sums"), zero))
    return out.withColumn(starts, F.flatten(F.zip_with("_chunks", "_bases", running))).drop(
        "_chunks", "_sums", "_bases")
