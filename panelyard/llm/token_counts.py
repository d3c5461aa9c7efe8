"""Token counts by a two-tier lookup in the map, without shuffling pre-tokens.

A text's count is the sum over its space-separated chunks, since this tokenizer's
splits never cross a space. Tier one is a compact table of frequent chunks, made from a
bounded sample (``SAMPLE`` rows, ``TABLE`` chunks; it changes the speed, never a count) and broadcast as hashes and
lengths. Tier two encodes what is missing in batches and remembers it in the worker.

Defined results: a null text is empty (no bytes, no tokens, not over the limit);
special strings in a text count as the library's default has it; one row per input row;
an empty table gives none.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.bpe import slices
from panelyard.llm.shared import documents, out_schema, ship, texts_as_bytes

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
SAMPLE = 4_000         # rows the frequent chunks are taken from, about
TABLE = 50_000         # frequent chunks that are broadcast
REMEMBERED = 400_000   # further chunks a worker keeps before it starts anew


class Counts(dict):
    """chunk -> tokens; the frequent ones stay."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.frequent: dict[str, int] = {}

    def lengths(self, chunks: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(chunks, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if len(self) > len(self.frequent) + REMEMBERED:
            self.clear()
            self.update(self.frequent)
        cut = [t.split(" ") for t in texts]
        new = list(set().union(*cut).difference(self))
        if new:
            self.update(zip(new, self.lengths(new)))
        known = self.__getitem__
        return [sum(map(known, c)) for c in cut]


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(path)


def _frequent_batches(batches):
    seen: Counter = Counter()
    for b in batches:
        for t in b.column(1).to_pylist():
            seen.update(t.decode("utf-8", "replace").split(" "))
    top = seen.most_common(TABLE)
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.string()),
                                      pa.array([n for _, n in top], pa.int64())],
                                     names=["chunk", "n"])


def frequent_chunks(docs: DataFrame, path: str, table: int = TABLE) -> dict:
    """The table to broadcast: chunks joined by spaces, a byte or two for each count."""
    rows = docs.count()
    sample = docs if rows <= SAMPLE else docs.sample(SAMPLE / rows, seed=7)
    top = (texts_as_bytes(sample).mapInArrow(_frequent_batches, "chunk string, n long")
           .groupBy("chunk").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "chunk").limit(table).collect())  # TABLE rows at most
    chunks = [r["chunk"] for r in top]
    return {"chunks": " ".join(chunks), "n": len(chunks),
            "lengths": np.array(Counts(path).lengths(chunks), dtype=np.uint32)}


def _counter(path: str, table):
    def run(batches):
        c = counts(path)
        got = table.value
        if not c.frequent and got["n"]:
            c.frequent = dict(zip(got["chunks"].split(" "), got["lengths"].tolist()))
            c.update(c.frequent)
        for b in batches:
            for part in slices(b):
                raw = part.column(1).to_pylist()
                n = c.count([t.decode("utf-8", "replace") for t in raw])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in raw], pa.int64()),
                     pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row."""
    path = path or public_tokenizers.path(VOCABULARY)
    docs = documents(df, id_col, text_col)
    spark = df.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(frequent_chunks(docs, path))
    out = texts_as_bytes(docs).mapInArrow(_counter(path, table),
                                          out_schema(docs, "n_bytes long, n_tokens long"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
