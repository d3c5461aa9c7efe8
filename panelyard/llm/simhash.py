"""SimHash near-duplicates: pigeonhole blocks, then exact Hamming distances.

Two 64-bit fingerprints that differ in at most three bits agree on at least three of six
blocks, whichever those are. Every fingerprint is filed under each choice of three
blocks (20 keys of 31 to 33 bits), pairs that share a key meet, and the distance
decides. Equal fingerprints are one node, so exact copies never form pairs.

A key's fingerprints are dealt into chunks of about ``CHUNK``; every two chunks meet in
a group of their own, so no task holds a whole hot key. A group emits only links that
join its members together, never all its pairs; reachability stays the same.

Defined results: a null or wordless text has fingerprint zero and links like any other;
repeated rows keep one row each; an empty table gives no rows; a null identifier is kept
and never becomes a component's name unless the component has no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import connected, documents, out_schema, ship, texts_as_bytes
from panelyard.sources.store import materialise

WORDS = 3          # words in a shingle
DISTANCE = 3       # bits that linked fingerprints may differ in
SEED = 42
EDGES = (0, 11, 22, 33, 44, 54, 64)   # of the six blocks
CHUNK = 1024       # fingerprints of a key that meet at once
STEP = 1 << 16     # shingles whose bits are counted at once


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    found = raw.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    n = len(shingles)
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        h = np.fromiter((digest(s, SEED) for s in shingles[at:at + STEP]), dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    for b in batches:
        prints = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))],
                                         names=["doc_id", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit integers."""
    docs = documents(df, id_col, text_col)
    ship(df.sparkSession)
    return texts_as_bytes(docs).mapInArrow(_fingerprint_batches, out_schema(docs, "fp long"))


def _masks() -> list[int]:
    """Bit masks of every choice of blocks that a close pair may agree on."""
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(EDGES, EDGES[1:])]
    masks = [sum(c) for c in combinations(blocks, len(blocks) - DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def group_links(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect what lies within ``distance`` bits, fewer than the members."""
    if len(values) == 2:
        near = np.bitwise_count(values[0] ^ values[1]) <= distance
        return [(int(values[0]), int(values[1]))] if near else []
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    left = np.ones(len(values), dtype=bool)
    out = []
    for start in range(len(values)):
        if not left[start]:
            continue
        left[start] = False
        front = np.array([start])
        while len(front):
            reached = near[front].any(axis=0) & left
            front = np.flatnonzero(reached)
            left[front] = False
            out += [(int(values[start]), int(values[i])) for i in front]
    return out


def _link_batches(batches):
    for b in batches:
        links = []
        for group in b.column(0):
            values = np.unique(np.array(group.values, dtype=np.int64).view(np.uint64))
            if len(values) > 1:
                links += group_links(values)
        if links:
            pairs = np.array(links, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                                             names=["a", "b"])


def links(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: verified links that keep reachability."""
    key = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m)))
                              for i, m in enumerate(_masks())]))
    filed = nodes.select("fp", key.alias("key"))
    shared = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    met = (filed.join(shared, "key").withColumn("parts", parts)
           .withColumn("own", F.pmod(F.hash("fp"), F.col("parts"))))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = met.withColumn("other", other).select(
        "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    groups = met.groupBy("key", "lo", "hi").agg(F.collect_list("fp").alias("fps"))
    ship(nodes.sparkSession)
    return groups.where(F.size("fps") > 1).select("fps").mapInArrow(_link_batches, "a long, b long")


def _components(df: DataFrame, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """(doc_id, fp, root, component_id), one row per input row; ``root`` tells components apart."""
    prints = materialise(fingerprints(df, id_col, text_col), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first"),
                                                 F.count("*").alias("copies")), "simhash-nodes")
    labels = connected(links(nodes, chunk)).withColumnRenamed("node", "fp")
    named = nodes.join(labels, "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(names, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id), one row per input row."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _components(df, id_col, text_col, chunk).select(
        "doc_id", "fp", hexed.alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns as they are.

    It has the component's smallest identifier, then its smallest fingerprint, text, and other
    columns. Texts under one identifier are told apart: each component keeps one. A
    component without any identifier keeps one row as well.
    """
    found = materialise(_components(df, id_col, text_col, CHUNK), "simhash-found")
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    at, text = f"c{df.columns.index(id_col)}", F.col(f"c{df.columns.index(text_col)}")
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.first("component_id").alias("id"), F.min("fp").alias("fp"))
    # Fingerprints are made again only where an identifier does not tell which text is meant.
    torn = found.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("id"))
    torn = materialise(torn, "simhash-torn")
    plain = materialise(keep.where("id is not null").join(torn, "id", "left_anti"), "simhash-keep")
    other = materialise(keep.join(plain.select("root"), "root", "left_anti"), "simhash-keep")
    whole = F.struct(*names)

    def smallest(groups):
        return groups.agg(F.min_by(whole, F.struct(text.alias("t"), F.to_json(whole).alias("j"))).alias("w")).select("w.*")

    out = smallest(rows.join(plain.select(F.col("id").alias(at)), at, "left_semi").groupBy(at))
    if other.limit(1).count():
        torn_rows = rows.join(torn.select(F.col("id").alias(at)), at, "left_semi").unionByName(
            rows.where(F.col(at).isNull()))
        raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
        given = torn_rows.select(whole.alias("doc_id"), raw.alias("raw"))
        prints = given.mapInArrow(_fingerprint_batches, out_schema(given, "fp long")).select("doc_id.*", "fp")
        meant = F.col(at).eqNullSafe(F.col("_id")) & (F.col("fp") == F.col("_fp"))
        wanted = other.select(F.col("id").alias("_id"), F.col("fp").alias("_fp"))
        out = out.unionByName(smallest(prints.join(wanted, meant, "left_semi").groupBy(at, "fp")))
    return out.toDF(*df.columns)
