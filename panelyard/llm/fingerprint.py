"""Document fingerprints from prefix polynomial hashes.

A text's code points c_0, c_1, ... give prefix sums S_i = sum of c_j B^j modulo a prime, twice. Any
span's hash is a difference of two of them, brought to power 0 by an inverse power, so
equality of any two spans costs a few operations and the longest common extension of two
positions is a binary search. All of a text's spans of ``WIDTH`` code points come from one
vector operation; the ``KEPT`` smallest of their mixed hashes, with length and whole hash,
are the fingerprint. Likeness estimates the overlap of two span sets from two fingerprints.

Next documents are found without one global sort: identifiers are cut into ranges at approximate
quantiles, each range also gets the first document of the range after it, and a task
walks its sorted ranges holding two texts.

Defined results: a null text is empty; two empty texts are alike (1), an empty and another one
are not (0); equal identifiers go by a digest of the text; null identifiers come last; in
a table of one document it is its own next; identifiers must be integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import documents, out_schema, ship
from panelyard.sources.store import materialise

PRIME = (1 << 31) - 1
BASES = (1_000_003, 754_974_721)
WIDTH = 12      # code points in a span
KEPT = 32       # smallest mixed hashes in a fingerprint
P = np.uint64(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1 for x below 2^62."""
    x = (x & P) + (x >> np.uint64(31))
    x = (x & P) + (x >> np.uint64(31))
    return np.where(x >= P, x - P, x)


class Powers:
    """B^0, B^1, ... and their inverses, grown as longer texts come."""

    def __init__(self, base: int):
        self.base = (base, pow(base, -1, PRIME))
        self.up = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up[0]) < n + 1:
            size = len(self.up[0])
            for i in (0, 1):
                step = np.uint64(pow(self.base[i], size, PRIME))
                self.up[i] = np.concatenate([self.up[i], _mod(self.up[i] * step)])
        return self.up[0], self.up[1]


_powers = [Powers(b) for b in BASES]


class PrefixHash:
    """Prefix hashes of one text."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.n = len(codes)
        self.sums = []
        for powers in _powers:
            up, _ = powers.upto(self.n)
            s = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(_mod((codes + np.uint64(1)) * up[:self.n]), out=s[1:])
            self.sums.append(_mod(s))

    def span(self, start: int, size: int) -> tuple[int, int]:
        """Hashes of a span, whatever its place."""
        out = []
        for s, powers in zip(self.sums, _powers):
            inverse = int(powers.upto(self.n)[1][start])
            out.append((int(s[start + size]) - int(s[start])) % PRIME * inverse % PRIME)
        return tuple(out)

    def spans(self, width: int = WIDTH) -> np.ndarray:
        """Mixed 32-bit hashes of all spans of one width; of the whole text if it is shorter."""
        width = min(width, self.n)
        if not width:
            return np.zeros(0, dtype=np.uint32)
        s, count = self.sums[0], self.n - width + 1
        inverse = _powers[0].upto(self.n)[1][:count]
        return mixed(_mod(_mod(s[width:] + P - s[:count]) * inverse))


def mixed(h: np.ndarray) -> np.ndarray:
    x = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(32)).astype(np.uint32)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest equal spans that start at a[i] and b[j]."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, mid) == b.span(j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def smallest(parts: list[np.ndarray], kept: int = KEPT) -> np.ndarray:
    """The ``kept`` smallest distinct hashes, sorted."""
    n = sum(map(len, parts))
    if n > 8 * kept:  # most cannot be among them; look at all if too few are left
        bound = np.uint32(min(4 * kept * (1 << 32) // n, (1 << 32) - 1))
        few = np.unique(np.concatenate([p[p < bound] for p in parts]))
        if len(few) >= kept:
            return few[:kept]
    return np.unique(np.concatenate(parts))[:kept] if n else np.zeros(0, dtype=np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Share of the smallest hashes of both that both have."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:kept]
    return float(np.isin(both, a).__and__(np.isin(both, b)).mean())


def _string(n: int, whole: tuple[int, int], few: np.ndarray) -> str:
    return f"{n:x}-{whole[0]:08x}{whole[1]:08x}-{few.astype('>u4').tobytes().hex()}"


def sketch_of(fingerprint: str) -> np.ndarray:
    """The hashes in a fingerprint."""
    return np.frombuffer(bytes.fromhex(fingerprint.rpartition("-")[2]), ">u4").astype(np.uint32)


class Document:
    """A text with what its own and its edited fingerprint need."""

    def __init__(self, raw: bytes):
        self.hash = PrefixHash(raw.decode("utf-8", "replace"))
        self.n = self.hash.n
        self.windows = self.hash.spans()
        self.few = smallest([self.windows])

    def fingerprint(self) -> str:
        return _string(self.n, self.hash.span(0, self.n), self.few)

    def edited(self, other: Document) -> tuple[str, str, np.ndarray, int]:
        """Text whose second half is the start of ``other``; spans of both are reused."""
        half = self.n // 2
        head, tail = self.n - half, min(half, other.n)
        text = self.hash.text[:head] + other.hash.text[:tail]
        if self.n >= WIDTH and other.n >= WIDTH and head + tail >= WIDTH:
            low = max(head - WIDTH + 1, 0)
            middle = PrefixHash(text[low:head + WIDTH - 1]).spans()
            parts = [self.windows[:max(head - WIDTH + 1, 0)], middle,
                     other.windows[:max(tail - WIDTH + 1, 0)]]
        else:
            parts = [PrefixHash(text).spans()]
        few = smallest(parts)
        a, b = self.hash.span(0, head), other.hash.span(0, tail)
        whole = tuple((x + y * pow(base, head, PRIME)) % PRIME
                      for x, y, base in zip(a, b, BASES))
        same = head
        if half:
            same += min(common_extension(self.hash, head, other.hash, 0), tail)
        return text, _string(head + tail, whole, few), few, same


def _walk(batches):
    """Rows sorted by range and place; the last of a range is the first of the next."""
    cell, last, last_id = None, None, None
    for b in batches:
        rows = []
        for c, doc_id, raw, head in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                        b.column(2).to_pylist(), b.column(3).to_pylist()):
            doc = Document(raw)
            if c == cell and last is not None:
                text, mark, few, same = last.edited(doc)
                rows.append((last_id, last.n, hashlib.sha256(
                    text.encode("utf-8", "surrogatepass")).hexdigest(), last.fingerprint(), mark,
                    likeness(last.few, few), likeness(last.few, doc.few), same))
            cell, last, last_id = c, None if head else doc, doc_id
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], b.schema.field(1).type), pa.array(cols[1], pa.int64()),
                 *[pa.array(c, pa.string()) for c in cols[2:5]],
                 *[pa.array(c, pa.float64()) for c in cols[5:7]], pa.array(cols[7], pa.int64())],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       "near_edited", "near_next", "same_start"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Own, edited and next document's fingerprints compared, one row per input row.

    Also ``same_start``: code points that the text and its edited form share at the start.
    """
    spark = df.sparkSession
    ship(spark)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    docs = documents(df, id_col, text_col)
    kinds = out_schema(docs, "n_chars long, edited_sha256 string, fingerprint string, "
                             "edited_fingerprint string, near_edited double, near_next double, "
                             "same_start long")
    docs = docs.select("doc_id", raw.alias("raw"), F.bitwise_not(F.col("doc_id").cast("long"))
                       .alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 10_000)
    cuts = docs.agg(near.alias("cuts")).first()["cuts"] or []
    cuts = sorted({float(c) for c in cuts})
    splits = [-float("inf"), *cuts, float("inf")]
    ranged = Bucketizer(splits=splits if len(splits) > 2 else [-float("inf"), 0.0, float("inf")],
                        inputCol="_x", outputCol="cell").transform(
        docs.withColumn("_x", F.coalesce(F.col("key").cast("double"), F.lit(0.0)))).drop("_x")
    last = F.lit(len(splits))
    ranged = ranged.withColumn("cell", F.when(F.col("key").isNull(), last).otherwise(
        F.col("cell").cast("int"))).withColumn("tie", F.xxhash64("raw"))
    heads = materialise(ranged.groupBy("cell").agg(F.min(F.struct(
        F.col("key").isNull().alias("no"), "key", "tie", "doc_id", "raw")).alias("h")), "heads")
    order = [r["cell"] for r in heads.select("cell").orderBy("cell").collect()]  # one per range
    if not order:
        return spark.createDataFrame([], kinds)
    before = {c: order[i - 1] for i, c in enumerate(order)}
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    more = heads.select(to[F.col("cell")].alias("cell"), "h.doc_id", "h.raw", "h.key", "h.tie",
                        F.lit(True).alias("head"))
    rows = ranged.select("cell", "doc_id", "raw", "key", "tie", F.lit(False).alias("head"))
    dealt = rows.unionByName(more).repartition(parts, "cell").sortWithinPartitions(
        "cell", "head", F.col("key").asc_nulls_last(), "tie")
    return dealt.select("cell", "doc_id", "raw", "head").mapInArrow(_walk, kinds)
