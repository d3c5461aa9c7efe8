"""Byte-level BPE: encoding by rounds over padded matrices, and decoding.

Texts are cut where white space begins (no token crosses that), each distinct piece is
split by the vocabulary's pattern, and each distinct pre-token is merged once per worker
and remembered. Pre-tokens a worker has not met are bucketed by length into padded
matrices; in every round each row merges its leftmost pair of lowest rank, found in an
open-addressing table of pairs, finished rows leave, and the matrix shrinks with its longest row.
Pre-tokens over ``LONGEST`` bytes, where rounds would cost the square of the length,
are merged over a heap; results are the same.

Defined results: a null text is an empty one (no ids, no bytes); special strings in a
text are ordinary text; invalid UTF-8 is read with replacement characters; repeated
rows and empty tables are as one expects; null identifiers stay.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from panelyard.llm.shared import documents, out_schema, ship, texts_as_bytes

VOCABULARY = "byte_bpe_50k.tiktoken"
LONGEST = 256          # bytes of a pre-token that is merged in a matrix
REMEMBERED = 200_000   # pieces a worker keeps before it starts anew
AT_ONCE = 1 << 20      # bytes of text whose new pieces are merged together
NONE = np.int64(1) << 40
# The white space of the split pattern (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def _mix(keys: np.ndarray) -> np.ndarray:
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class PairTable:
    """(left id, right id) -> merged id, in an open-addressing numpy table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << int(np.ceil(np.log2(max(len(keys), 2) * 3)))
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.full(size, NONE, dtype=np.int64)
        slots = _mix(keys) & self.mask
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):
            free = self.keys[slots[todo]] == np.iinfo(np.uint64).max
            wanting = todo[free]
            _, first = np.unique(slots[wanting], return_index=True)
            put = wanting[first]
            self.keys[slots[put]] = keys[put]
            self.values[slots[put]] = values[put]
            left = np.ones(len(keys), dtype=bool)
            left[put] = False
            todo = todo[left[todo]]
            slots[todo] = (slots[todo] + np.uint64(1)) & self.mask
            self.probes += 1

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots = _mix(keys) & self.mask
        got = self.keys[slots]
        out = np.where(got == keys, self.values[slots], NONE)
        todo = np.flatnonzero((got != keys) & (got != np.iinfo(np.uint64).max))
        for _ in range(self.probes):
            if not len(todo):
                break
            slots[todo] = (slots[todo] + np.uint64(1)) & self.mask
            got = self.keys[slots[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (got != np.iinfo(np.uint64).max)]
        return out


class Vocabulary:
    """Ranks of byte strings, the pairs that make them, and a memory of pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int64))
        self.split = regex.compile(pattern.replace("[^\\s", f"[^{SPACE}")
                                   .replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))
        self.pieces: dict[str, bytes] = {}

    def merge_rounds(self, group: list[bytes]) -> list[np.ndarray]:
        """Ids of short pre-tokens of similar length."""
        width = max(map(len, group))
        ids = np.zeros((len(group), width), dtype=np.int64)
        size = np.array([len(g) for g in group])
        for i, g in enumerate(group):
            ids[i, :len(g)] = self.of_byte[np.frombuffer(g, dtype=np.uint8)]
        columns = np.arange(width)
        rank = np.full((len(group), width), NONE)
        inside = columns[None, :-1] < size[:, None] - 1
        rank[:, :-1][inside] = self.pairs.find(ids[:, :-1][inside], ids[:, 1:][inside])
        out: list[np.ndarray] = [np.empty(0)] * len(group)
        rows = np.arange(len(group))
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            done = best >= NONE
            for i in np.flatnonzero(done):
                out[rows[i]] = ids[i, :size[i]].astype("<u4")
            go = ~done
            rows, at, best, size = rows[go], at[go], best[go], size[go] - 1
            if not len(rows):
                break
            width = int(size.max())
            take = np.arange(width)[None, :]
            take = np.minimum(take + (take > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids[go], take, axis=1)
            rank = np.take_along_axis(rank[go], take, axis=1)
            here = np.arange(len(rows))
            ids[here, at] = best
            rank[here, np.minimum(size - 1, width - 1)] = NONE
            for shift in (-1, 0):
                left = at + shift
                ok = np.flatnonzero((left >= 0) & (left + 1 < size))
                rank[ok, left[ok]] = self.pairs.find(ids[ok, left[ok]], ids[ok, left[ok] + 1])
        return out

    def merge_heap(self, token: bytes) -> np.ndarray:
        """Ids of one long pre-token, O(n log n)."""
        n = len(token)
        size = [1] * n                       # bytes in the part that starts here, 0 if merged
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []

        def offer(i):
            j = after[i]
            if j < n:
                r = self.ranks.get(token[i:j + size[j]])
                if r is not None:
                    heapq.heappush(queue, (r, i, size[i], size[j]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i] if size[i] else n
            if size[i] != a or j >= n or size[j] != b:
                continue
            size[i], size[j], after[i] = a + b, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([self.ranks[token[i:i + size[i]]] for i in range(n) if size[i]], "<u4")

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not met so far."""
        split = {p: self.split.findall(p) for p in pieces}
        tokens = {t.encode() for ts in split.values() for t in ts}
        ids: dict[bytes, np.ndarray] = {}
        buckets: dict[int, list[bytes]] = {}
        for t in tokens:
            whole = self.ranks.get(t)
            if whole is not None:
                ids[t] = np.array([whole], "<u4")
            elif len(t) > LONGEST:
                ids[t] = self.merge_heap(t)
            else:
                buckets.setdefault((len(t) - 1).bit_length(), []).append(t)
        for group in buckets.values():
            for at in range(0, len(group), 8192):
                part = group[at:at + 8192]
                ids.update(zip(part, self.merge_rounds(part)))
        for p, ts in split.items():
            self.pieces[p] = b"".join([ids[t.encode()].tobytes() for t in ts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        cut = [PIECE.findall(t) for t in texts]
        new = set().union(*cut).difference(self.pieces)
        if new:
            self.learn(new)
        known = self.pieces.__getitem__
        return [b"".join(map(known, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def slices(batch, limit: int = AT_ONCE, at: int = 1):
    """Parts of an Arrow batch whose texts (column ``at``) are short together."""
    ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False),
                     dtype=np.int64)
    begin = 0
    while begin < len(batch):
        start = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, start + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


#: Column -> its type, in the order they are returned.
OUTPUTS = {"n_tokens": "long", "token_ids": "array<int>", "ids_sha256": "string",
           "decoded": "binary", "decoded_sha256": "string"}


def _encoder(path: str, pattern: str, outputs: tuple[str, ...], kept: int):
    def run(batches):
        v = vocabulary(path, pattern)
        for b in batches:
            for part in slices(b):
                ids = v.encode([t.decode("utf-8", "replace") for t in part.column(1).to_pylist()])
                made = {}
                if "n_tokens" in outputs:
                    made["n_tokens"] = pa.array([len(i) // 4 for i in ids], pa.int64())
                if "token_ids" in outputs:
                    ends = np.cumsum([0] + [len(i) // 4 for i in ids]).astype(np.int32)
                    flat = np.frombuffer(b"".join(ids), "<i4")
                    made["token_ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                if "ids_sha256" in outputs:
                    made["ids_sha256"] = pa.array([hashlib.sha256(i).hexdigest() for i in ids])
                if "decoded" in outputs or "decoded_sha256" in outputs:
                    texts = [v.decode(i) for i in ids]
                    if "decoded" in outputs:
                        made["decoded"] = pa.array(texts, pa.binary())
                    if "decoded_sha256" in outputs:
                        made["decoded_sha256"] = pa.array(
                            [hashlib.sha256(t).hexdigest() for t in texts])
                arrays = [part.column(0), *[part.column(2 + k) for k in range(kept)]]
                names = ["doc_id", *[f"k{k}" for k in range(kept)], *outputs]
                yield pa.RecordBatch.from_arrays([*arrays, *[made[c] for c in outputs]],
                                                 names=names)
    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
           outputs: tuple[str, ...] = ("n_tokens", "token_ids"), keep: tuple[str, ...] = (),
           path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, the ``keep`` columns and the chosen ``OUTPUTS``.

    ``path`` is the rank file, at the same place on every machine. ``decoded`` columns are made from the ids.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    outputs = tuple(c for c in OUTPUTS if c in outputs)
    docs = documents(df, id_col, text_col, **{f"k{k}": c for k, c in enumerate(keep)})
    names = [f"k{k}" for k in range(len(keep))]
    schema = out_schema(docs, ", ".join(f"{c} {OUTPUTS[c]}" for c in outputs), *names)
    ship(df.sparkSession)
    out = texts_as_bytes(docs, *names).mapInArrow(
        _encoder(path, pattern, outputs, len(keep)), schema)
    return out.withColumnsRenamed({f"k{k}": c for k, c in enumerate(keep)})
