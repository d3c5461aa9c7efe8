"""Cross-tokenizer alignment: where the tokens of two vocabularies end together.

Each text, after a leading space, is encoded by tokenizer A (``tokenizers`` JSON, byte level) and
B (``sentencepiece`` model). No token of either crosses the start of a white-space run that opens
with a space or a line end, so texts are cut there, and a worker encodes and aligns each distinct
piece once, many new ones as one text. Aligning is a galloping intersection of the two lists of token ends: the
shorter list drives; each of its ends is looked for from where the one before it was found, in
steps that double, then by halving. Common ends cut groups; the rank an end has in the longer list,
less the rank of the end before it, is the range of tokens it overlaps, and these ranges are the links.

How many texts hold a pair of ids linked is a count over all texts: each text's distinct pairs
are stored with their number, Spark sums them, and the counts come back to the texts: as sorted
arrays by broadcast while at most ``PAIRS`` distinct pairs exist, else by a join. Either way
whole; the stored pairs are read again, no text is encoded twice.

Defined results: a text that is null or empty, or that either tokenizer does not give back byte
for byte, has no tokens: zeros and an empty digest; the strings of special tokens are
ordinary text; repeated rows count as texts of their own and keep one row each; null identifiers
stay; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.bpe import SPACE, slices
from panelyard.llm.shared import documents, out_schema, ship, texts_as_bytes
from panelyard.sources.store import materialise

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
PAIRS = 4_000_000       # distinct linked pairs up to which their counts are broadcast, 16 bytes each
HELD = 96 << 20         # bytes of pieces and what is known of them that a worker keeps, before a batch
TOGETHER = 4_000        # new pieces that are encoded and aligned as one text
LANE = 32               # ends that one lane of the search takes in turn
CUT = re.compile(f"(?<=[^{SPACE}])(?=[ \\n])")
CUT_SPACE = re.compile(f"(?<=[^{SPACE}])(?= )")


# ------------------------------------------------------------------ alignment
def gallop(short: np.ndarray, long: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rank of each value of ``short`` (its first place not below) in its own part of ``long``.

    Value i is looked for in ``long[lo[i]:hi[i]]``; both lists rise within a part. Values are dealt to lanes
    of ``LANE`` neighbours: a lane starts at its part's start, then where its last search ended, and
    all lanes step together.
    """
    n = len(short)
    rank = np.empty(n, dtype=np.int64)
    if not n:
        return rank
    first = np.arange(0, n, LANE)
    at = np.zeros(len(first), dtype=np.int64)
    for turn in range(LANE):
        i = first + turn
        lane = np.flatnonzero(i < n)
        i = i[lane]
        want, end = short[i], hi[i]
        start = np.maximum(at[lane], lo[i])          # a new part starts at its own first place
        low, step = start.copy(), np.ones(len(i), dtype=np.int64)
        high = np.minimum(low, end)                   # long[low - 1] < want <= long[high], in the end
        todo = np.flatnonzero((high < end) & (long[np.minimum(high, len(long) - 1)] < want))
        while len(todo):                              # steps double
            low[todo] = high[todo] + 1
            high[todo] = np.minimum(high[todo] + step[todo], end[todo])
            step[todo] *= 2
            more = high[todo] < end[todo]
            todo = todo[more]
            todo = todo[long[high[todo]] < want[todo]]
        todo = np.flatnonzero(low < high)
        while len(todo):                              # halves
            mid = (low[todo] + high[todo]) >> 1
            below = long[mid] < want[todo]
            low[todo[below]] = mid[below] + 1
            high[todo[~below]] = mid[~below]
            todo = todo[low[todo] < high[todo]]
        rank[i] = at[lane] = high
    return rank


class Aligned:
    """Groups and links of many pairs of token lists, as flat arrays with row offsets."""

    def __init__(self, a_len: np.ndarray, a_off: np.ndarray, b_len: np.ndarray, b_off: np.ndarray):
        """Token byte lengths of all rows one after the other; ``*_off`` are rows + 1 offsets.

        Both lists of a row cover the same bytes.
        """
        rows = len(a_off) - 1
        a_n, b_n = np.diff(a_off), np.diff(b_off)
        self.a_row, self.b_row = np.repeat(np.arange(rows), a_n), np.repeat(np.arange(rows), b_n)
        a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)   # rows follow each other, so ends rise
        driver_is_a = a_n <= b_n
        self.a_cut = np.zeros(len(a_end), dtype=bool)       # the group ends with this token
        self.b_cut = np.zeros(len(b_end), dtype=bool)
        links = []
        for a_drives in (True, False):
            (s_end, s_row, s_off), (l_end, l_off) = (
                ((a_end, self.a_row, a_off), (b_end, b_off)) if a_drives
                else ((b_end, self.b_row, b_off), (a_end, a_off)))
            pick = np.flatnonzero(driver_is_a[s_row] == a_drives)
            if not len(pick):
                continue
            lo, hi = l_off[s_row[pick]], l_off[s_row[pick] + 1]
            rank = gallop(s_end[pick], l_end, lo, hi)
            met = l_end[np.minimum(rank, len(l_end) - 1)] == s_end[pick]
            (self.a_cut if a_drives else self.b_cut)[pick[met]] = True
            (self.b_cut if a_drives else self.a_cut)[rank[met]] = True
            # Tokens of the longer list that a token overlaps: after the last one that ends
            # at or before its start, up to the first that ends at or after its end.
            before = np.where(met, rank + 1, rank)[:-1]
            begin = np.concatenate([lo[:1], before])
            opens = pick == s_off[s_row[pick]]
            begin[opens] = lo[opens]
            count = rank + 1 - begin
            s = np.repeat(pick, count)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            other = np.repeat(begin, count) + step
            links.append((s, other) if a_drives else (other, s))
        none = np.zeros(0, dtype=np.int64)
        self.link_a = np.concatenate([none, *[a for a, _ in links]])
        self.link_b = np.concatenate([none, *[b for _, b in links]])


# ----------------------------------------------------------------- tokenizers
def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Flat:
    """Rows of varying length in one growing array."""

    def __init__(self, dtype):
        self.values, self.ends = np.zeros(1024, dtype=dtype), np.zeros(1, dtype=np.int64)

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        used = self.ends[-1]
        if used + len(values) > len(self.values):
            room = np.zeros(2 * (used + len(values)), dtype=self.values.dtype)
            room[:used] = self.values[:used]
            self.values = room
        self.values[used:used + len(values)] = values
        self.ends = np.concatenate([self.ends, used + np.cumsum(sizes)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the given rows one after the other, and each row's size."""
        begin = self.ends[rows]
        size = self.ends[rows + 1] - begin
        return self.values[_spread(begin, size)], size

    @property
    def nbytes(self) -> int:
        return self.values.nbytes + self.ends.nbytes


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of ``size`` places."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(begin - (np.cumsum(size) - size), size)


class Tokenizers:
    """Both tokenizers, the bytes of their ids, and a memory of pieces bounded in bytes."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = _byte_characters()
        vocabulary = self.a.get_vocab()
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a_bytes[i] = (bytes(of[c] for c in token) if all(c in of for c in token)
                          else token.encode())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i)
                   else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes, self.b_bytes, self.digits = Flat(np.uint8), Flat(np.uint8), Flat(np.uint8)
        decimals = [b"%d " % i for i in range(max(len(a_bytes), len(b_bytes)))]
        for flat, rows in ((self.a_bytes, a_bytes), (self.b_bytes, b_bytes), (self.digits, decimals)):
            flat.append(np.frombuffer(b"".join(rows), np.uint8), np.array(list(map(len, rows))))
        self.b_size = len(b_bytes)
        self.cells = len(a_bytes) * self.b_size            # pair = A id * b_size + B id
        self.mark = self.b.piece_to_id("\u2581")
        whole = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        crosses = any("\u2581" in p.lstrip("\u2581") for p in whole) or self.mark == self.b.unk_id()
        self.cut = None if crosses else CUT_SPACE if any("\n" in p for p in whole) else CUT
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.counts = Flat(np.int64)     # n_a, n_b, n_groups, and 1 if the bytes are the piece's
        self.pairs, self.groups = Flat(np.int64), Flat(np.uint8)
        self.names = 0

    @property
    def held(self) -> int:
        return self.names + self.counts.nbytes + self.pairs.nbytes + self.groups.nbytes

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces written one after the other; None where bytes do not come back."""
        text = "".join(pieces)
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)
        # The library puts a space before what it is given.
        b = ([self.mark] if text == " " else self.b.encode(text[1:]) if text.startswith(" ")
             else self.b.encode(text)[1:])
        b, raw = np.array(b, dtype=np.int64), np.frombuffer(text.encode(), np.uint8)
        back = self.a_bytes.take(a)[0], self.b_bytes.take(b)[0]
        return (a, b) if all(np.array_equal(x, raw) for x in back) else None

    def learn(self, pieces: list[str]) -> None:
        """Encode and align new pieces; those that end in a blank, or hold B's mark, one by one."""
        alone = [p for p in pieces if "\u2581" in p or p[-1:].isspace() or self.cut is None]
        apart = set(alone)
        rest = [p for p in pieces if p not in apart]
        for at in range(0, len(rest), TOGETHER):
            self._learn(rest[at:at + TOGETHER])
        for p in alone:
            self._learn([p])

    def _learn(self, pieces: list[str]) -> None:
        got = self._encoded(pieces)
        if got is None and len(pieces) > 1:                 # find out which
            for p in pieces:
                self._learn([p])
            return
        same = got is not None
        a, b = got if same else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        a_size, b_size = self.a_bytes.ends[a + 1] - self.a_bytes.ends[a], self.b_bytes.ends[b + 1] - self.b_bytes.ends[b]
        ends = np.cumsum([len(p.encode()) for p in pieces]) if same else np.zeros(1)
        a_off = np.concatenate([[0], np.searchsorted(np.cumsum(a_size), ends, "right")])
        b_off = np.concatenate([[0], np.searchsorted(np.cumsum(b_size), ends, "right")])
        al = Aligned(a_size, a_off, b_size, b_off)
        row = al.a_row[al.link_a]
        order = np.argsort(row, kind="stable")
        pairs = (a[al.link_a] * self.b_size + b[al.link_b])[order]
        n = len(pieces)
        counts = np.stack([np.diff(a_off), np.diff(b_off), np.bincount(al.a_row[al.a_cut], minlength=n),
                           np.full(n, int(same))], axis=1)
        text, sizes = self._written(a, b, al)
        self.counts.append(counts.ravel(), np.full(n, 4))
        self.pairs.append(pairs, np.bincount(row, minlength=n))
        self.groups.append(text, np.bincount(np.concatenate([al.a_row, al.b_row]),
                                             np.concatenate(sizes), minlength=n).astype(np.int64))
        self.index.update(zip(pieces, range(len(self.index), len(self.index) + n)))
        self.names += sum(map(len, pieces)) * 2 + 150 * n

    def _written(self, a, b, al: Aligned) -> tuple[np.ndarray, list[np.ndarray]]:
        """The groups in figures, ``a1,a2|b1;``, and the bytes each token of A and B takes."""
        group = [np.cumsum(c) - c for c in (al.a_cut, al.b_cut)]
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(np.concatenate(group) * 2 + side, kind="stable")
        ids, cut = np.concatenate([a, b]), np.concatenate([al.a_cut, al.b_cut])
        mark = np.where(cut, np.where(side == 0, ord("|"), ord(";")), ord(","))
        text, size = self.digits.take(ids[order])
        text[np.cumsum(size) - 1] = mark[order]
        sizes = np.empty(len(ids), dtype=np.int64)
        sizes[order] = size
        return text, [sizes[:len(a)], sizes[len(a):]]

    def align(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Per text counts and digest; distinct linked pairs and their numbers with row offsets."""
        if self.held > HELD:
            self.forget()
        cut = [(self.cut.split(" " + t) if self.cut else [" " + t]) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.index))
        if new:
            self.learn(new)
        size = np.array(list(map(len, cut)), dtype=np.int64)
        rows = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, size.sum())
        of = np.repeat(np.arange(len(texts)), size)
        counts = self.counts.values.reshape(-1, 4)[rows] if len(rows) else np.zeros((0, 4), np.int64)
        lost = np.bincount(of, counts[:, 3] == 0, minlength=len(texts)) > 0
        rows, of, counts = rows[~lost[of]], of[~lost[of]], counts[~lost[of]]
        n = np.stack([np.bincount(of, counts[:, k], minlength=len(texts)).astype(np.int64)
                      for k in range(3)], axis=1)
        pairs, size = self.pairs.take(rows)
        keys = np.sort(np.repeat(of, size) * self.cells + pairs)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([first, [len(keys)]]))
        keys = keys[first]
        text, size = self.groups.take(rows)
        ends = np.cumsum(np.bincount(of, size, minlength=len(texts)).astype(np.int64))
        view = memoryview(text.tobytes())
        digest = [hashlib.sha256(view[s:e - 1]).hexdigest() if e > s else ""
                  for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
        row = keys // self.cells
        return {"n": n, "n_links": np.bincount(row, times, minlength=len(texts)).astype(np.int64),
                "digest": digest, "pairs": keys - row * self.cells, "times": times,
                "off": np.searchsorted(row, np.arange(len(texts) + 1))}


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


# ---------------------------------------------------------------------- Spark
def _aligner(a_path: str, b_path: str):
    def run(batches):
        t = tokenizers(a_path, b_path)
        for b in batches:
            for part in slices(b):
                got = t.align([r.decode("utf-8", "replace") for r in part.column(1).to_pylist()])
                off = pa.array(got["off"].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(got["n"][:, k]) for k in range(3)],
                     pa.array(got["n_links"]), pa.array(got["digest"], pa.string()),
                     pa.ListArray.from_arrays(off, pa.array(got["pairs"])),
                     pa.ListArray.from_arrays(off, pa.array(got["times"].astype(np.int32)))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs",
                           "times"])
    return run


def _flat(column, dtype):
    """Values and offsets of a list column without nulls."""
    off = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]].astype(dtype), off - off[0]


def _adder(shared):
    def run(batches):
        keys, count, best = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                pairs, off = _flat(part.column(6), np.int64)
                times, _ = _flat(part.column(7), np.int64)
                place = np.searchsorted(keys, pairs)
                total = np.concatenate([[0], np.cumsum(times * count[place])])
                top = np.concatenate([[0], np.cumsum(times * best[place])])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in range(6)], pa.array(top[off[1:]] - top[off[:-1]]),
                     pa.array(total[off[1:]] - total[off[:-1]])],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best",
                           "count_sum"])
    return run


def vocabulary_size(path: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): texts that hold each linked pair, and whether its A id has no better one."""
    n = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"))
    n = materialise(n, "pair-counts")
    a = F.expr(f"pair div {b_size}").alias("a")
    most = n.groupBy(a).agg(F.max("n").alias("most"))
    return n.withColumn("a", a).join(most, "a").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                  a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, counts, the groups' digest, and ``pairs`` (A id times B's size, plus B id) with ``times``."""
    docs = documents(df, id_col, text_col)
    ship(df.sparkSession)
    fields = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "pairs array<long>, times array<int>")
    return texts_as_bytes(docs).mapInArrow(
        _aligner(a_path or public_tokenizers.path(BYTE_LEVEL),
                 b_path or public_tokenizers.path(PIECES)), out_schema(docs, fields))


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
          a_path: str | None = None, b_path: str | None = None, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row per text.

    ``pairs`` bounds the counts that are broadcast and changes no result.
    """
    spark = df.sparkSession
    b_path = b_path or public_tokenizers.path(PIECES)
    aligned = materialise(aligned_texts(df, id_col, text_col, a_path=a_path, b_path=b_path), "aligned")
    counts = materialise(pair_counts(aligned, vocabulary_size(b_path)), "pair-counts")
    if counts.count() <= pairs:
        table = counts.orderBy("pair").toArrow()          # at most ``pairs`` rows of three numbers
        arrays = (table["pair"].to_numpy(), table["n"].to_numpy(),
                  table["best"].to_numpy().astype(np.int64))
        schema = out_schema(aligned, "n_a long, n_b long, n_groups long, n_links long, "
                                     "groups_sha256 string, n_best long, count_sum long")
        out = aligned.mapInArrow(_adder(spark.sparkContext.broadcast(arrays)), schema)
    else:
        rows = materialise(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
        each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(
            "row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
        sums = each.join(counts, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        zero = F.lit(0).cast("long")
        out = rows.join(sums, "row", "left").withColumns(
            {c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      "groups_sha256")
