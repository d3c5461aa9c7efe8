"""Quality of documents by attention over their passages (multiple-instance learning).

A document is a bag of passages of ``WORDS`` words, and only the bag has a label. Each passage is
encoded (what its characters are, which kinds of characters follow one another, how words repeat), a learned layer
makes a hidden vector of it, gated attention (a tanh and a sigmoid branch, softmax over the document's
passages) weighs the passages, and the weighted mean of the hidden vectors is scored. All
layers are learned together from the documents' labels by gradient descent, on a sample of
about ``DOCUMENTS`` labelled documents of each label and at most ``PASSAGES`` passages; every document is scored
whole, its passages in one numpy pass per batch.

Defined results: a text that is null, empty or blank has one empty passage and is scored like
any other; words longer than ``WIDE`` characters count as several; with labels of one
kind or none, the score is that kind's share of the labels (0.5 without any); several labels of a
document count as the lowest, null ones and null identifiers as none; repeated rows keep one row each;
an empty table gives none.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.bpe import slices
from panelyard.llm.shared import documents, out_schema, ship, texts_as_bytes
from panelyard.sources.store import materialise

WORDS = 48             # words of a passage
WIDE = 400             # characters of a word, beyond which it is cut
DOCUMENTS = 2_000      # sampled documents of each label, about
PASSAGES = 40_000      # sampled passages in all
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 20, 128, 0.01, 1e-4
THRESHOLD = 0.3
FOLDS = 5              # documents whose crc32 has remainder 0 are never learned from

# Kinds of characters; marks that tables and spam are made of have kinds of their own.
KINDS = ("space", "line", "lower", "upper", "letter", "digit", "stop", "comma", "bang", "bar",
         "sign", "quote", "other", "rare")
_MARKS = {**dict.fromkeys(" \t\x0b\x0c\xa0", "space"), **dict.fromkeys("\n\r", "line"),
          **dict.fromkeys(".;:?", "stop"), ",": "comma", "!": "bang", "|": "bar",
          **dict.fromkeys("#$%&*@^~=+<>\\/_{}[]", "sign"), **dict.fromkeys("'\"()-", "quote")}
PAIRED = len(KINDS) * len(KINDS)
WIDTH = len(KINDS) + PAIRED + 8


@lru_cache(maxsize=1)
def _kind_table() -> np.ndarray:
    """Kind of each character of the first plane; all further ones are rare."""
    names = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Nd": "digit", "Zs": "space", "Zl": "line", "Zp": "line"}
    table = np.full(1 << 16, KINDS.index("rare"), dtype=np.int64)
    for c in range(1 << 16):
        category = unicodedata.category(chr(c))
        kind = _MARKS.get(chr(c)) or names.get(category) or (
            "letter" if category[0] in "LM" else "other" if category[0] in "PS" else "rare")
        table[c] = KINDS.index(kind)
    return table


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and offsets of each text's own (texts + 1)."""
    padded = "".join([f"{t}\n" for t in texts])           # each text ends with a line
    codes = np.frombuffer(padded.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    start = np.cumsum(size) - size
    kind = _kind_table()[np.minimum(codes, 65535)]
    blank = kind <= 1
    row = np.repeat(np.arange(len(texts)), size)
    # A word opens after a blank or at a text's start, and again every WIDE characters.
    opens = ~blank
    opens[1:] &= blank[:-1]
    opens[start] = ~blank[start]
    since = np.arange(len(codes)) - np.maximum.accumulate(np.where(opens, np.arange(len(codes)), 0))
    opens |= ~blank & (since % WIDE == 0)
    word = np.cumsum(opens)                                # number of words opened so far
    first = word[start] - opens[start]                     # words before the text
    inside = np.maximum(word - first[row] - 1, 0)          # place of the word in its text
    own = np.maximum(-(-np.bincount(row, opens, minlength=len(texts)).astype(np.int64) // WORDS), 1)
    off = np.concatenate([[0], np.cumsum(own)])
    place = off[row] + inside // WORDS                     # passage of each character
    n, k = off[-1], len(KINDS)
    chars = np.bincount(place * k + kind, minlength=n * k).reshape(n, k).astype(float)
    near = place[1:] == place[:-1]
    pair = (place[1:] * PAIRED + kind[:-1] * k + kind[1:])[near]
    pairs = np.bincount(pair, minlength=n * PAIRED).reshape(n, PAIRED)
    total = np.maximum(chars.sum(axis=1), 1.0)
    # Words by hash, to see which come again.
    at = np.flatnonzero(opens)
    in_word = np.where(blank, 0, codes + 1).astype(np.uint64)
    weight = _powers(since)
    sums = np.add.reduceat(in_word * weight, at) if len(at) else np.zeros(0, np.uint64)
    of = place[at]
    words = np.bincount(of, minlength=n).astype(float)
    least = np.maximum(words, 1.0)
    order = np.lexsort((sums, of))
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (sums[order][1:] != sums[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order], fresh, minlength=n)
    again = np.zeros(len(at), dtype=bool)
    again[1:] = (sums[1:] == sums[:-1]) & (of[1:] == of[:-1])
    letters = chars[:, 2:5].sum(axis=1)
    extra = np.stack([
        words / WORDS, letters / least / 8.0, chars[:, 5] / least, distinct / least,
        np.bincount(of, again, minlength=n) / least, chars[:, 3] / np.maximum(letters, 1.0),
        (words == 0).astype(float), np.log1p(total) / 8.0], axis=1)
    return np.hstack([chars / total[:, None], pairs / total[:, None], extra]).astype(np.float32), off


@lru_cache(maxsize=1)
def _power_table() -> np.ndarray:
    base, out = 0x9E3779B97F4A7C15, np.ones(WIDE, dtype=np.uint64)
    for i in range(1, WIDE):
        out[i] = np.uint64(int(out[i - 1]) * base % (1 << 64))
    return out


def _powers(since: np.ndarray) -> np.ndarray:
    return _power_table()[since % WIDE]


# ------------------------------------------------------------------- the model
@dataclass
class Network:
    """Passage layer, gated attention, and the score of the weighted mean."""

    centre: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    share: float | None = None      # of label 1, where there was nothing to tell apart

    def forward(self, x: np.ndarray, off: np.ndarray):
        p, starts = self.p, off[:-1]
        x = np.clip((x - self.centre) / self.scale, -6.0, 6.0)
        h = np.tanh(x @ p["w"] + p["b"])
        t = np.tanh(h @ p["v"] + p["vb"])
        g = 1.0 / (1.0 + np.exp(-(h @ p["u"] + p["ub"])))
        a = (t * g) @ p["a"]
        bag = np.repeat(np.arange(len(starts)), np.diff(off))
        e = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        weight = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(weight[:, None] * h, starts)
        y = 1.0 / (1.0 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return x, h, t, g, weight, bag, z, y

    def scores(self, x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each bag's score, and each passage's weight in it."""
        if self.share is not None:
            return np.full(len(off) - 1, self.share), 1.0 / np.repeat(np.diff(off), np.diff(off))
        out = self.forward(x, off)
        return out[-1], out[4]

    def gradient(self, x, off, label, cost) -> dict[str, np.ndarray]:
        p = self.p
        x, h, t, g, weight, bag, z, y = self.forward(x, off)
        d = (y - label) * cost / cost.sum()
        dz = d[:, None] * p["c"]
        dw = (dz[bag] * h).sum(axis=1)
        da = weight * (dw - np.add.reduceat(weight * dw, off[:-1])[bag])
        dtg = da[:, None] * p["a"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (weight[:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "vb": dt.sum(axis=0),
                "u": h.T @ dg, "ub": dg.sum(axis=0), "a": (t * g).T @ da, "c": z.T @ d,
                "d": d.sum(keepdims=True)}


def fit_network(x: np.ndarray, off: np.ndarray, label: np.ndarray, seed: int = 0) -> Network:
    """Adam on the log loss; both labels weigh the same in each step."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    centre, spread = x.mean(axis=0), x.std(axis=0)

    def start(n, m):
        return rng.normal(0.0, 1.0 / np.sqrt(n), (n, m))

    net = Network(centre, np.maximum(spread, 1e-3), {
        "w": start(width, HIDDEN), "b": np.zeros(HIDDEN), "v": start(HIDDEN, GATE),
        "vb": np.zeros(GATE), "u": start(HIDDEN, GATE), "ub": np.zeros(GATE),
        "a": start(GATE, 1)[:, 0], "c": start(HIDDEN, 1)[:, 0], "d": np.zeros(1)})
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    n = np.bincount(label.astype(int), minlength=2)
    cost = np.where(label == 1, len(label) / (2.0 * n[1]), len(label) / (2.0 * n[0]))
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        deal = rng.permutation(len(label))
        for at in range(0, len(deal), BATCH):
            pick = deal[at:at + BATCH]
            size = np.diff(off)[pick]
            rows = np.arange(size.sum()) + np.repeat(off[pick] - (np.cumsum(size) - size), size)
            grad = net.gradient(x[rows], np.concatenate([[0], np.cumsum(size)]), label[pick], cost[pick])
            step += 1
            for k, g in grad.items():
                g = g + DECAY * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


# ---------------------------------------------------------------------- Spark
def _measured(batches):
    for b in batches:
        for part in slices(b):
            x, off = passages([r.decode("utf-8", "replace") for r in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.diff(off)),
                 pa.array([x[s:e].tobytes() for s, e in zip(off, off[1:])], pa.binary())],
                names=["doc_id", "label", "n", "x"])


def _scorer(shared):
    def run(batches):
        net = shared.value
        for b in batches:
            for part in slices(b):
                x, off = passages([r.decode("utf-8", "replace") for r in part.column(1).to_pylist()])
                score, weight = net.scores(x, off)
                most = np.maximum.reduceat(weight, off[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score, pa.float64()), pa.array(np.diff(off)),
                     pa.array(most, pa.float64())],
                    names=["doc_id", "score", "n_passages", "most_weight"])
    return run


def held_out(doc_id) -> F.Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, documents_each: int = DOCUMENTS) -> DataFrame:
    """(doc_id, text, label): about so many documents of each label, by hash of the identifier."""
    known = (labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id")
             .agg(F.min("label").cast("int").alias("label")).where(~held_out(F.col("doc_id"))))
    known = materialise(known, "labels")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    scale = 1 << 30
    share = F.lit(0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, min(scale, scale * documents_each // n)).otherwise(share)
    some = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(13)), F.lit(scale)) < share)
    # About twice ``documents_each`` identifiers and labels.
    return docs.join(F.broadcast(some.withColumnRenamed("doc_id", "_d")),
                     F.col("doc_id") == F.col("_d")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, seed: int = 0, documents_each: int = DOCUMENTS,
        most: int = PASSAGES) -> Network:
    """``docs`` (doc_id, text), ``labels`` (doc_id, label); see :class:`Network`."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, documents_each)
    kind = dict(sample.dtypes)["doc_id"]
    made = materialise(texts_as_bytes(sample, "label").mapInArrow(
        _measured, f"doc_id {kind}, label int, n long, x binary"), "passages")
    # Whole documents up to the bound on passages, in the order of their hash.
    sizes = made.select(F.xxhash64("doc_id").alias("h"), "doc_id", "n").toArrow().to_pandas()
    sizes = sizes.sort_values(["h", "doc_id"])
    sizes = sizes[sizes["n"].cumsum() <= most]
    last = int(sizes["h"].max()) if len(sizes) else -(1 << 63)
    got = made.where(F.xxhash64("doc_id") <= last).toArrow().to_pandas().sort_values("doc_id", kind="stable")
    label = got["label"].to_numpy(dtype=float)
    none = {}
    if len(np.unique(label)) < 2:
        share = float(label.mean()) if len(label) else 0.5
        return Network(np.zeros(WIDTH), np.ones(WIDTH), none, share)
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(-1, WIDTH).astype(np.float64)
    return fit_network(x, np.concatenate([[0], np.cumsum(got["n"].to_numpy())]), label, seed)


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", *, threshold: float = THRESHOLD, seed: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, most_weight), a row per input row.

    ``labels`` has the identifier and the label 0 or 1. ``most_weight`` is the attention
    that the passage of most weight got.
    """
    docs = documents(df, id_col, text_col)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    net = fit(docs, known, seed)
    shared = df.sparkSession.sparkContext.broadcast(net)
    out = texts_as_bytes(docs).mapInArrow(
        _scorer(shared), out_schema(docs, "score double, n_passages long, most_weight double"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages",
                      "most_weight")
