"""Language identification with interpolated Kneser-Ney character models.

Letter runs of a text, lower-cased and bounded by blanks, are sequences of characters;
each language has a model of order ``ORDER`` over them. Workers count distinct
words, Spark sums them, words become n-grams, and discounts,
continuation counts and back-off weights are SQL aggregates over n-grams. The model is
one sorted array of n-gram hashes with, per language, the discounted probability of each
n-gram and its weight as a context. Up to ``CELLS`` it is broadcast; a larger one stays a
table that the n-grams of the distinct words are joined with. Either way it is whole.

A text goes to the language of lowest cross-entropy per character. All training texts with remainder 3
calibrate, however many, scored by a first model of the other remainders' counts, so that no text is judged by
itself. The model that predicts counts them too: always for the queries, and in :func:`fit` where more than ``spared``
calibrate. Texts of remainder ``HELD`` are not learned from, unless the caller holds none out. One temperature turns
cross-entropies into a score, and per language a threshold: a text is rejected if it fits
its best language worse than 99 % of that language's own texts and worse than the best 5 % of
foreign texts do, or worse than half of the foreign ones. Quantiles, so that a few garbled or
mislabelled rows move nothing; mixed texts stay. Words are scored once per worker and remembered.

Defined results: ``und`` with score 0 for a null text, one without a letter as it stands (signs
that only compose to letters are none), or when nothing could be learned; letters that no model
can read go to the first language; texts of fewer than ``JUDGED`` characters in letters are not rejected
for their entropy; ties go to the first language in order; a row with a null identifier is
never learned from; repeated rows keep one row each.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.bpe import slices
from panelyard.llm.shared import documents, out_schema, ship, texts_as_bytes
from panelyard.sources.store import materialise

ORDER = 4
CELLS = 4_000_000        # n-grams times languages up to which the model is broadcast
HELD = 2                 # remainder of the texts that are predicted without having been learned from
CALIBRATED = 20_000      # calibrating rows beyond which these are counted too, unless the caller says otherwise
JUDGED = 20              # characters from which a text can be rejected for its entropy
REMEMBERED = 200_000     # chunks a worker keeps before it starts anew
FLUSHED = 150_000        # distinct chunks a worker counts before it hands them on
ALPHABET = 1 << 16       # characters that share the last back-off
UNKNOWN = "und"
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LETTER = regex.compile(r"\p{L}")
BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(chunk: str) -> list[str]:
    """Runs of letters, composed, so that a decomposed text is the same text."""
    word = chunk.strip(".,!?;:\"'()#$%&*|")
    if word.isalpha() and unicodedata.is_normalized("NFKC", word):
        return [word]
    return LETTERS.findall(unicodedata.normalize("NFKC", chunk))


def _char_grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character of blank-bounded words.

    Returns per order the hashes, each position's place in its word, and its word.
    """
    text = "".join([f" {w} " for w in words])
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    power, poly, grams = np.uint64(1), np.zeros(len(codes), dtype=np.uint64), []
    for n in range(1, ORDER + 1):
        shifted = np.zeros(len(codes), dtype=np.uint64)
        shifted[n - 1:] = codes[:len(codes) - n + 1] if n > 1 else codes
        poly = poly + (shifted + np.uint64(1)) * power
        power = np.uint64(int(power) * int(BASE) % (1 << 64))
        h = poly * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
        grams.append(h ^ (h >> np.uint64(31)))
    return grams, place, word


# ----------------------------------------------------------------- counting
def _word_batches(batches):
    seen: dict[tuple[str, bool], Counter] = defaultdict(Counter)

    def out():
        for (lang, first), chunks in seen.items():
            words: Counter = Counter()
            for chunk, n in chunks.items():
                for w in letter_runs(chunk):
                    words[w] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()),
                 pa.array(list(words.values()), pa.int64()), pa.array([first] * len(words))],
                names=["lang", "word", "n", "first"])
        seen.clear()

    for b in batches:
        for part in slices(b):
            for lang, first, raw in zip(part.column(2).to_pylist(), part.column(3).to_pylist(),
                                        part.column(1).to_pylist()):
                seen[lang, first].update(raw.decode("utf-8", "replace").lower().split())
            if sum(map(len, seen.values())) > FLUSHED:
                yield from out()
    yield from out()


def _gram_frames(frames):
    for f in frames:
        for at in range(0, len(f), 50_000):
            part = f.iloc[at:at + 50_000]
            grams, place, word = _char_grams(part["word"].tolist())
            lang, n, n_first = (part[c].to_numpy()[word] for c in ("lang", "n", "n_first"))
            for k in range(1, ORDER + 1):
                ok = place >= max(k - 1, 1)
                before, after = np.zeros_like(grams[0]), np.zeros_like(grams[0])
                if k > 1:
                    before[1:] = grams[k - 2][:-1]
                    after = grams[k - 2]
                rows = pd.DataFrame({
                    "lang": lang[ok], "k": k, "gram": grams[k - 1][ok].view(np.int64),
                    "context": before[ok].view(np.int64), "suffix": after[ok].view(np.int64),
                    "opens": (place == k - 1)[ok], "n": n[ok], "n_first": n_first[ok]})
                yield rows.groupby(["lang", "k", "gram"], as_index=False, sort=False).agg(
                    {"context": "first", "suffix": "first", "opens": "max", "n": "sum", "n_first": "sum"})


def _grams(training: DataFrame) -> DataFrame:
    """(lang, k, gram, context, suffix, opens, n, n_first): how often in all texts, and in those of ``first``."""
    docs = texts_as_bytes(training, "lang", "first")
    words = docs.mapInArrow(_word_batches, "lang string, word string, n long, first boolean").groupBy(
        "lang", "word").agg(F.sum("n").alias("n"), F.sum(
            F.when(F.col("first"), F.col("n")).otherwise(0)).alias("n_first"))
    return materialise(words.mapInPandas(
        _gram_frames, "lang string, k int, gram long, context long, suffix long, opens boolean, "
                      "n long, n_first long").groupBy("lang", "k", "gram").agg(
        F.first("context").alias("context"), F.first("suffix").alias("suffix"),
        F.max("opens").alias("opens"), F.sum("n").alias("n"), F.sum("n_first").alias("n_first")), "lm-grams")


def _models(grams: DataFrame) -> DataFrame:
    """(lang, k, gram, p, weight, n): discounted probability, and weight as a context."""
    left = grams.where("k > 1").groupBy(
        "lang", (F.col("k") - 1).alias("k"), F.col("suffix").alias("gram")).agg(
        F.count("*").alias("kinds"))
    c = F.when((F.col("k") == ORDER) | (F.col("opens") & (F.col("k") > 1)), F.col("n")).otherwise(
        F.coalesce("kinds", F.lit(1)))
    counted = grams.join(left, ["lang", "k", "gram"], "left").withColumn("c", c)
    rates = counted.groupBy("lang", "k").agg(
        F.count(F.when(F.col("c") == 1, 1)).alias("n1"), F.count(F.when(F.col("c") == 2, 1)).alias("n2"))
    d = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    rates = rates.select("lang", "k", F.least(F.greatest(d, F.lit(0.1)), F.lit(0.95)).alias("d"))
    contexts = counted.groupBy("lang", "k", "context").agg(
        F.sum("c").alias("total"), F.count("*").alias("types"))
    full = counted.join(rates, ["lang", "k"]).join(contexts, ["lang", "k", "context"])
    p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
    weights = contexts.join(rates, ["lang", "k"]).select(
        "lang", (F.col("k") - 1).alias("k"), F.col("context").alias("gram"),
        (F.col("d") * F.col("types") / F.col("total")).alias("weight"))
    return full.select("lang", "k", "gram", p.alias("p"), "n").join(
        weights, ["lang", "k", "gram"], "full").select(
        "lang", "k", "gram", F.coalesce("p", F.lit(0.0)).alias("p"),
        F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("n", F.lit(1 << 60)).alias("n"))


class Model:
    """Sorted hashes; per language the discounted probability and the back-off weight."""

    def __init__(self, langs, hashes, p, weight, roots):
        self.langs, self.hashes, self.p, self.weight, self.roots = langs, hashes, p, weight, roots
        self.temperature, self.thresholds = 8.0, np.full(len(langs), np.inf)
        self.letters = np.zeros(len(langs))
        self.table: DataFrame | None = None  # the n-grams, where they are too many to broadcast
        self.starts: tuple | None = None  # where hashes of equal first bits start, and the hashes with an end

    def __getstate__(self):
        return self.__dict__ | {"table": None, "starts": None}

    def _row(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash; the last row (nothing, all back-off) where there is none."""
        size = len(self.hashes)
        bits = min(size.bit_length() + 2, 22)
        if self.starts is None:
            first = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
            self.starts = np.searchsorted(self.hashes, first), np.append(self.hashes, np.uint64((1 << 64) - 1))
        starts, ended = self.starts
        at = starts[h >> np.uint64(64 - bits)]
        left = np.flatnonzero(ended[at] < h)
        while len(left):
            at[left] += 1
            left = left[ended[at[left]] < h[left]]
        at[ended[at] != h] = size
        return at

    def words(self, words: list[str]) -> np.ndarray:
        """Per word: characters predicted, then nats in each language."""
        grams, place, word = _char_grams(words)
        rows = [self._row(g) for g in grams]
        p = self.p[rows[0]] + self.roots / ALPHABET
        for k in range(2, ORDER + 1):
            ok = np.flatnonzero(place >= k - 1)
            context = rows[k - 2][ok - 1]
            p[ok] = self.p[rows[k - 1][ok]] + self.weight[context] * p[ok]
        p[place == 0] = 1.0
        nats = -np.log(np.maximum(p, 1e-30))
        out = np.zeros((len(words), 1 + len(self.langs)))
        starts = np.flatnonzero(place == 0)
        out[:, 0] = np.add.reduceat((place > 0).astype(float), starts)
        out[:, 1:] = np.add.reduceat(nats, starts, axis=0)
        return out

    def entropies(self, texts: list[str], memory: Memory) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text, and nats per character in each language."""
        rows = memory.rows(self, [t.lower().split() for t in texts])
        chars = rows[:, 0]
        return chars, rows[:, 1:] / np.maximum(chars, 1.0)[:, None]

    def choose(self, chars: np.ndarray, x: np.ndarray):
        """Index of the language, score, and whether the text is rejected."""
        best = x.argmin(axis=1)
        z = -(x - x.min(axis=1, keepdims=True)) * self.temperature
        e = np.exp(z)
        score = e.max(axis=1) / e.sum(axis=1)
        odd = (chars >= JUDGED) & (x.min(axis=1) > self.thresholds[best])
        return best, score, odd


def _arrays(langs, grams, by):
    """Sorted hashes, and a row of p and weight for each and for a missing n-gram."""
    place = {lang: i for i, lang in enumerate(langs)}
    each = [(i, place[e["lang"]], e["p"], e["weight"]) for i, found in enumerate(by) for e in found]
    row, lang, p, weight = zip(*each) if each else ([], [], [], [])
    return _filled(len(langs), np.array(grams, dtype=np.int64), np.array(row, np.int64),
                   np.array(lang, np.int64), p, weight)


def _filled(n_langs, grams, row, lang, p, weight):
    """:func:`_arrays` of entries: the n-gram's row, its language, p and weight."""
    hashes = grams.view(np.uint64)
    order = np.argsort(hashes)
    at = np.argsort(order)[row]
    ps = np.zeros((len(order) + 1, n_langs), dtype=np.float32)
    weights = np.ones((len(order) + 1, n_langs), dtype=np.float32)
    ps[at, lang], weights[at, lang] = p, weight
    return hashes[order], ps, weights


def _column(table: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    return pa.concat_arrays(table[name].chunks) if table.num_rows else pa.array([], table[name].type)


class Memory:
    """What a worker has scored: chunk -> row of a growing matrix."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, 0))

    def rows(self, model: Model, cut: list[list[str]]) -> np.ndarray:
        width = 1 + len(model.langs)
        if len(self.index) > REMEMBERED or self.table.shape[1] != width:
            self.index, self.table = {}, np.zeros((1024, width))
        new = list(set().union(*cut).difference(self.index))
        if new:
            found = list(map(letter_runs, new))
            words = [w for f in found for w in f]
            made = np.zeros((len(new), width))
            if words:
                once: dict[str, int] = {}
                of = [once.setdefault(w, len(once)) for w in words]
                size = np.array([len(f) for f in found])
                starts, some = np.cumsum(size) - size, size > 0
                made[some] = np.add.reduceat(model.words(list(once))[of], starts[some], axis=0)
            at = len(self.index)
            while len(self.table) < at + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at:at + len(new)] = made
            self.index.update(zip(new, range(at, at + len(new))))
        out = np.zeros((len(cut), width))
        place = self.index.__getitem__
        for i, c in enumerate(cut):
            if c:
                out[i] = self.table[np.fromiter(map(place, c), np.int64, len(c))].sum(axis=0)
        return out


_memories: dict[str, Memory] = {}


def _memory(key: str) -> Memory:
    if key not in _memories:
        _memories.clear()
        _memories[key] = Memory()
    return _memories[key]


def _letterless(texts: list[str]) -> np.ndarray:
    """Texts without a letter as they stand: composing may make letters of a sign."""
    return np.array([LETTER.search(t) is None for t in texts], dtype=bool)


def _scorer(shared, key: str, detail: bool):
    def run(batches):
        model, memory = shared.value, _memory(key)
        for b in batches:
            for part in slices(b):
                texts = [t.decode("utf-8", "replace") for t in part.column(1).to_pylist()]
                chars, x = model.entropies(texts, memory)
                if detail:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(2), pa.array(chars, pa.float64()),
                         pa.array(list(x), pa.list_(pa.float64()))],
                        names=["doc_id", "lang", "chars", "x"])
                    continue
                best, score, odd = model.choose(chars, x)
                none = _letterless(texts)
                names = np.array(model.langs, dtype=object)[best]
                names[none] = UNKNOWN
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()),
                     pa.array(np.where(none, 0.0, score)), pa.array(x.min(axis=1)),
                     pa.array(none | odd)],
                    names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])
    return run


# ------------------------------------------------- scoring by joins, for large models
def _row_words(batches):
    for b in batches:
        for part in slices(b):
            for row, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words: Counter = Counter()
                for chunk, n in Counter(raw.decode("utf-8", "replace").lower().split()).items():
                    for w in letter_runs(chunk):
                        words[w] += n
                if words:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(words), pa.int64()), pa.array(list(words), pa.string()),
                         pa.array(list(words.values()), pa.int64())], names=["row", "word", "n"])


def _word_grams(frames):
    for f in frames:
        for at in range(0, len(f), 10_000):
            words = f["word"].iloc[at:at + 10_000].to_numpy()
            grams, _, word = _char_grams(list(words))
            yield pd.DataFrame({"word": np.tile(words[word], ORDER),
                                "gram": np.concatenate(grams).view(np.int64)}).drop_duplicates()


def _word_nats(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                known: dict[int, list] = {}
                for found in part.column(1).to_pylist():
                    known.update((e["gram"], e["by"]) for e in found)
                local = Model(model.langs, *_arrays(model.langs, list(known), list(known.values())),
                              model.roots)
                made = local.words(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(made[:, 0]),
                     pa.array(list(made[:, 1:]), pa.list_(pa.float64()))],
                    names=["word", "chars", "nats"])
    return run


def _joined(rows: DataFrame, model: Model) -> DataFrame:
    """(row, chars, x, lettered) of (row, raw): every word's n-grams joined with the model's table."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    words = materialise(rows.mapInArrow(_row_words, "row long, word string, n long"), "lm-words")
    grams = words.select("word").distinct().mapInPandas(_word_grams, "word string, gram long")
    found = grams.join(model.table, "gram", "left").groupBy("word").agg(F.collect_list(F.when(
        F.col("by").isNotNull(), F.struct("gram", "by"))).alias("found"))
    nats = found.mapInArrow(_word_nats(shared), "word string, chars double, nats array<double>")
    sums = words.join(nats, "word").groupBy("row").agg(
        F.sum(F.col("n") * F.col("chars")).alias("chars"),
        *[F.sum(F.col("n") * F.get("nats", F.lit(i))).alias(f"s{i}") for i in range(len(model.langs))])
    each = F.array(*[F.col(f"s{i}") / F.col("chars") for i in range(len(model.langs))])
    none = F.array(*[F.lit(0.0)] * len(model.langs))
    lettered = F.col("raw").cast("string").rlike("\\p{L}").alias("lettered")
    return rows.select("row", lettered).join(sums, "row", "left").select(
        "row", F.coalesce("chars", F.lit(0.0)).alias("chars"),
        F.when(F.col("chars") > 0, each).otherwise(none).alias("x"), "lettered")


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with a stored number of their own, so that equal rows stay apart."""
    return materialise(df.withColumn("row", F.monotonically_increasing_id()), "lm-rows")


def _chooser(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            chars = np.array(b.column(1).to_pylist())
            x = np.array(b.column(2).to_pylist())
            best, score, odd = model.choose(chars, x)
            none = ~np.array(b.column(3).to_pylist(), dtype=bool)
            names = np.array(model.langs, dtype=object)[best]
            names[none] = UNKNOWN
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.string()), pa.array(np.where(none, 0.0, score)),
                 pa.array(x.min(axis=1)), pa.array(none | odd)],
                names=["row", "lang_pred", "score", "cross_entropy", "rejected"])
    return run


def _chosen(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return _joined(rows, model).mapInArrow(
        _chooser(shared), "row long, lang_pred string, score double, cross_entropy double, "
                          "rejected boolean")


def part_of(id_col="doc_id"):
    """crc32 of the identifier as text, modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", held_out: int | None = HELD,
        spared: int | None = None) -> Model | None:
    """Temperature and thresholds from all texts of remainder 3 as a model of the others scores them; beyond
    ``spared`` such texts, the model returned counts them too. Texts of remainder ``held_out`` are not learned
    from (None: all are). None if there is nothing to learn."""
    ship(df.sparkSession)
    docs = documents(df, id_col, text_col, lang=lang_col).where(
        "doc_id is not null and text is not null and lang is not null").withColumn("part", part_of())
    if held_out is not None:
        docs = docs.where(F.col("part") != held_out)
    sizes = docs.groupBy("lang").agg(F.count(F.when(F.col("part") != 3, 1)).alias("learned"),
                                     F.count(F.when(F.col("part") == 3, 1)).alias("other")).collect()
    # A language with rows of remainder 3 only is learned from them, in both models.
    both = [r["lang"] for r in sizes if r["learned"] and r["other"]]  # one row per language
    calibrates = (F.col("part") == 3) & F.col("lang").isin(both)
    grams = _grams(docs.withColumn("first", ~calibrates).drop("part"))
    model = _counted(grams.where("n_first > 0").withColumn("n", F.col("n_first")))
    if model is not None:
        _calibrate(model, docs.where(calibrates).drop("part"))
    if sum(r["other"] for r in sizes if r["lang"] in set(both)) <= (CALIBRATED if spared is None else spared):
        return model
    whole = _counted(grams)
    if model is None:
        return whole
    whole.temperature = model.temperature
    known = dict(zip(model.langs, model.thresholds))
    whole.thresholds = np.array([known.get(lang, np.inf) for lang in whole.langs])
    return whole


def _counted(grams: DataFrame) -> Model | None:
    """The model of the n-grams' counts ``n``, not calibrated."""
    table = materialise(_models(grams), "lm")
    totals = table.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row per language
    if not totals:
        return None
    langs = sorted(r["lang"] for r in totals)
    grams = materialise(table.groupBy("gram").agg(
        F.min("k").alias("k"), F.collect_list(F.struct("lang", "p", "weight")).alias("by")), "lm-by")
    if grams.count() * len(langs) > CELLS:  # looked up by joins, nothing is left out
        few = grams.where("k < 2").select("k", F.explode("by").alias("e")).select("k", "e.*")
        model = Model(langs, *_arrays(langs, [], []), np.ones(len(langs)))
        for r in few.groupBy("lang").agg(F.max(F.when(F.col("k") == 0, F.col("weight"))).alias("w"),
                                         F.count(F.when(F.col("k") == 1, 1)).alias("n")).collect():
            i = langs.index(r["lang"])
            model.roots[i], model.letters[i] = 1.0 if r["w"] is None else r["w"], r["n"]
        model.table = grams.select("gram", "by")
    else:
        got = grams.toArrow().combine_chunks()  # CELLS at most
        by, k = _column(got, "by"), _column(got, "k").to_numpy()
        row, e = np.repeat(np.arange(len(k)), by.value_lengths().to_numpy()), by.flatten()
        lang = pc.index_in(e.field("lang"), pa.array(langs)).to_numpy()
        weight = e.field("weight").to_numpy()
        model = Model(langs, *_filled(len(langs), _column(got, "gram").to_numpy(), row, lang,
                                      e.field("p").to_numpy(), weight), np.ones(len(langs)))
        model.roots[lang[k[row] == 0]] = weight[k[row] == 0]
        model.letters += np.bincount(lang[k[row] == 1], minlength=len(langs))
    return model


def _calibrate(model: Model, docs: DataFrame) -> None:
    if model.table is not None:
        rows = _numbered(texts_as_bytes(docs, "lang"))
        scored = rows.drop("raw").join(_joined(rows.select("row", "raw"), model), "row")
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        schema = out_schema(docs, "chars double, x array<double>", "lang").fields
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in
                          [schema[0], schema[1], *schema[2:]])
        scored = texts_as_bytes(docs, "lang").mapInArrow(_scorer(shared, "calibration", True), kinds)
    names = F.array(*map(F.lit, model.langs))
    at = F.array_position(names, F.col("lang")).cast("int")
    scored = materialise(scored.withColumn("own", F.get("x", at - 1)).withColumn(
        "low", F.array_min("x")).where(f"own is not null and chars >= {JUDGED}"), "lm-calibration")

    def loss(t):
        total = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.exp(-(v - F.col("low")) * t))
        return F.avg((F.col("own") - F.col("low")) * t + F.log(total))

    losses = scored.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    if losses[0] is not None:
        model.temperature = TEMPERATURES[int(np.argmin(losses))]
    each = scored.select((at - 1).alias("own"), F.posexplode("x").alias("i", "nats"))
    foreign = F.when(F.col("i") != F.col("own"), F.col("nats"))
    own = F.when(F.col("i") == F.col("own"), F.col("nats"))
    for r in each.groupBy("i").agg(
            F.percentile_approx(foreign, [0.05, 0.5], 10_000).alias("foreign"),
            F.percentile_approx(own, 0.99, 10_000).alias("own")).collect():  # one row per language
        # Without foreign texts, uniformly random letters stand for them.
        low, middle = r["foreign"] or [float(np.log(model.letters[r["i"]] + 1))] * 2
        model.thresholds[r["i"]] = min(max(low, r["own"] or 0.0), middle)


def predict(df: DataFrame, model: Model | None, id_col="doc_id", text_col="text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected), one row per input row."""
    docs = documents(df, id_col, text_col)
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
    ship(df.sparkSession)
    if model.table is not None:
        rows = _numbered(texts_as_bytes(docs))
        return rows.select("doc_id", "row").join(
            _chosen(rows.select("row", "raw"), model), "row").drop("row")
    shared = df.sparkSession.sparkContext.broadcast(model)
    key = f"{id(shared)}-{shared._jbroadcast.id()}"
    return texts_as_bytes(docs).mapInArrow(_scorer(shared, key, False), out_schema(
        docs, "lang_pred string, score double, cross_entropy double, rejected boolean"))


def _keeper(shared, key: str):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, memory = shared.value, _memory(key)
        for b in texts:
            good = [np.zeros(0, dtype=bool)]
            for part in slices(pa.RecordBatch.from_arrays([b], names=["raw"]), at=0):
                some = [t.decode("utf-8", "replace") for t in part.column(0).to_pylist()]
                chars, x = model.entropies(some, memory)
                good.append(~_letterless(some) & ~model.choose(chars, x)[2])
            yield pa.array(np.concatenate(good))
    return run


def known_only(df: DataFrame, model: Model | None, text_col="text") -> DataFrame:
    """The rows whose text is not rejected, all columns as they are.

    Only texts go to the workers, and only verdicts come back: the rows wait where they are.
    """
    spark, names = df.sparkSession, df.columns
    places = df.toDF(*[f"c{i}" for i in range(len(names))])
    if model is None:
        return df.limit(0)
    ship(spark)
    raw = F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit("")).cast("binary")
    if model.table is not None:
        rows = _numbered(places.select(raw.alias("raw"), "*"))
        good = _chosen(rows.select("row", "raw"), model).where("not rejected").select("row")
        return rows.join(good, "row", "left_semi").drop("row", "raw").toDF(*names)
    shared = spark.sparkContext.broadcast(model)
    key = f"{id(shared)}-{shared._jbroadcast.id()}"
    return places.where(F.arrow_udf(_keeper(shared, key), "boolean")(raw)).toDF(*names)


def identify(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """Learn from the whole training part of the table and predict all of it."""
    model = fit(df, id_col, text_col, lang_col, spared=0)
    held = F.coalesce(part_of() == HELD, F.lit(False)).alias("held_out")
    out = predict(df, model, id_col, text_col)
    return out.select("doc_id", held, "lang_pred", "score", "cross_entropy", "rejected")
