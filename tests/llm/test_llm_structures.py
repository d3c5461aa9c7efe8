"""Tokenizer alignment, conversation trie and passage attention against plain versions."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelyard.llm import alignment, attention, langid, mixing, prefix_trie, queries, shared, simhash

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


# ------------------------------------------------------------------ alignment
def plain_alignment(texts):
    """Per text (n_a, n_b, common ends, linked pairs, groups), whole texts at once."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_LEVEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.PIECES))
    of = alignment._byte_characters()

    def a_bytes(i):
        t = a.id_to_token(i)
        return bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()

    def b_bytes(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(
            "▁", " ").encode()

    for text in texts:
        whole = (" " + text).encode() if text else b""
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xs, ys = [a_bytes(i) for i in x], [b_bytes(i) for i in y]
        if not text or b"".join(xs) != whole or b"".join(ys) != whole:
            yield None
            continue
        ex, ey = np.cumsum([len(t) for t in xs]).tolist(), np.cumsum([len(t) for t in ys]).tolist()
        common = sorted(set(ex) & set(ey))
        links, i, j = [], 0, 0
        while i < len(x) and j < len(y):          # walk both lists of ends
            links.append((x[i], y[j]))
            i, j = i + (ex[i] <= ey[j]), j + (ey[j] <= ex[i])
        groups, i, j = [], 0, 0
        for c in common:
            m, n = ex.index(c, i) + 1, ey.index(c, j) + 1
            groups.append(",".join(map(str, x[i:m])) + "|" + ",".join(map(str, y[j:n])))
            i, j = m, n
        yield len(x), len(y), len(common), links, ";".join(groups)


ALPHABET = ["a", "b", "the", " ", "  ", "\n", "\r", "\t", "é", "日", "😀", "'s", "1", "23", "!!", "###",
            "\xa0", "　", "{", "}", ";", ")", " {", "\r\n", "\x85", "<s>", "<|endoftext|>", "▁"]


def test_alignment_of_odd_strings():
    rng = random.Random(3)
    texts = ["", " ", "\n", "a ", "▁", "ﬁ ①", "x" * 3000, "日本" * 500]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    t = alignment.Tokenizers(public_tokenizers.path(alignment.BYTE_LEVEL),
                             public_tokenizers.path(alignment.PIECES))
    for again in range(2):                        # the second time from memory
        got = t.align(texts)
        for k, want in enumerate(plain_alignment(texts)):
            lo, hi = got["off"][k], got["off"][k + 1]
            pairs = dict(zip(got["pairs"][lo:hi].tolist(), got["times"][lo:hi].tolist()))
            if want is None:
                assert not got["n"][k].any() and not pairs and got["digest"][k] == ""
                continue
            n_a, n_b, n_groups, links, groups = want
            assert got["n"][k].tolist() == [n_a, n_b, n_groups]
            assert got["n_links"][k] == len(links) == n_a + n_b - n_groups
            assert pairs == Counter(a * t.b_size + b for a, b in links)
            assert got["digest"][k] == hashlib.sha256(groups.encode()).hexdigest()


def test_galloping_finds_first_places():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 5000), (300, 5000), (4000, 4100)):
        long = np.unique(rng.integers(0, 50_000, m))
        short = np.unique(rng.choice(np.concatenate([long, rng.integers(0, 50_000, m)]), n))
        got = alignment.gallop(short, long, np.zeros(len(short), int), np.full(len(short), len(long)))
        assert (got == np.searchsorted(long, short)).all()


@pytest.mark.parametrize("pairs", [alignment.PAIRS, 10])
def test_alignment_counts_over_all_texts(spark, pairs):
    """Counts come by broadcast or, past the bound, by a join; both equal the plain version."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(150)
    docs = docs.unionByName(docs.where("doc_id = 3"))
    rows = docs.toPandas()
    found = list(plain_alignment([t or "" for t in rows["text"]]))
    count, best = Counter(), defaultdict(int)
    for f in found:
        count.update(set(f[3]) if f else ())
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = sorted((int(i), *(f[:3] if f else (0, 0, 0)), len(f[3]) if f else 0,
                   sum(count[p] == best[p[0]] for p in f[3]) if f else 0,
                   sum(count[p] for p in f[3]) if f else 0) for i, f in zip(rows["doc_id"], found))
    got = alignment.align(docs, pairs=pairs).drop("groups_sha256").collect()
    assert sorted(tuple(r) for r in got) == want


# ------------------------------------------------------------------------ trie
def plain_trie(seqs):
    """{opening: (conv_id, depth, parent, n, children, leaves, saved, ends)} from (id, [(turn, words)])."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in seqs:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * k[-1][1] if k else 0
    for k, m in members.items():
        yield (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
               hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_trie_over_partitions(spark, partitions):
    rng = random.Random(partitions)
    turns = {w: (hashlib.sha256(w.encode()).hexdigest()[:32], len(w)) for w in ("a", "bb", "ccc", "dddd")}
    seqs = [(i, [turns[rng.choice("a bb ccc dddd".split())] for _ in range(rng.randint(0, 6))])
            for i in range(-20, 300)]
    seqs += [(1000 + i, [turns["a"], turns["bb"]]) for i in range(200)]      # a popular one
    seqs += [(5000, [turns["a"]] * 300)]
    df = spark.createDataFrame([(c, [(0, d, w) for d, w in t]) for c, t in seqs],
                               "conv_id long, turns array<struct<turn: int, digest: string, words: long>>")
    got = prefix_trie.prefix_trie(df, partitions).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_trie(seqs), key=key)


def test_trie_members_in_many_pieces(spark):
    turn = (0, "f" * 32, 3)
    df = spark.range(50_000).select(F.col("id").alias("conv_id"), F.array(F.struct(
        F.lit(0).alias("turn"), F.lit("f" * 32).alias("digest"), F.lit(3).cast("long").alias("words"))).alias("turns"))
    got = {r.depth: r for r in prefix_trie.prefix_trie(df, 2).collect()}
    assert turn[2] * 49_999 == got[1].saved_tokens == got[0].saved_tokens and got[0].n_leaves == 1
    assert got[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(50_000))).encode()).hexdigest()


def test_conversations_with_odd_rows(spark):
    kinds = "conv_id long, turn int, role string, text string, key string, turns string, donor int"
    rows = [(0, 1, "user", "hello there", "", "", 1), (0, None, "system", None, "", "", 1),
            (0, 2, None, "x  y", "", "", 1), (21, 0, "user", "own", "", "", 1), (21, 0, "user", "own", "", "", 1),
            (None, 0, "user", "nobody", "", "", 1), (7, 0, "user", "seven " * 2000, "", "", 1)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, kinds)).collect()
    said = {0: [("system", ""), ("user", "hello there"), ("", "x  y")], 21: [("user", "own")] * 2,
            7: [("user", "seven " * 2000)]}
    seqs = []
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs.append((c, [((r, t), len(t.split())) for r, t in said.get(c - c % 20, [])[:h] + own[h:]]))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain_trie(seqs), key=key)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], kinds)).count() == 0


# ------------------------------------------------------------------- attention
def test_attention_gradient_and_weights():
    rng = np.random.default_rng(0)
    x, off = rng.normal(size=(12, 5)), np.array([0, 3, 4, 9, 12])
    label = np.array([1.0, 0.0, 1.0, 0.0])
    cost = np.array([1.0, 2.0, 1.0, 0.5])
    net = attention.Network(np.zeros(5), np.ones(5), {
        "w": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "v": rng.normal(size=(4, 3)),
        "vb": rng.normal(size=3), "u": rng.normal(size=(4, 3)), "ub": rng.normal(size=3),
        "a": rng.normal(size=3), "c": rng.normal(size=4), "d": np.array([0.3])})

    def loss():
        y = net.forward(x, off)[-1]
        return -(cost * (label * np.log(y) + (1 - label) * np.log(1 - y))).sum() / cost.sum()

    grad, eps = net.gradient(x, off, label, cost), 1e-6
    for name, p in net.p.items():
        for at in np.ndindex(p.shape):
            old = p[at]
            p[at] = old + eps
            up = loss()
            p[at] = old - eps
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * eps) - grad[name][at]) < 1e-6, (name, at)
    _, weight = net.scores(x, off)
    np.testing.assert_allclose(np.add.reduceat(weight, off[:-1]), 1.0)


def test_passages_cover_whole_texts():
    texts = ["", " \n ", "one two three", "w " * 100, "x" * 100_000, "A!! " * 49]
    x, off = attention.passages(texts)
    assert np.diff(off).tolist() == [1, 1, 1, 3, 6, 2] and np.isfinite(x).all()
    alone = [attention.passages([t])[0] for t in texts]
    np.testing.assert_array_equal(x, np.concatenate(alone))        # neighbours in a batch do not matter


def test_attention_quality_on_held_out_documents(spark):
    got = queries.QUERIES["op13_quality_attention"](spark, SF).toPandas().set_index("doc_id")
    known = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").toPandas()["doc_id"]
    assert sorted(got.index) == sorted(ids) and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    assert ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()
    held = got[got["held_out"]].join(known, how="inner")
    assert (held["predicted"] == held["quality"]).mean() >= 0.95
    again = queries.QUERIES["op13_quality_attention"](spark, SF).toPandas().set_index("doc_id")
    np.testing.assert_allclose(again["score"].loc[got.index], got["score"])


def test_attention_finds_the_bad_passage(spark):
    rng = random.Random(0)
    good = [" ".join(rng.choice("the sun was warm and people walked home".split()) for _ in range(240))
            for _ in range(120)]
    docs = [(i, t if i % 2 else t[:600] + " " + "BUY!!! NOW!!! " * 24 + t[600:]) for i, t in enumerate(good)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int")
    got = attention.quality_scores(df, labels).toPandas().set_index("doc_id")
    held = got[got["held_out"]]
    assert len(held) > 10 and (held["predicted"] == held.index % 2).all()


# ------------------------------------------------------------------- odd rows
ODD = ("doc_id long, text string, lang string, source string, quality int, score double, raw string, "
       "x string, label int, pairs string, row long")


@pytest.mark.parametrize("name", ["alignment", "attention"])
def test_odd_rows_of_documents(spark, name):
    texts = [(1, "the one text of a few words"), (2, None), (3, ""), (4, "   \n\t "), (5, "ab cd " * 20_000 + "x" * 30_000),
             (None, "no identifier"), (7, "same"), (7, "same"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 0.0, "x", "x", 1, "x", 1) for i, t in texts], ODD)
    none = spark.createDataFrame([], ODD)
    labels = [spark.createDataFrame(r, "doc_id long, quality int, text string") for r in
              ([], [(1, 1, "a"), (5, 1, "b")], [(1, 0, "a"), (4, 1, "b"), (4, None, "c"), (None, 1, "d"), (7, 1, "e")])]
    if name == "alignment":
        got = alignment.align(df).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in texts)
        by = {r.doc_id: r for r in got if r.doc_id}
        assert by[2][1:] == by[3][1:] == (0, 0, 0, 0, 0, 0, "") and by[4].n_a > 0 and by[5].n_links > 30_000
        assert alignment.align(none).count() == 0
        return
    for known in labels:
        got = attention.quality_scores(df, known).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in texts)
        assert all(0 <= r.score <= 1 for r in got)
        by = defaultdict(set)
        for r in got:
            by[r.doc_id].add(r.score)
        assert len(by[7]) == 1
    assert attention.quality_scores(none, labels[0]).count() == 0
    assert {r.score for r in attention.quality_scores(df, labels[0]).collect()} == {0.5}


# ------------------------------------------------------ mended in other operators
def test_one_of_each_keeps_every_text_of_an_identifier(spark):
    a, b, c = ("the quick brown fox jumps over the lazy dog again", "entirely other words stand here in line",
               "nothing in common with either of the two")
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (9, c, 4), (9, c, 4), (5, c + " x y z", 5), (None, a, 6),
            (None, "nameless text that nobody has", 8), (None, "nameless text that nobody has", 7)]
    want = {(3, a, 1), (5, b, 3), (9, c, 4), (5, c + " x y z", 5), (None, "nameless text that nobody has", 7)}
    for part in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(part)
        got = [tuple(r) for r in simhash.one_of_each(df).collect()]
        assert len(got) == len(want) and set(got) == want


def test_mixed_rows_with_clashing_columns(spark):
    names = "doc_id long, text string, source string, _h string, _times string, _again int, h string, times int"
    rows = [(i, "w " * (5 + i), f"s{i % 2}", "h", "t", 7, "g", 1) for i in range(20)]
    got = mixing.mixed_rows(spark.createDataFrame(rows, names))
    assert got.columns == [c.split()[0] for c in names.split(", ")]
    assert {tuple(r) for r in got.collect()} <= set(rows) and got.count() >= 20


@pytest.mark.parametrize("cells", [langid.CELLS, 10])
def test_letters_of_the_raw_text_decide_und(spark, monkeypatch, cells):
    monkeypatch.setattr(langid, "CELLS", cells)
    texts = ["™", "№ 5", "℃", "Ⓐ", "½", "㎏", "ﾞ", "die katze", "the cat sat on the mat", None]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rows += [(100 + i, "der hund und die katze sind im haus", "de") for i in range(30)]
    rows += [(200 + i, "the dog and the cat are in the house", "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).where("doc_id < 100").collect()}
    assert [got[i].lang_pred == "und" for i in range(10)] == [True] * 6 + [False] * 3 + [True]
    assert all(got[i].score == 0 for i in range(6))
    kept = {r.doc_id for r in langid.known_only(df, langid.fit(df)).where("doc_id < 100").collect()}
    assert kept == {6, 7, 8}


def test_known_texts_alone_go_to_workers(spark):
    rows = [(i, "der hund und die katze sind im haus", "de") for i in range(30)]
    rows += [(100 + i, "the dog and the cat are in the house", "en") for i in range(30)] + [(7, None, "de"), (8, "½", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.expr(
        "make_interval(1)"))                       # of a type that Arrow batches do not take
    got = langid.known_only(df, langid.fit(df))
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == [*range(30), *range(100, 130)]
    assert got.where("kept is not null").count() == 60


def test_batches_of_texts_are_small(spark):
    docs = spark.range(0, 3_000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    shared.ship(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 30_000_000 and max(got) < 5_000_000


def rows_of(text, lang, n, parts, start=0):
    """Rows of one text whose identifiers have one of the remainders ``parts``."""
    ids = (i for i in range(start, 1 << 30) if zlib.crc32(str(i).encode()) % 4 in parts)
    return [(next(ids), text, lang) for _ in range(n)]


def test_few_rows_of_the_third_part_are_counted_by_the_query(spark):
    rows = rows_of("aba bab abba", "en", 40, {0, 1}) + rows_of("aba qqqzz qqqzz", "en", 10, {3})
    rows += rows_of("lolo qumu zolo lomu", "xx", 40, {0, 1}, 10_000) + rows_of("lolo mumu", "xx", 10, {3}, 10_000)
    asked = rows_of("qqqzz qqqzz qqqzz", "xx", 3, {2}, 20_000)     # held out, its label is not learned from
    got = langid.identify(spark.createDataFrame(rows + asked, "doc_id long, text string, lang string"))
    found = [r for r in got.collect() if r.doc_id in {i for i, _, _ in asked}]
    assert [(r.held_out, r.lang_pred) for r in found] == [(True, "en")] * 3


@pytest.mark.parametrize("cells", [langid.CELLS, 10])
def test_pipeline_keeps_a_language_whatever_its_remainders(spark, monkeypatch, cells):
    monkeypatch.setattr(langid, "CELLS", cells)
    rows = [(i, "the dog and the cat are in the house", "en") for i in range(60)]
    rows += [(100 + i, "der hund und die katze sind im haus", "de") for i in range(60)]
    rows += rows_of("это русский текст о погоде и природе", "ru", 5, {2}, 1_000)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.language_id(spark, df, "")
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)


def test_rows_of_hashes_by_plain_search():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 3_000):
        known = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        known = np.unique(np.concatenate([known, known[:99] + np.uint64(1)]))      # neighbours share their first bits
        model = langid.Model(["en"], known, np.zeros((len(known) + 1, 1)), np.ones((len(known) + 1, 1)), np.ones(1))
        asked = np.concatenate([known, known + np.uint64(2), np.array([0, (1 << 64) - 1], np.uint64)])
        place = {h: i for i, h in enumerate(known.tolist())}
        assert model._row(asked).tolist() == [place.get(h, len(known)) for h in asked.tolist()]
