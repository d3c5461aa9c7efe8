"""Each operator against a plain per-text version on small tables."""

import base64
import hashlib
import os
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

import compare
from panelyard.llm import (bpe, chat, fingerprint, langid, mixing, passages, pii, queries, simhash,
                           token_counts)

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def by_id(df):
    return df.toPandas().set_index("doc_id")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_statement(spark, name):
    duck = compare.connect(SF)
    assert compare.differences(queries.QUERIES[name](spark, SF), duck, queries.ORACLE[name]) == []


def test_simhash_components(spark, rows):
    def bits(text):
        w = text.encode().lower().split()
        if not w:
            return 0
        s = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids = rows["doc_id"].to_numpy()
    prints = np.array([bits(t or "") for t in rows["text"]], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    label = ids.copy()
    while True:
        new = np.where(near, label[None], 1 << 60).min(axis=1)
        if (new == label).all():
            break
        label = new
    got = by_id(queries.QUERIES["op1_simhash"](spark, SF))
    for i, p, c in zip(ids, prints, label):
        assert (got.loc[i].fingerprint, got.loc[i].component_id) == (f"{p:016x}", c)


def test_simhash_hot_key_in_chunks(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    values = {base}
    while len(values) < 300:  # a chain of close fingerprints, and some far ones
        near = list(values)[int(rng.integers(len(values)))]
        values.add(near ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))))
    values |= {int(v) for v in rng.integers(0, 1 << 62, 50)}
    v = np.array(sorted(values), dtype=np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None]) <= 3
    label = np.arange(len(v))
    while True:
        new = np.where(near, label[None], len(v)).min(axis=1)
        if (new == label).all():
            break
        label = new
    nodes = spark.createDataFrame([(int(x),) for x in v], "fp long")
    found = simhash.connected(simhash.links(nodes, chunk=16)).toPandas()
    root = dict(zip(found["node"], found["root"]))
    assert [root.get(int(x), int(x)) for x in v] == [int(v[i]) for i in label]


def reference_encoding():
    import tiktoken
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_bpe_equals_library_and_round_trips(spark, rows):
    library = reference_encoding()
    odd = ["", " ", "  a", "a  ", "\n\n x\t\ty", "don't we'll 'S", "a" * 3000, "ab" * 700, " " * 50,
           "x\x1cy \x1d z", "　 a\u0085b", "é" * 400, "<|endoftext|>", "1234 567٤",
           "".join(chr(c) for c in range(1, 0x2500)), "\U0001f600" * 90, "á ́b",
           "".join(chr(c) + " " for c in range(0x2000, 0x3100))]
    docs = spark.createDataFrame(list(enumerate(odd + rows["text"].tolist()[:200])),
                                 "doc_id long, text string")
    got = by_id(bpe.encode(docs, outputs=tuple(bpe.OUTPUTS)))
    for i, text in enumerate(odd + rows["text"].tolist()[:200]):
        ids = library.encode_ordinary(text)
        assert list(got.loc[i].token_ids) == ids, text[:60]
        assert bytes(got.loc[i].decoded) == text.encode()
        assert got.loc[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bpe_rounds_and_heap_agree():
    v = bpe.vocabulary(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b"etaoin shrdlu.-#"), size=int(n)).astype(np.uint8))
             for n in rng.integers(2, 120, 300)]
    for w, ids in zip(words, v.merge_rounds(words)):
        assert ids.tolist() == v.merge_heap(w).tolist()


def test_token_counts_equal_library(spark, rows):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    texts = ["", "  ", "<|endoftext|> a<|startoftext|>", "ΑΣ Σ", "İ ß", "á ́", "x y\tz",
             *rows["text"].tolist()[:300]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(token_counts.token_counts(docs))
    for i, t in enumerate(texts):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got.loc[i].n_tokens, got.loc[i].n_bytes) == (n, len(t.encode()))
        assert got.loc[i].over_limit == (n > token_counts.LIMIT)


def test_language_of_held_out_texts(spark, rows):
    got = by_id(queries.QUERIES["op3_language_id"](spark, SF))
    for i in rows["doc_id"]:
        assert got.loc[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = rows.set_index("doc_id").join(got[["held_out", "lang_pred", "score", "rejected"]])
    held = held[held["held_out"].astype(bool)]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert held["score"].between(0, 1).all()


def kneser_ney(words):
    """Nats per word by the definitions, over dictionaries."""
    top = langid.ORDER
    counts = {k: {} for k in range(1, top + 1)}
    for w in (f" {w} " for w in words):
        for i in range(1, len(w)):
            for k in range(1, min(i + 1, top) + 1):
                g = w[i - k + 1:i + 1]
                counts[k][g] = counts[k].get(g, 0) + 1
    c = {k: dict(counts[k]) for k in counts}
    for k in range(1, top):
        for g in c[k]:
            if not (k > 1 and g[0] == " "):
                c[k][g] = max(sum(x[1:] == g for x in counts[k + 1]), 1)
    d = {}
    for k in c:
        n1, n2 = (sum(v == n for v in c[k].values()) for n in (1, 2))
        d[k] = min(max(n1 / (n1 + 2 * n2) if n1 + n2 else 0.5, 0.1), 0.95)

    def p(g):
        k, context = len(g), g[:-1]
        low = 1 / langid.ALPHABET if k == 1 else p(g[1:])
        same = {x: v for x, v in c[k].items() if x[:-1] == context}
        if not same:
            return low
        total = sum(same.values())
        return max(same.get(g, 0) - d[k], 0) / total + d[k] * len(same) / total * low

    return lambda w: sum(-np.log(p(f" {w} "[max(0, i - top + 1):i + 1])) for i in range(1, len(w) + 2))


def test_kneser_ney_by_definition(spark):
    texts = ["abab abba baba acb", "aab bba abc bca cab", "cab cab abcab", "b ba cc abbbc", "caab"]
    docs = [(i, texts[i % 5], "en") for i in range(40)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    learned = [w for i, t, _ in docs if zlib.crc32(str(i).encode()) % 4 < 2 for w in t.split()]
    nats = kneser_ney(learned)
    words = ["abab", "cab", "abbbc", "xaby", "c", "zz", "abcabcab"]
    got = model.words(words)
    assert got[:, 0].tolist() == [len(w) + 1 for w in words]
    assert np.allclose(got[:, 1], [nats(w) for w in words], rtol=1e-4)


def remainder(i):
    return zlib.crc32(str(i).encode()) % 4


def test_foreign_and_random_texts_are_rejected(spark, rows):
    rng = np.random.default_rng(3)

    def letters(n):
        return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 10))))
                        for _ in range(n))

    docs = [(int(i), t, x) for i, t, x in zip(rows["doc_id"], rows["text"], rows["lang"])]
    spare = iter(i for i in range(1 << 30, 1 << 31) if remainder(i) == 3)
    docs += [(next(spare), letters(60), x) for x in ("de", "en", "es", "fr")]  # garbled, labelled
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    strange = [letters(int(n)) for n in rng.integers(6, 80, 40)] + [
        "ja se jmenuji jan a bydlím v praze, kde pracuji jako učitel a rád čtu knihy",
        "minä olen suomalainen ja asun helsingissä jossa työskentelen opettajana",
        "это русский текст о погоде и природе в москве зимой",
        "ben türkiyede yaşıyorum ve istanbulda öğretmen olarak çalışıyorum"]
    short = [(t[:n].rsplit(" ", 1)[0], x) for t, x, i in zip(rows["text"], rows["lang"], rows["doc_id"])
             for n in (40, 80) if remainder(i) == 2 and re.fullmatch(r"[^\W\d_][\w\s.,]{80,}", t[:90] or "")
             and not re.search(r"\d|license|token", t[:90])]
    assert {x for _, x in short} == {"de", "en", "es", "fr"}
    texts = strange + [t for t, _ in short]
    got = by_id(langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
                               model))["rejected"]
    assert all(got.loc[i] for i in range(len(strange)))
    assert not any(got.loc[i] for i in range(len(strange), len(texts)))


def test_rows_beyond_the_calibration_sample_are_counted(spark, monkeypatch):
    third = [i for i in range(4_000) if remainder(i) == 3]
    first = [i for i in range(4_000) if remainder(i) < 2]
    docs = [(i, "aba bab abba", "en") for i in first[:200]]
    docs += [(i, "aba bab qqqzz", "en") for i in third[:500]]
    docs += [(i, "lolo mumu lomu", "xx") for i in third[500:503]]
    monkeypatch.setattr(langid, "CALIBRATED", 50)
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "xx"]
    nats = model.words(["qqqzz", "lolo"])[:, 1:]
    assert nats[0, 0] < nats[0, 1] and nats[1, 1] < nats[1, 0]
    assert nats[0, 0] < 10


def test_all_rows_of_the_third_part_calibrate(spark, monkeypatch):
    rng = np.random.default_rng(5)

    def text(letters):
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(int(rng.integers(6, 30))))

    docs = [(i, text("abcde"), "en") if i % 3 else (i, text("lmnop"), "xx") for i in range(2_000)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    scored = []
    monkeypatch.setattr(langid, "_calibrate", lambda m, d, keep=langid._calibrate: (
        scored.append(d.count()), keep(m, d)))
    models = []
    for most in (20_000, 50):
        monkeypatch.setattr(langid, "CALIBRATED", most)
        models.append(langid.fit(table))
    third = sum(remainder(i) == 3 for i, _, _ in docs)
    assert scored == [third, third]
    assert models[0].temperature == models[1].temperature
    assert (models[0].thresholds == models[1].thresholds).all() and np.isfinite(models[0].thresholds).all()


def test_large_models_are_whole(spark, rows, monkeypatch):
    df = spark.createDataFrame([(int(i), t, x) for i, t, x in zip(
        rows["doc_id"][:300], rows["text"], rows["lang"])] + [(7, "same id", "en"), (7, "same id", "en"),
                                                              (None, None, None)],
        "doc_id long, text string, lang string")
    order = ["doc_id", "lang_pred", "score", "rejected"]
    small = langid.identify(df).toPandas().sort_values(order).reset_index(drop=True)
    kept = sorted(map(str, langid.known_only(df, langid.fit(df)).collect()))
    monkeypatch.setattr(langid, "CELLS", 2_000)
    large = langid.identify(df).toPandas().sort_values(order).reset_index(drop=True)
    assert len(large) == len(small) == 303
    for c in ("lang_pred", "rejected", "held_out"):
        assert (large[c] == small[c]).all()
    for c in ("score", "cross_entropy"):
        assert np.allclose(large[c], small[c], rtol=1e-6)
    assert sorted(map(str, langid.known_only(df, langid.fit(df)).collect())) == kept


def test_prefix_fingerprints(spark, rows):
    got = by_id(queries.QUERIES["op4_prefix_fingerprints"](spark, SF))
    docs = rows.sort_values("doc_id", ascending=False).reset_index(drop=True)
    texts = [t or "" for t in docs["text"]]
    for i, (doc_id, a) in enumerate(zip(docs["doc_id"], texts)):
        b = texts[(i + 1) % len(texts)]
        half = len(a) // 2
        edited = a[:len(a) - half] + b[:half]
        r = got.loc[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert r.same_start == len(os.path.commonprefix([a, edited]))
        if i < 60:
            assert r.edited_fingerprint == fingerprint.Document(edited.encode()).fingerprint()
            assert r.near_edited == fingerprint.likeness(
                fingerprint.sketch_of(r.fingerprint), fingerprint.sketch_of(r.edited_fingerprint))
    assert got["near_edited"].mean() > 0.25 > 10 * got["near_next"].mean()
    same = docs.groupby("text")["doc_id"].apply(list)
    for ids in same[same.str.len() > 1]:
        assert len(set(got.loc[ids].fingerprint)) == 1


def test_spans_and_extensions_by_hash():
    rng = np.random.default_rng(2)
    a, b = ("".join(rng.choice(list("abé"), n)) for n in (300, 200))
    x, y = fingerprint.PrefixHash(a), fingerprint.PrefixHash(b)
    for i, j in rng.integers(0, 190, (200, 2)):
        i, j = int(i), int(j)
        n = len(os.path.commonprefix([a[i:], b[j:]]))
        assert fingerprint.common_extension(x, i, y, j) == n
        assert (x.span(i, 5) == y.span(j, 5)) == (a[i:i + 5] == b[j:j + 5])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(m):
    d = [int(c) for c in m if c.isdigit()]
    return 16 <= len(d) <= 19 and sum(
        y if i % 2 == 0 else (2 * y - 9 if y > 4 else 2 * y) for i, y in enumerate(reversed(d))) % 10 == 0


CHECKS = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
          "card": luhn, "phone": lambda m: 8 <= sum(c.isdigit() for c in m) <= 15}


def test_base_spans(spark, rows):
    odd = ["a@b.c_d@e.f", "x@y", "a@b.c@d.e", "é a.b@c-d.e é 1.2.3.4.5.6.7.8", "1.2.3.256 0001.02.3.0255",
           "+1 (743) 555-3824.", "+1", "4111 1111 1111 1111", "4111-1111-1111-11112", "a" * 20_000,
           "1" * 20_000, "1.1" * 5_000, "a@" + "b." * 5_000 + "c", "+" + "1 " * 9_000, "@" * 9_000, ""]
    texts = odd + [t or "" for t in rows["text"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.digests(pii.find(docs)))
    for i, text in enumerate(texts):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items()
                 for m in re.finditer(p, text) if CHECKS[k](m[0])]
        assert got.loc[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), text[:50]
        assert got.loc[i].spans.split(",")[:len(spans)] == (spans or got.loc[i].spans.split(",")[:0])
        if i >= len(odd) and 'token = "' in text:
            assert "secret" in got.loc[i].spans


def test_masking(spark):
    docs = spark.createDataFrame([(1, "mail é@x.y a.b@c.de, ip 1.2.3.4", "en"), (2, None, "en")],
                                 "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.masked_rows(docs).collect()}
    assert got[1].text == "mail é@x.y [EMAIL], ip [IP]" and got[2].text is None
    assert got[1].spans == "en"


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(3)
    names = list(pii.LABELERS)
    right = dict(zip(names, (0.95, 0.9, 0.85, 0.55)))
    patterns = {}
    for truth in rng.integers(0, 2, 4000):
        votes = tuple(int(truth) if rng.random() < right[n] else 1 - int(truth) for n in names)
        patterns[votes] = patterns.get(votes, 0) + 1
    model = pii.estimate([(dict(zip(names, v)), n) for v, n in patterns.items()])
    got = [model.rates[n][1][1] for n in names]
    assert got[0] > got[3] and abs(got[0] - 0.95) < 0.05 and abs(model.prior - 0.5) < 0.05


def test_chat_round_trip_with_parts(spark):
    text = "<|im_end|> <\\|x <\\\\| < | \\ <"
    part = "struct<type:string,text:string,ref:string,units:bigint>"
    rows = [(1, 0, "user", [("text", text, None, None), ("image", None, "a.png", 7840),
                            ("text", "b", None, None)]),
            (1, 1, "assistant", [("text", "ok <|im_start|>", None, None), ("audio", None, "c", 1),
                                 None, ("odd", None, None, None)]),
            (1, 2, "a\n<|b", None), (2, 0, "assistant", [(None, None, None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{part}>")
    out = chat.format_conversations(df, parts_col="parts")
    got = {r.conv_id: r for r in out.collect()}
    assert [(a.turn, a.type, a.ref, a.tokens) for a in got[1].attachments] == [
        (0, "image", "a.png", 10), (1, "audio", "c", 1), (1, "odd", None, 1)]
    assert got[1].n_tokens_attached == 12
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert [t.role for t in back[1].turns] == ["user", "assistant", "a\n<|b"]
    assert back[1].turns[0].text == text + "<|image|>b"
    assert list(back[1].learned) == ["ok <|im_start|><|audio|><|attachment|>"]
    assert list(back[2].learned) == [""]


def test_mix_schedule_is_spread_and_complete(spark, rows):
    docs = mixing.sized(spark.createDataFrame(rows), "doc_id", "text", "source")
    targets = mixing.materialise(mixing.source_targets(docs))
    slots = mixing.schedule(targets, 64).toPandas()
    want = {r.source: r.words for r in targets.collect()}
    for source, part in slots.groupby("source"):
        assert part["words"].sum() == want[source]
        assert sorted(part["rank"]) == list(range(len(part)))
        assert part.sort_values("slot")["rank"].is_monotonic_increasing
    first = slots.sort_values("slot").head(len(slots) // 2)["source"].value_counts()
    for source, n in slots["source"].value_counts().items():  # half of each in the first half
        assert abs(first.get(source, 0) - n / 2) <= 8


def test_passages_by_every_run_of_fifty_words(spark, rows):
    owners = {}
    words = {i: (t or "").encode().lower().split() for i, t in zip(rows["doc_id"], rows["text"])}
    for i, w in words.items():
        for j in range(len(w) - 49):
            owners.setdefault(tuple(w[j:j + 50]), set()).add(i)
    got = by_id(queries.QUERIES["op7_repeated_passages"](spark, SF))
    joined = set()
    for ids in owners.values():
        if len(ids) > 1:
            assert len({got.loc[i].class_id for i in ids}) == 1
            joined |= ids
    five = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, w in words.items()}
    for i in got.index[(got["n_links"] > 0)]:  # none without much in common
        if i not in joined:
            assert max(len(five[i] & five[j]) for j in five if j != i) >= 41


def test_shuffled_matches_are_compared_without_error():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a = rng.integers(0, 1 << 40, 120).astype(np.uint64)
        parts = np.array_split(a, int(rng.integers(2, 6)))
        far = rng.integers(0, 1 << 40, 500).astype(np.uint64)
        b = np.concatenate([x for i in rng.permutation(len(parts)) for x in (parts[i], far)])
        for s, e, bs, be in passages.passages(a, b):
            assert e - s >= 50 and be > bs
    text = rng.integers(0, 1 << 40, 300).astype(np.uint64)
    assert passages.passages(text, text) == [(0, 304, 0, 304)]


def test_exact_passages_whose_shingles_also_occur_just_before():
    rng = np.random.default_rng(9)
    for at in range(0, 56, 5):
        for gap in (15, 30, 45):
            run = rng.integers(0, 1 << 40, 56).astype(np.uint64)
            a, b, rest = (rng.integers(0, 1 << 40, n).astype(np.uint64) for n in (90, gap, 90))
            early = np.concatenate([run[at:at + 1], b])
            got = passages.passages(np.concatenate([a, run, a[::-1] + np.uint64(1)]),
                                    np.concatenate([early, run, rest]))
            assert got == [(90, 150, len(early), len(early) + 60)]
    two = np.concatenate([run, a[:56]])  # neighbours in one text, apart and turned in the other
    assert sorted(x[:2] for x in passages.passages(two, np.concatenate([a[:56], rest, run]))) == [
        (0, 60), (56, 116)]


def test_passages_around_a_phrase_many_texts_hold_alone(spark):
    rng = np.random.default_rng(10)

    def words(n):
        return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]

    def at_phrase(core, salt):  # the smallest shingle lies within the phrase
        h = passages._mixed(passages._runs(passages.word_hashes(" ".join(core).encode()), 5), salt)
        return 22 <= int(h.argmin()) < 38

    found = 0
    phrase = words(36)
    texts, pairs = [], []
    while found < 12:
        core = words(12) + phrase + words(12)
        if all(at_phrase(core, salt) for salt in range(1, passages.HASHES + 1)):
            pairs.append((len(texts), len(texts) + 1))
            texts += [words(60) + core + words(60) for _ in range(2)]
            found += 1
        elif not found:
            phrase = words(36)
    texts += [words(60) + phrase + words(60) for _ in range(60)]
    order = rng.permutation(len(texts))
    df = spark.createDataFrame([(int(i), " ".join(texts[i])) for i in order], "doc_id long, text string")
    got = by_id(passages.repeated_passages(df))
    for a, b in pairs:
        assert got.loc[a].class_id == got.loc[b].class_id == a
        assert any(s.start <= 60 and s.end >= 120 for s in got.loc[b].spans)
    assert all(got.loc[i].class_id == i for i in range(24, len(texts)))


def edited(rng, words, least):
    """Near copy by substitutions, insertions and deletions, as far as ``least`` allows."""
    def runs(w):
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    now = list(words)
    for _ in range(60):
        new, i = list(now), int(rng.integers(1, len(now) - 1))
        kind = rng.integers(0, 3)
        new[i:i + int(kind < 2)] = [f"x{rng.integers(1 << 40)}"] * int(kind > 0)
        one, two = runs(words), runs(new)
        if len(one & two) < least * len(one | two) or len(new) < 50:
            break
        now = new
    return now


def test_near_copies_of_edited_passages_are_found():
    rng = np.random.default_rng(12)

    def words(n):
        return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]

    def files(raw):
        w = passages.windows_of([raw])
        return {(side, k, x) for side in ("before", "after") for k, x in zip(w["key"], w[side]) if x}

    for size in (51, 60, 100, 200):
        met = kept = 0
        for i in range(1000):
            core, least = words(size), (0.8, 0.8, 0.9, 1.0)[i % 4]
            pair = [" ".join(words(60) + x + words(60)).encode()
                    for x in (core, edited(rng, core, least))]
            together = bool(files(pair[0]) & files(pair[1]))
            runs = [passages._runs(passages.word_hashes(x), 5) for x in pair]
            met += together
            kept += together and bool(passages.passages(*runs))
        print("words", size, "candidates", met / 1000, "found", kept / 1000)
        assert met >= 998 and kept >= 995


def test_compact_windows_cover_every_long_stretch():
    rng = np.random.default_rng(4)
    for top in (5, 1 << 40):
        h = rng.integers(0, top, 120).astype(np.uint64)
        found = passages.compact_windows(h, 30)
        for i in range(0, 90, 7):
            for j in range(i + 29, 120, 5):
                low = h[i:j + 1].min()
                assert any(l <= i and j <= r and h[c] == low for l, c, r in found)


def test_near_pairs_of_chunks_by_plain_counts_in_small_parts(monkeypatch):
    """Places of two chunks (and of one with itself) against a loop over all pairs; parts stay small."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(passages, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(passages, "COLUMNS", 64)
    base = rng.integers(0, 1 << 32, 400, dtype=np.uint64).astype(np.uint32)
    rows = []
    for n in range(60):
        sh = np.where(rng.random(185) < 0.15 * (n % 4), rng.integers(0, 1 << 32, 185, dtype=np.uint64),
                      base[(n % 3) * 100:][:185]).astype(np.uint32)
        rows.append((n % 2, n // 2 * 7 + n % 5, 3 * n, n + 40, 92 + n, n % 6, 92, sh.tobytes()))
    df = pd.DataFrame(rows, columns=["x", "t", "l", "r", "c", "g", "at", "sh"])

    def plain(one, two):
        out = set()
        for p in one.itertuples():
            for q in two.itertuples():
                a = np.frombuffer(p.sh, np.uint32)[p.at - passages.LEAST + 1:p.at + passages.LEAST]
                b = set(np.frombuffer(q.sh, np.uint32)[:q.at + 2 * passages.LEAST + 1].tolist())
                if sum(v in b for v in a.tolist()) >= passages.NEAR and p.t != q.t and p.g != q.g:
                    s, e = (p, q) if p.t < q.t else (q, p)
                    out.add((s.t, e.t, s.l, s.r, s.c, e.c - s.c))
        return out

    for i, j in ((0, 1), (0, 0)):
        here = df[df["x"].isin([i, j])]
        parts = list(passages._near_pairs((1, i, j), iter([here.iloc[:20], here.iloc[20:]])))
        got = [tuple(r) for part in parts for r in part.itertuples(index=False)]
        assert set(got) == plain(here[here["x"] == i], here[here["x"] == j]) and len(got) == len(set(got)) > 20
        assert max(map(len, parts)) <= 7


def test_near_pairs_of_files_that_go_on_in_the_next_frame(monkeypatch):
    """Rows in frames of any size give the pairs of each whole file, alone and together."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(passages, "PAIRS_AT_ONCE", 200)
    base = rng.integers(0, 1 << 32, 400, dtype=np.uint64).astype(np.uint32)
    rows = [(n // 9 - 3, 0, 0, 0, n, n, n + 40, 92 + n, n % 4, 92, base[n % 3 * 100:][:185].tobytes()) for n in range(90)]
    df = pd.DataFrame(rows, columns=["file", "i", "j", "x", "t", "l", "r", "c", "g", "at", "sh"])
    want = {r for key, part in df.groupby(["file", "i", "j"]) for pairs in passages._near_pairs(key, iter([part]))
            for r in pairs.itertuples(index=False, name=None)}
    assert len(want) > 60
    for size in (1, 7, 9, 90):
        parts = list(passages._near_frames(df.iloc[n:n + size] for n in [*range(0, 90, size), 90]))
        got = [r for part in parts for r in part.itertuples(index=False, name=None)]
        assert len(got) == len(want) and set(got) == want
        assert size == 1 or len(parts) < 10


def test_compared_offsets_are_the_commonest_of_each_cluster():
    rng = np.random.default_rng(7)
    for size in (46, 80, 300):
        for _ in range(50):
            steps = np.sort(rng.integers(-120, 120, int(rng.integers(1, 40))) // int(rng.integers(1, 9)))
            clusters = []
            for x in np.unique(steps).tolist():
                if clusters and x - clusters[-1][-1] <= max(size // 4 // 4, 1):
                    clusters[-1].append(x)
                else:
                    clusters.append([x])
            often = {x: int((steps == x).sum()) for x in steps.tolist()}
            clusters.sort(key=lambda c: -sum(often[x] for x in c))
            want = [(max(c, key=lambda x: (often[x], -x)), size // 4) for c in clusters]
            assert list(passages._diagonals(steps, size)) == want


def test_texts_are_hashed_once_for_all_rounds(spark, rows, monkeypatch):
    calls = []
    monkeypatch.setattr(passages, "shingled", lambda *a, keep=passages.shingled: calls.append(1) or keep(*a))
    passages.repeated_passages(spark.createDataFrame(rows[["doc_id", "text"]].head(200)))
    assert len(calls) == 1
