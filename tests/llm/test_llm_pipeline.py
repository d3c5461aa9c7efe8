"""The pipeline's stages, each against the whole of its own input."""

import os
import re

import corpus_pipeline
from panelyard.llm import simhash

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {"documents": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        kept[name] = docs.toPandas()
    first, known = kept["documents"], kept["language_id"]
    letters = first["text"].fillna("").str.contains(r"[^\W\d_]")
    assert set(known["doc_id"]) == set(first["doc_id"][letters])
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in zip(known["doc_id"], known["text"])}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (prints[ids[x]] ^ prints[ids[y]]).bit_count() <= 3:
                a, b = sorted((find(ids[x]), find(ids[y])))
                root[b] = a
    one = kept["near_duplicates"]
    assert sorted(one["doc_id"]) == sorted({find(i) for i in ids})
    clean = kept["private_data"].set_index("doc_id")["text"]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for i, text in one.set_index("doc_id")["text"].items():
        assert not email.search(clean[i])
        if not re.search(r"[0-9]", text):
            assert clean[i] == text
    mixed = kept["source_mix"]
    assert mixed["doc_id"].value_counts().max() <= 2
    sizes = one.assign(n=clean[one["doc_id"]].str.split().str.len().values)
    total = mixed["text"].str.split().str.len().sum()
    assert abs(total - 1.5 * sizes["n"].sum()) < 0.05 * total
    last = kept["byte_bpe"]
    assert (last["n_tokens"] == last["token_ids"].map(len)).all() and len(last) == len(mixed)
