"""Language ID and the pipeline's stages over a whole small table, against plain versions."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pairloom.llm import contamination, language, mixing, tokens
from pairloom.llm.common import Scratch, worker_path

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")


def test_language_of_rows_held_out(spark):
    rows = {r["doc_id"]: r for r in language.op9_language_id(spark, TABLES).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    assert all(rows[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= rows[k]["score"] <= 1 for k in docs)
    tested = [k for k in docs if rows[k]["held_out"] and docs[k]["lang"] is not None and rows[k]["lang_pred"] != "und"]
    assert len(tested) > 20 and np.mean([rows[k]["lang_pred"] == docs[k]["lang"] for k in tested]) >= 0.95
    assert all((rows[k]["lang_pred"] == "und") == (not any(map(str.isalpha, docs[k]["text"] or ""))) for k in docs)


def test_decoding_against_a_plain_version():
    rng = np.random.default_rng(2)
    counts = rng.random((4, 1 << language.SLOT_BITS)) ** 8
    model = language.Codes(["a", "b", "c", "d"], counts)
    p = (counts + 1e-4) / (counts + 1e-4).sum(1, keepdims=True)
    for text in ("some words of a text", "ähnlich, nur anders", "x"):
        slots, _ = language._slots([text])
        want = []
        for word, weights in zip(model.words, model.loss_weights, strict=True):
            loss = 0.0
            for bit, (code, w) in enumerate(zip(word, weights, strict=True)):
                one, zero = (np.log(p[model.words[:, bit] == s].mean(0)) for s in (1, -1))
                margin = np.mean([one[s] - zero[s] for s in slots])
                loss += w * np.exp(-code * np.clip((margin - model.middle[bit]) / model.half[bit], -3, 3))
            want.append(loss)
        assert np.allclose(model.losses([text])[0], want) and model.predict([text])[0][0] == "abcd"[int(np.argmin(want))]


def _sets(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))) if words else frozenset()


def test_stages_over_a_whole_table(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    scratch, held = Scratch(spark, "test-stages"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.save(stage(spark, docs, TABLES), name.replace(" ", "-"))
        held[name] = before.collect(), docs.collect()
    before, after = held["language"]
    assert Counter(after) == Counter(r for r in before if any(map(str.isalpha, r["text"] or "")))
    before, after = held["near copies"]
    sets, label = [_sets(r["text"]) for r in before], list(range(len(before)))
    for a in range(len(before)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    least = {g: min(r["doc_id"] for r, x in zip(before, label, strict=True) if x == g) for g in set(label)}
    assert sorted(r["doc_id"] for r in after) == sorted(least.values()) and len(after) < len(before)
    before, after = held["benchmark"]
    items = [w for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect() if len(w := contamination.plain_words(r["text"] or "")) >= 5]
    clean = [r for r in before if not any(sum(n for *_, n in contamination.tile(i, contamination.plain_words(r["text"] or ""))) >= 0.6 * len(i) for i in items)]
    assert Counter(after) == Counter(clean) and len(after) < len(before)
    before, after = held["mix"]
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    plan = mixing.mix_sources(spark.createDataFrame(before, docs_schema(spark)), labels).collect()
    assert Counter(r["doc_id"] for r in after) == Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})
    before, after = held["pack"]
    coder = tokens.TokenIds(worker_path("byte_bpe_50k.tiktoken"))
    assert sum(r["n_tokens"] for r in after) == sum(len(coder.ids(r["text"] or "")) for r in before)


def docs_schema(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet").schema
