"""Language identification of a whole small table against cosines computed letter by letter."""

import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language


def grams(text):
    symbols, run = [], False
    for ch in (text or "").lower():
        letter = unicodedata.category(ch)[0] == "L"
        if letter or not run:
            symbols.append(ch if letter else " ")
        run = not letter
    padded = [" ", *symbols, " "]
    return Counter(tuple(padded[k - 1:k + 2]) for k in range(1, len(padded) - 1) if padded[k] != " ")


def brute_bundle(text, width, seed):
    encoder = language.Encoder(width, seed)
    vector = {}
    out = np.zeros(width)
    for g, n in grams(text).items():
        for ch in g:
            if ch not in vector:
                vector[ch] = encoder.draw(ord(ch)).astype(np.int64)
        out += n * np.roll(vector[g[0]], 2) * np.roll(vector[g[1]], 1) * vector[g[2]]
    return out


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["id"]: r for r in language.identify(docs, model).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[::4]:
        v = brute_bundle(texts[i], model.width, model.seed)
        norm = np.linalg.norm(v)
        cos = model.prototypes @ v / norm if norm else np.zeros(len(model.names))
        assert got[i]["lang_pred"] == (model.names[int(cos.argmax())] if norm else "und")
        assert abs(got[i]["score"] - (min(1, max(0, cos.max())) if norm else 0)) < 1e-5


def test_small_limits_change_nothing(monkeypatch):
    alphabets = ["abcdefgh", "".join(chr(0x4E00 + i) for i in range(400)), "".join(chr(0x400 + i) for i in range(60))]
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list(a + " .1"), n)) for a in alphabets for n in (0, 1, 7, 900)] + ["x" * 500, "." * 90, "a" + "." * 300 + "b", None]
    want = [brute_bundle(t, 64, 5) for t in texts]
    for limits in ({}, {"SLICE": 7}, {"SLICE": 100, "BLOCK": 16}):
        for name, value in limits.items():
            monkeypatch.setattr(language, name, value)
        if "BLOCK" in limits:
            monkeypatch.setattr(language.Encoder, "GRAMS", 40)
            monkeypatch.setattr(language.Encoder, "LETTERS", 300)
        e = language.Encoder(64, 5)
        for _ in range(2):
            assert (e.bundles(texts) == want).all()
