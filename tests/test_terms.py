"""Vocabularies and tf-idf rows against counts by hand; top terms of windows against all terms."""

from collections import Counter
from datetime import date, timedelta
from math import log, sqrt

import numpy as np
import pytest

from tidemark.operators import documents as doc
from tidemark.operators import models as md
from tidemark.operators import sparse as sp
from tidemark.operators import terms as tm
from tidemark.operators.windows import Grid


def grams(text):
    w = (text or "").lower().split()
    return Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])


def expected(rows, limit):
    by_key = {}
    for k, t in rows:
        by_key[k] = by_key.get(k, Counter()) + grams(t)
    df, cf = Counter(g for c in by_key.values() for g in c), sum(by_key.values(), Counter())
    vocab = sorted((g for g in df if 2 <= df[g] <= 0.85 * len(rows)), key=lambda g: (-cf[g], g))[:limit]
    idf = {g: log((len(rows) + 1) / (df[g] + 1)) + 1 for g in vocab}
    out = {}
    for k, c in by_key.items():
        v = {g: n * idf[g] for g, n in c.items() if g in idf}
        size = sqrt(sum(x * x for x in v.values()))
        out |= {(k, g): x / size for g, x in v.items() if k is not None}
    return out, vocab


@pytest.fixture
def rows():
    r = np.random.default_rng(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    weight = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(r.choice(words, r.integers(0, 40), p=weight / weight.sum())) for _ in range(60)]
    return [*enumerate(texts), (60, None), (3, "waa wab wac"), (3, "wad"), (None, "waa wab"), (None, "wab waa")]


@pytest.mark.parametrize("buckets,limit", [(1 << 20, 20_000), (1 << 20, 30), (64, 30), (7, 3)])
def test_tfidf_rows_for_any_number_of_buckets(spark, rows, monkeypatch, buckets, limit):
    pack = tm.packed_words
    monkeypatch.setattr(tm, "STEP", 200)
    want, terms = expected(rows, limit)
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    packed = pack(df, ["id"], "t")
    assert packed.count() == 62 and packed.filter("id = 3").first()["_c"] == 3
    if buckets == tm.BUCKETS:
        got = md.tfidf_rows(df, "id", "t", limit)
        assert {(v["id"], v["term"]): v["tfidf"] for v in got.collect()} == pytest.approx(want)
    # fewer buckets than workers know of: the sums of many terms fall together
    folded = tm.bucket_sums
    monkeypatch.setattr(tm, "bucket_sums", lambda *a: np.tile(folded(*a).reshape(1, -1, buckets).sum(axis=1), tm.BUCKETS // buckets) if tm.BUCKETS % buckets == 0 else np.full((1, tm.BUCKETS), 1e6))
    vocab = tm.vocabulary(packed, None, [len(rows)], limit, 2.0, 0.85)
    assert sorted(r["term"] for r in vocab) == sorted(terms)


def test_matrix_has_every_row(spark, rows):
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    got, terms = md.tfidf_matrix(df, "id", "t", 30)
    want, found = expected(rows, 30)[0], got.collect()
    assert len(found) == len(rows) and terms == sorted(terms)
    assert sum(r["id"] == 3 for r in found) == 3
    for r in found:
        assert {(r["id"], terms[i]): v for i, v in zip(r["idx"], r["val"])} == pytest.approx({k: v for k, v in want.items() if k[0] == r["id"] is not None})


def test_correlated_columns_take_few_steps(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 6))
    dense = 4 * base @ r.normal(size=(6, 30)) + r.normal(size=(60, 30))
    text = np.where(r.random((60, 50)) < 0.1, 0.3, 0.0)
    a, y = np.hstack([text, dense]), r.normal(size=60)
    rows = [(0, [int(j) for j in np.flatnonzero(v)], [float(u) for u in v[v != 0]], float(t)) for v, t in zip(a, y)]
    df = spark.createDataFrame(rows, "fold int, idx array<int>, val array<double>, y double").repartition(3)
    is_text = np.arange(80) < 50
    masks = np.column_stack([~is_text, is_text, np.ones(80, bool)]).astype(float)
    m, plain = (sp.SparseRidge(1.0).fit(df, "y", [0], 80, masks, dense=d) for d in (50, None))
    assert m.residual.max() <= 1e-9 and 2 * m.steps < plain.steps, (m.steps, plain.steps)
    assert np.allclose(m.coef, plain.coef, atol=1e-7) and np.allclose(m.intercept, plain.intercept, atol=1e-7)


@pytest.mark.parametrize("top_n", [3, 100])
def test_novelty_counts_every_term(spark, monkeypatch, top_n):
    r = np.random.default_rng(6)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    day = date(2000, 1, 1)
    docs = [(["A", "B", None][int(r.integers(3))], None if k % 50 == 0 else day + timedelta(days=int(r.integers(0, 500))), "", " ".join(r.choice(words, 6))) for k in range(400)]
    grid = Grid.of("2000-11-06", "2001-05-07", 28)
    got = {(v["symbol"], v["as_of"]): (v["n_recent"], v["n_new"]) for v in doc.vocab_novelty(spark.createDataFrame(docs, "symbol string, published date, title string, text string").repartition(3), grid, top_n).collect()}
    back = lambda d, m: date(d.year - (m > d.month - 1) * (1 + (m - d.month) // 12), (d.month - m - 1) % 12 + 1, min(d.day, 28))
    want = {}
    for s in ("A", "B", None):
        for k in range((date(2001, 5, 7) - date(2000, 11, 6)).days // 28 + 1):
            at = date(2000, 11, 6) + timedelta(days=28 * k)
            tops = []
            for lo, hi in ((back(at, 2), at), (back(at, 12), back(at, 2))):
                c = Counter(w for x, p, _, t in docs if x == s and p and lo <= p < hi for w in t.split())
                tops.append(set(sorted(c, key=lambda w: (-c[w], w))[:top_n]))
            if at.day <= 28 and all(tops):
                want[s, at] = (len(tops[0]), len(tops[0] - tops[1]))
    assert want and {k: v for k, v in got.items() if k[1].day <= 28} == want


def test_rows_and_matrix_exchange_nothing(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] != 3], "id long, t string").repartition(3)
    for made in (md.tfidf_rows(df, "id", "t", 30), md.tfidf_matrix(df, "id", "t", 30)[0]):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
