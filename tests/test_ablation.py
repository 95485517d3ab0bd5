"""Ridge by conjugate gradients, and the ablation, against plain dense fits."""

from collections import Counter

import numpy as np
import pytest

from tidemark.operators import models as md
from tidemark.operators import sparse as sp

N, FOLDS, GAP, ALPHA = 72, 5, 1, 10.0


def dense_ridge(x, y, tx, alpha):
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ (y - y.mean()))
    return (tx - x.mean(0)) @ w + y.mean()


def tfidf(texts, test, limit):
    grams = lambda t: [*t.split(), *(f"{a} {b}" for a, b in zip(t.split(), t.split()[1:]))]
    train = [Counter(grams(t)) for t in texts]
    df, cf = Counter(g for c in train for g in c), sum(train, Counter())
    vocab = sorted(sorted((g for g in df if 2 <= df[g] <= 0.85 * len(texts)), key=lambda g: (-cf[g], g))[:limit])
    idf = np.array([np.log((len(texts) + 1) / (df[g] + 1)) + 1 for g in vocab])
    rows = np.array([[c[g] for g in vocab] for c in [*train, *(Counter(grams(t)) for t in test)]]).reshape(len(texts) + len(test), len(vocab)) * idf
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = rows / np.where(size == 0, 1, size)
    return rows[:len(texts)], rows[len(texts):]


def scaled(x, tx):
    med = np.nanmedian(x, axis=0)
    x, tx = np.where(np.isnan(x), med, x), np.where(np.isnan(tx), med, tx)
    s = x.std(0)
    live = s > 1e-9
    return (x - x.mean(0)) / np.where(live, s, 1) * live, (tx - x.mean(0)) / np.where(live, s, 1) * live


@pytest.mark.parametrize("limit", [20_000, 25])
def test_ablation_equals_dense_fits(spark, limit):
    r = np.random.default_rng(8)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(5)]
    texts = [" ".join(r.choice(words, r.integers(0, 25))) for _ in range(N)]
    x = np.column_stack([r.normal(size=N), r.normal(100, 5, N), np.full(N, 3.0)])
    x[r.random(N) < 0.2, 0] = np.nan
    y = x[:, 1] * 0.1 + np.array([t.count(words[0]) for t in texts]) + r.normal(size=N)
    df = spark.createDataFrame([(i, float(y[i]), texts[i] or None, *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(N)],
                               "id int, target double, t string, a double, b double, flat double").repartition(4)
    got = {v["features"]: v for v in md.ablation(df, ["id"], ["a", "b", "flat"], "t", FOLDS, GAP, ALPHA, limit).collect()}
    size, pairs = N // (FOLDS + 1), {"numeric": [], "text": [], "both": []}
    for f in range(FOLDS):
        a, b = slice(0, size * (f + 1)), slice(size * (f + 1) + GAP, min(size * (f + 2) + GAP, N))
        (xa, xb), (ta, tb) = scaled(x[a], x[b]), tfidf(texts[a], texts[b], limit)
        for name, p, q in (("numeric", xa, xb), ("text", ta, tb), ("both", np.hstack([xa, ta]), np.hstack([xb, tb]))):
            pairs[name].append((y[b], dense_ridge(p, y[a], q, ALPHA)))
    for name, parts in pairs.items():
        t, p = (np.concatenate(v) for v in zip(*parts))
        assert got[name]["n"] == len(t)
        assert got[name]["rmse"] == pytest.approx(np.sqrt(((t - p) ** 2).mean()), rel=1e-8)
        assert got[name]["mae"] == pytest.approx(np.abs(t - p).mean(), rel=1e-8)


def test_residual_and_missing_fold(spark):
    r = np.random.default_rng(3)
    a = np.where(r.random((40, 12)) < 0.4, r.normal(size=(40, 12)), 0.0)
    y = r.normal(size=40) + 5
    fold = np.arange(40) % 2 * 2  # fold 1 has no rows
    rows = [(int(f), [int(f * 12 + j) for j in np.flatnonzero(v)], [float(u) for u in v[v != 0]], float(t)) for f, v, t in zip(fold, a, y)]
    df = spark.createDataFrame(rows, "fold int, idx array<int>, val array<double>, y double").repartition(3)
    m = sp.SparseRidge(0.5, 1e-10).fit(df, "y", [0, 1, 2], 12, np.ones((12, 1)))
    assert m.residual.max() <= 1e-10
    assert np.isnan(m.intercept[1]).all() and not m.coef[1].any()
    for f in (0, 2):
        got = [v["p"][0] for v in m.transform(df.filter(f"fold = {f}"), ["y"]).orderBy("y").collect()]
        on = fold == f
        assert np.allclose(got, dense_ridge(a[on], y[on], a[on], 0.5)[np.argsort(y[on])], atol=1e-8)
