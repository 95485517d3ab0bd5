"""Ridge on folds from products against a plain fit of every fold."""

import numpy as np
import pytest

from tidemark.operators import evaluation as ev
from tidemark.operators import gram
from tidemark.session import cut_lineage

COLS = ["a", "b", "c", "flat", "empty", "late"]
ALPHAS = [0.1, 1.0, 10.0, 100.0]


def plain_fit(x, y, tx, alpha):
    med = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
    fill = lambda m: np.where(np.isnan(m), med, m)
    x, tx = fill(x), fill(tx)
    mean, std = x.mean(0), x.std(0)
    live = std > 1e-9
    std = np.where(live, std, 1.0)
    s, t = (x - mean) / std * live, (tx - mean) / std * live
    w = np.linalg.solve(s.T @ s + alpha * np.eye(s.shape[1]), s.T @ (y - y.mean()))
    return t @ w + y.mean()


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    n = 120
    a = r.normal(5000.0, 3.0, n)
    b = 0.97 * a + r.normal(0, 0.1, n)  # nearly collinear, far from zero
    c = r.normal(size=n)
    y = 0.3 * (a - 5000) - 0.5 * c + r.normal(size=n)
    x = np.column_stack([a, b, c, np.full(n, 7.0), np.full(n, np.nan), r.normal(size=n)])
    x[r.random(n) < 0.2, 0] = np.nan
    x[r.random(n) < 0.1, 2] = np.nan
    x[:60, 5] = np.nan  # no train value in the first folds
    x[61, 2] = np.inf
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], float(y[i])) for i in range(n)]
    x[61, 2] = np.nan  # an infinite value is a missing one
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in COLS) + ", target double")
    return x, y, cut_lineage(ev.fold_roles(df.repartition(5), ["id"], 5, 2))


def expected(x, y, alpha):
    n, k, gap = len(y), 5, 2
    size = n // (k + 1)
    out = {}
    for f in range(k):
        end = size * (f + 1)
        lo, hi = end + gap, min(end + gap + size, n)
        for i, p in zip(range(lo, hi), plain_fit(x[:end], y[:end], x[lo:hi], alpha)):
            out[f, i] = p
    return out


def test_every_fold_and_penalty_equals_a_plain_fit(table):
    x, y, rows = table
    models = gram.ridge_folds(rows, COLS, "target", ALPHAS)
    got = {(r["alpha"], r["fold"], r["id"]): r["p"] for r in gram.ridge_predictions(rows, models, COLS, "target", ["id"]).collect()}
    want = {(a, *k): p for a in ALPHAS for k, p in expected(x, y, a).items()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_scores_of_products_equal_scores_of_predictions(table):
    _x, _y, rows = table
    by_products = {r["alpha"]: r for r in gram.pooled_scores(gram.ridge_folds(rows, COLS, "target", ALPHAS)).collect()}
    by_rows = {r["candidate"]: r for r in gram.ridge_scores(rows, COLS, "target", ["id"], ALPHAS).collect()}
    for a in ALPHAS:
        p, q = by_products[a], by_rows[f"ridge_{a}"]
        assert p["n"] == q["n"] and p["r2"] == pytest.approx(q["r2"], abs=1e-7) and p["rmse"] == pytest.approx(q["rmse"], abs=1e-7)


def test_sets_of_columns_share_the_products(table):
    x, y, rows = table
    models = gram.ridge_folds(rows, COLS, "target", [1.0], {"all": COLS, "two": ["a", "c"]})
    two = gram.ridge_predictions(rows, models.filter("features = 'two'"), COLS, "target", ["id"]).collect()
    want = expected(x[:, [0, 2]], y, 1.0)
    assert len(two) == len(want) and max(abs(r["p"] - want[r["fold"], r["id"]]) for r in two) < 1e-6


def test_roles_are_those_of_walk_forward(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    long = {(r["k"], r["fold"], r["role"]) for r in ev.walk_forward(df, ["k"], 4, 3).collect()}
    once = {(r["k"], f, role) for r in ev.fold_roles(df, ["k"], 4, 3).collect() for f, role in enumerate(r["roles"]) if role}
    assert long == once
