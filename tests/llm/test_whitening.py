"""Whitening against numpy over all rows, and exact sums against Python's whole numbers."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import queries, whitening


def brute(rows, components=8, once=False):
    x = {i: [math.floor(1024 * float(v)) + 100_000 for v in vec] for i, vec in enumerate(rows)}
    fit = [list(v) for v in ({tuple(v) for v in x.values()} if once else x.values())]
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    dev = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    m = np.array([[float(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    cov = m.T @ m / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    z = {i: np.array([(n * a - s) / n for a, s in zip(v, sums)]) @ q / np.sqrt(np.maximum(e, 1e-300)) for i, v in x.items()}
    return n, dev, z, e / np.trace(cov)


def check(got, rows, components=8, once=False):
    n, dev, z, explained = brute(rows, components, once)
    by = defaultdict(dict)
    for r in got:
        by[r["id"]][r["component"]] = r
    assert by.keys() == dev.keys()
    k = min(components, len(rows[0]))
    sign = None
    for i, parts in by.items():
        assert sorted(parts) == list(range(1, k + 1))
        assert all(r["n"] == n and int(r["deviation"]) == dev[i] for r in parts.values())
        assert np.allclose([parts[j]["explained"] for j in range(1, k + 1)], explained, rtol=1e-9)
    w = np.array([[by[i][j]["whitened"] for j in range(1, k + 1)] for i in sorted(by)])
    want = np.array([z[i] for i in sorted(by)])
    sign = np.sign((w * want).sum(axis=0))
    assert np.allclose(w, want * sign, atol=1e-7)
    assert got[0]["identity_error"] < 1e-8


@pytest.mark.parametrize("weight", ["count", "one"])
def test_against_numpy(spark, weight):
    r = np.random.default_rng(2)
    base = (r.standard_normal((60, 12)) @ r.standard_normal((12, 12))).astype(np.float32)
    rows = [*base, *base[:20], *[base[3]] * 200]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(rows)], "vec_id int, embedding array<float>, x string").repartition(5)
    check(whitening.whiten(df, weight=weight).collect(), rows, once=weight == "one")


def test_query_on_the_small_table(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])
    got = queries.op11_whitening(spark, sf).withColumnRenamed("vec_id", "id").collect()
    at = {r["vec_id"]: k for k, r in enumerate(rows)}
    check([{**r.asDict(), "id": at[r["id"]]} for r in got], [r["embedding"] for r in rows])


def test_odd_vectors(spark):
    schema = "vec_id int, embedding array<double>, w string, x int"
    nan, inf = float("nan"), float("inf")
    bad = [(0, None), (1, [1.0, None, 2.0]), (2, [nan, 0.0, 0.0]), (3, [0.0, -inf, 0.0]), (4, []), (5, [1.0, 2.0])]
    good = [(None, [0.5, 0.25, -1.0]), (7, [0.5, 0.25, -1.0]), (7, [0.5, 0.25, -1.0]), (8, [1.0, 0.25, 3.0]), (9, [-2.0, 0.25, 0.1])]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in bad + good], schema)
    got = whitening.whiten(df).collect()
    assert sorted((r["id"] is not None, r["id"] or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in good for _ in range(3))
    assert all(r["n"] == 5 for r in got) and all(r["whitened"] == 0 for r in got if r["component"] == 3)  # rank two
    assert got[0]["identity_error"] < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(4, [], "a", 1)], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0], "a", 1)], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, 0.0, 0.0)] * 2
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 3.0], "a", 1), (2, [-1e300, 3.0], "a", 1)], schema)).collect()
    assert {int(r["deviation"]) for r in huge} == {(1 << 53) ** 2}


def test_sums_beyond_64_bits():
    model = whitening.Model(10 ** 9, [10 ** 14 + 7, 3], np.zeros((2, 0)), np.zeros(0), 0.0)
    x = np.array([[100_001, 5], [-5, 10 ** 6]], np.int64)
    assert model.deviation(x) == [sum((10 ** 9 * int(a) - s) ** 2 for a, s in zip(row, model.sums)) for row in x]
