"""Sparse singular vectors against numpy."""

import numpy as np
import pytest

from tidemark.operators import models as md
from tidemark.operators import sparse as sp
from tidemark.sources.tables import text_table


def frame(spark, a):
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for i, r in enumerate(a)]
    return spark.createDataFrame(rows, "id int, idx array<int>, val array<double>").repartition(3)


@pytest.mark.parametrize("shape,k", [((60, 90), 8), ((40, 5), 24), ((6, 30), 10), ((5, 1), 3)])
def test_singular_values_equal_numpy(spark, shape, k):
    r = np.random.default_rng(1)
    a = np.where(r.random(shape) < 0.3, r.normal(size=shape), 0.0)
    want = np.linalg.svd(a, compute_uv=False)
    df = frame(spark, a)
    m = sp.SparseSVD(k).fit(df, shape[1])
    n = max(1, min(k, shape[1] - 1))
    full = np.zeros(n)
    full[:min(n, len(want))] = want[:n]
    assert np.abs(m.singular - full).max() < 1e-6 * want[0]
    got = {x["id"]: x["svd"] for x in m.transform(df, "id").collect()}
    assert np.abs(np.array([got[i] for i in range(len(a))]) - a @ m.components).max() < 1e-9


def test_repeated_values_and_restarts(spark):
    u = np.linalg.qr(np.random.default_rng(2).normal(size=(300, 300)))[0]
    a = u * np.linspace(3.0, 2.0, 300)  # no gap anywhere, so the subspace restarts
    a[:, 1] = u[:, 1] * 3.0
    m = sp.SparseSVD(4, tol=1e-6).fit(frame(spark, a), 300)
    assert m.steps > sp.DEPTH
    assert np.abs(m.singular - np.linalg.svd(a, compute_uv=False)[:4]).max() < 1e-6


def test_empty_rows_and_no_terms(spark):
    df = spark.createDataFrame([(1, [], [])], "id int, idx array<int>, val array<double>")
    for n in (0, 1, 7):
        m = sp.SparseSVD(3).fit(df, n)
        assert not m.singular.any()
        assert not np.array(m.transform(df, "id").first()["svd"]).any()


def test_documents_of_a_table(spark, sf):
    d = text_table(spark, sf, "documents").select("doc_id", "text")
    long = md.tfidf_rows(d, "doc_id", "text")
    rows, vocab = sp.sparse_rows(long, d, "doc_id", "term", "tfidf")
    n = vocab.count()
    a = np.zeros((rows.count(), n))
    for i, r in enumerate(rows.collect()):
        a[i, r["idx"]] = r["val"]
    m = sp.SparseSVD(24).fit(rows, n)
    assert np.abs(m.singular - np.linalg.svd(a, compute_uv=False)[:24]).max() < 1e-6
