"""The corpus pipeline against its stages by brute force, on the smallest tables."""

import re

import corpus_pipeline
import pytest
import __spark_entry__ as entry

from tidemark.llm import queries, secret_scan, toxicity


def test_pipeline_on_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = {r["doc_id"]: r for r in docs.collect()}
    kept = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "simhash", "secrets", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns
        seen[name] = {r["doc_id"]: r for r in kept.collect()}
    assert len(seen["language"]) >= 0.98 * len(by)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    grammar = toxicity.Grammar(model.lexicon)
    for i, r in seen["language"].items():
        assert (i in seen["toxicity"]) == (model.score(grammar, [r["text"]])[0] < 0.5)
    from test_resemblance import brute_groups
    ids = sorted(seen["toxicity"])
    root = brute_groups([seen["toxicity"][i]["text"] for i in ids])
    assert set(seen["simhash"]) == {ids[k] for k in set(root)}
    assert set(seen["secrets"]) == set(seen["simhash"])
    for i, r in seen["secrets"].items():
        assert not secret_scan.base_spans(r["text"])
        assert r["text"] == by[i]["text"] or "[SECRET]" in r["text"]
        assert r["n_chars"] == len(r["text"])
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in packed} == set(seen["secrets"])
    assert sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES} == {str(i) for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names


@pytest.mark.parametrize("name", ["op1_language", "op2_simhash", "op3_fingerprints", "op4_lm_scores", "op7_toxicity", "op8_bpe", "op10_secrets"])
def test_queries_return_every_document(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert "doc_id" in got.columns
