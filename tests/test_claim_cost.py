"""Claims of texts with long runs of blanks: one pass, and the same tokens."""

import time

from pyspark.sql import functions as F

from tidemark.functions import tokens as tok


def test_long_runs_of_blanks(spark):
    blanks = " " * 300_000
    line = f"The quick-brown fox jumped over{blanks}twelve sleeping dogs near the river."
    df = spark.createDataFrame([(1, f"{blanks}\n{line}\n\n- Second claims are shorter. Third sentence follows here.{blanks}x")], "id int, text string").repartition(1)
    start = time.time()
    got = df.select(tok.claims(F.col("text")).alias("c"), tok.word_count(F.col("text")).alias("n")).first()
    assert time.time() - start < 30
    assert [(c["line"], c["text"]) for c in got["c"]][:2] == [(2, line), (4, "Second claims are shorter.")]
    assert got["n"] == 21


def test_words_are_as_many_as_tokens(spark):
    texts = ["", " ", "-", "- a -b- the", "co-op re-use of-the x-y state-of-the-art", "Parties, cities' studies/boxes 3.5% C++ a.b", "É naïve the THE Theses", "ends with dash- -starts", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tok.claim_words(F.col("t")).alias("w"), tok.claim_tokens(F.col("t")).alias("k"))
    for r in df.collect():
        assert (r["w"] is None and r["k"] is None) if r["t"] is None else len(r["w"]) == len(r["k"]), r
    assert df.filter("t like 'co-op%'").first()["w"] == ["co-op", "co", "op", "re-use", "re", "use", "of-the", "x-y", "state-of-the-art", "state", "art"]
