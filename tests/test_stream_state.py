"""Source health over restarts: only touched sources are written, and the result is that of one run."""

import random

from tidemark.operators import lifecycle as lc
from tidemark.streaming import jobs


def test_health_over_restarts(spark, tmp_path):
    r = random.Random(3)
    schema = "s string, n int, ok boolean"
    rows = [(r.choice("abcdef" if i < 60 else "ab"), i, r.random() < 0.4) for i in range(120)]
    folder, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "ckpt"))
    for n, part in enumerate((rows[:60], rows[60:90], rows[90:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        jobs.source_health(jobs.file_stream(spark, folder, schema), "s", "ok", ["n"], state, checkpoint)
        written = spark.read.parquet(f"{state}/health/batch={n}")
        assert {x["s"] for x in written.collect()} == {s for s, _, _ in part}
    jobs.source_health(jobs.file_stream(spark, folder, schema), "s", "ok", ["n"], state, checkpoint)  # nothing new
    whole = lc.health_state(lc.health_delta(spark.createDataFrame(rows, schema), "s", "ok", ["n"]), None, "s")
    got = jobs.health_store(spark, state, "s", "string").newest("health")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select("s", "retry_count", "status").collect()))
    before = jobs.health_store(spark, state, "s", "string", 1).newest("health")
    first = lc.health_state(lc.health_delta(spark.createDataFrame(rows[:60], schema), "s", "ok", ["n"]), None, "s")
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, first.select("s", "retry_count", "status").collect()))
