"""Incremental duplicates: equal to one run over everything, retries change nothing, old postings are not read."""

import datetime as dt
import random
import shutil

import pytest

from tidemark.operators import postings as po
from tidemark.streaming import discovery

TITLES = ["Software Engineer", "Softwre Engineer", "Data Engineer", "Data Enginer II", "Nurse", "Clerk", "Backend Developer", "Backend Develper", ""]
PLACES = ["Calgary", "Calgry", "Toronto", "Remote", None]
SCHEMA = "id bigint, source string, title string, company string, location string, apply_url string, first_seen_at date, match_score double, location_bucket string"


def rows(n, seed):
    r = random.Random(seed)
    return [(i, r.choice("abc"), r.choice(TITLES), r.choice(["Acme", "Acne", "Beta Corp", "Gamma"]), r.choice(PLACES), f"u{r.randrange(n)}", dt.date(2001, 1, 1) + dt.timedelta(days=i // 3), 0.5, "x") for i in range(n)]


def brute(spark, postings):
    """The duplicates of one run over all postings."""
    df = spark.createDataFrame(postings, SCHEMA)
    first = po.dedup_exact(df)
    roots = po.dedup_fuzzy(first).select("apply_url", "duplicate_of")
    members = df.join(roots, "apply_url")
    got = po.merge_sources(members, "duplicate_of").collect()
    return {r["duplicate_of"]: list(r["sources"]) for r in got}


def result(spark, store, batches=(1 << 31) - 1):
    return {r["id"]: list(r["sources"]) for r in discovery.canonical(spark, store, batches).collect()}


@pytest.mark.parametrize("seed", [1])
def test_batches_equal_one_run(spark, tmp_path, seed):
    store, every = str(tmp_path / "store"), rows(90, seed)
    cuts = [every[:40], [], every[40:]]
    for n, part in enumerate(cuts):
        if n == 2:  # from here on no posting of the first batches can be read
            shutil.move(f"{store}/postings/batch=0", str(tmp_path / "aside"))
        batch = spark.createDataFrame(part, SCHEMA)
        discovery.add_batch(spark, batch, store, n)
        if n == 2:  # a retry
            discovery.add_batch(spark, batch, store, n)
    shutil.move(str(tmp_path / "aside"), f"{store}/postings/batch=0")
    assert result(spark, store) == brute(spark, every)
    assert result(spark, store, 2) == brute(spark, every[:40])


def test_lookup_reads_only_touched_partitions(spark, tmp_path):
    store = str(tmp_path / "store")
    discovery.add_batch(spark, spark.createDataFrame(rows(60, 2), SCHEMA), store, 0)
    s = discovery.Store(spark, store, 1)
    one = s.read("keys").limit(1)
    key = one.first()["key"]
    found = s.lookup("keys", spark.createDataFrame([(key,)], "key string"))
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [line.split("PartitionFilters: ", 1)[1].split("PushedFilters")[0] for line in plan.splitlines() if "PartitionFilters: " in line]
    assert any("part#" in f and str(one.first()["part"]) in f for f in filters)
