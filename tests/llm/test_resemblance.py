"""The near-copy stage of the pipeline against brute force over five-word shingles."""

import random

import corpus_pipeline
import numpy as np
from tidemark.llm import resemblance, simhash


def brute_groups(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def test_stage_leaves_no_near_copy(spark, sf):
    r = random.Random(4)
    texts = ["", " ", None, "one two", "One  two", "one two three"]
    for i in range(30):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice((40, 120, 400)))]
        texts.append(" ".join(words))
        for _ in range(3):
            for k in r.sample(range(len(words)), max(1, len(words) // 100)):
                words[k] = f"x{r.randrange(3000)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = brute_groups(texts)
    from tidemark.llm.common import written
    kept = corpus_pipeline.simhash_stage(spark, written(docs), sf)
    assert {x["doc_id"] for x in kept.collect()} == set(want)
    got = {x["id"]: x["component"] for x in resemblance.groups(written(docs)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_stage_on_the_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = docs.orderBy("doc_id").collect()
    want = {by[k]["doc_id"] for k in brute_groups([x["text"] for x in by])}
    kept = corpus_pipeline.simhash_stage(spark, docs, sf)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == want


def boilerplate(n, seed=8, own=100, shared=200):
    """Texts that share most words and are no near copies."""
    r = random.Random(seed)
    block = " ".join(f"b{k}" for k in range(shared))
    return [" ".join(f"w{r.randrange(10 ** 6)}" for _ in range(own // 2)) + " " + block + " " + " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(own // 2)) for _ in range(n)]


def test_boilerplate_costs_few_pairs(spark, monkeypatch):
    met = []
    plain = resemblance.verified

    def counted(pairs, whole, similarity):
        pairs = pairs.cache()
        met.append(pairs.count())
        return plain(pairs, whole, similarity)
    monkeypatch.setattr(resemblance, "verified", counted)
    for n in (300, 600):
        met.clear()
        docs = spark.createDataFrame(list(enumerate(boilerplate(n))), "doc_id bigint, text string")
        got = resemblance.groups(docs).collect()
        assert len(got) == n and all(r["kept"] and r["component"] == r["id"] for r in got)
        assert sum(met) <= 20 * n


def test_group_at_the_threshold(spark):
    """Variants of one text, half of whose pairs are below the threshold, beside texts that share a passage with them."""
    r = random.Random(12)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(150):
        words = list(base)
        for k in r.sample(range(150), r.choice((1, 2, 3, 5))):
            words[k] = f"x{r.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    texts += boilerplate(40, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["id"]: x["component"] for x in resemblance.groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, None, 1.0, "a"), (None, "", 2.0, "a"), (2, "a b c d e f", 3.0, None), (2, "a b c d e f", 3.0, None), (None, "only here", None, "x"), (7, long, 0.0, "y"), (5, long + " end", 0.0, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row double, _row string").coalesce(1)
    kept = resemblance.drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["row"] or 0.0) for r in kept.collect()) == [(0, 0.0), (1, 1.0), (2, 3.0), (5, 0.0)]
    assert {(r["id"], r["component"]) for r in resemblance.groups(docs).collect()} == {(1, 1), (None, 1), (2, 2), (None, None), (7, 5), (5, 5)}
    assert resemblance.drop_near(docs.limit(0)).count() == 0


def test_simhash_links_are_followed_and_verified(spark, monkeypatch):
    """With no pair from lists or rare shingles, texts whose fingerprints link are one group only if they resemble each other."""
    r = random.Random(21)
    while True:
        words = [f"w{r.randrange(10 ** 6)}" for _ in range(400)]
        other = [*words[:200], "changed", *words[201:]]
        if 0 < (simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(" ".join(other))).bit_count() <= 2:
            break
    beat = "a b c " * 50
    unlike = [beat + " ".join(f"{k}{r.randrange(10 ** 6)}" for _ in range(20)) for k in "xy"]
    assert simhash.fingerprint(unlike[0]) == simhash.fingerprint(unlike[1])
    for name in ("head_pairs", "rare_pairs"):
        monkeypatch.setattr(resemblance, name, lambda *a, f=getattr(resemblance, name): f(*a).filter("false"))
    docs = spark.createDataFrame(list(enumerate([" ".join(words), " ".join(other), *unlike])), "doc_id bigint, text string")
    assert {x["id"]: x["component"] for x in resemblance.groups(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def variants(n, seed, words=150, most=9):
    """Variants of one text, each without one to ``most`` of its words: many pairs a little below the threshold, few shingles of one variant only."""
    r = random.Random(seed)
    return [" ".join(f"w{k}" for k in sorted(r.sample(range(words), words - r.randint(1, most)))) for _ in range(n)]


def test_pairs_far_below_the_threshold_are_not_made(spark, monkeypatch):
    """Rows of the join by rare shingles: of members that cannot share enough by their parities, none."""
    made = []
    plain = resemblance.rare_pairs

    def counted(members, whole, similarity):
        pairs = plain(members, whole, similarity).cache()
        made.append(sum(r["shared"] for r in pairs.select("shared").collect()))
        return pairs
    monkeypatch.setattr(resemblance, "rare_pairs", counted)
    texts = variants(400, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["id"]: x["component"] for x in resemblance.groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)
    assert sum(made) <= 10 * len(texts)


def test_parities_bound_what_sets_share(spark):
    r = random.Random(3)
    rows = []
    for _ in range(200):
        pool = [r.randrange(1 << 64) for _ in range(r.choice((1, 20, 150, 2000)))]
        both = pool[:r.randint(0, len(pool))]
        a, b = ({*both, *(r.randrange(1 << 64) for _ in range(r.choice((0, 5, 100))))} for _ in range(2))
        rows.append((*(resemblance.parity(np.array(sorted(s), np.uint64)).tolist() for s in (a, b)), len(a), len(b), len(a & b)))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, n bigint, m bigint, shared bigint")
    got = df.select("n", "m", "shared", resemblance.may_share(df.a, df.b, df.n, df.m).alias("most")).collect()
    assert all(x["shared"] <= x["most"] <= min(x["n"], x["m"]) + abs(x["n"] - x["m"]) / 2 for x in got)
    assert sum(x["most"] - x["shared"] <= 2 for x in got) >= 50
