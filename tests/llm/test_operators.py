"""The training-data operators against brute force, libraries, planted cases and odd tables."""

import itertools
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, embeddings, graph, html_text, language, lm, packing, secret_scan, simhash, sketch, toxicity

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n\t ", "a", "a  b", "a \n b\n\n c", "x\x1c y.\x1d z", "a \n\n b", "d   e “q”", "<|endoftext|>", "x <|endoftext|> y<|startoftext|>", "don't we'll it's",
       "x.'s \"a,\" b)", "é. É, ñ;×.÷.", "日本語 テキスト \U0001f389", "é x̸ ≠", "Σ ΣΑΣ İi", "12 345 6a7", "-----=====////", "ab" * 700, "the " * 900, "A.B.C. a,b", "​ zero", " lead", "trail "]
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards boxed up five dozen jugs of liquid and nobody said a word about it".split()


def frame(spark, texts, extra=False, start=0):
    rows = [(start + i, t) + (("x", 1.5, "fp") if extra else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string" + (", score string, row double, `a.b` string" if extra else ""))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(PROSE) for _ in range(n)).capitalize() + "."


def runs(spark, sf):
    """Every operator as a function of a documents-like table."""
    model = language.Model(["en"], np.ones((1, language.WIDTH)), language.WIDTH, 11)
    tox = toxicity.Model(toxicity.Lexicon({"idiot": 3.0}), toxicity.PRIOR)
    return {
        "language": lambda d: language.identify(d, model), "simhash": simhash.groups, "sketch": sketch.fingerprints, "lm": lm.scores,
        "packing": lambda d: packing.pack(d, WORDS), "toxicity": lambda d: toxicity.score(d, tox), "bpe": lambda d: bpe.decode(bpe.encode(d, BYTES), BYTES),
        "secrets": secret_scan.scan, "redact": secret_scan.redact, "near": simhash.drop_near, "known": lambda d: language.keep_known(d, model, least=-1.0),
        "clean": lambda d: toxicity.keep_clean(d, tox), "html": lambda d: html_text.main_text(d.withColumn("url", F.lit("u")), html_text.DEFAULT, "doc_id", "url", "text"),
    }


@pytest.mark.parametrize("name", ["language", "simhash", "sketch", "lm", "packing", "toxicity", "bpe", "secrets", "redact", "near", "known", "clean", "html"])


def test_odd_tables(spark, sf, name):
    fn = runs(spark, sf)[name]
    odd = frame(spark, ODD, extra=True)
    null_id = spark.createDataFrame([(None, t, None, None, None) for t in (None, "a b c", "a b c")], odd.schema)
    rows = fn(odd.unionByName(odd.limit(3)).unionByName(null_id)).collect()
    if name in ("known", "clean", "near"):
        assert rows and len(rows[0]) == 5
    elif name == "packing":
        assert {r["id"] for r in rows} == {None, *range(len(ODD))}
    else:
        assert len(rows) == len(ODD) + 6
    assert fn(odd.limit(0)).count() == 0


# --- language -----------------------------------------------------------------------

def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = language.fit(docs.filter(fold != 1))
    got = language.identify(docs.filter(fold == 1), model).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    rows = got.collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert model.predict([None, "", "123 --", "the"])[0][:3] == ["und"] * 3


def test_language_bundle_is_a_sum_of_bound_ngrams():
    e = language.Encoder(64, 5)
    got = e.bundles(["ab c", None])
    v = {ch: e.draw(ord(ch)).astype(int) for ch in "abc "}
    grams = [" ab", "ab ", " c "]
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in grams)
    assert (got[0] == want).all() and (got[1] == 0).all()
    many = "".join(chr(0x4E00 + i) for i in range(300))  # beyond the table of small alphabets
    assert np.linalg.norm(e.bundles([many])[0]) > 0
    assert (e.bundles(["ab c"])[0] == want).all()


# --- simhash ------------------------------------------------------------------------

def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, linked):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(items)), 2):
        if linked(items[i], items[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(items))]


def test_simhash_against_brute_force(spark):
    r = random.Random(3)
    texts = [t for t in ODD] + [prose(i, r.choice((2, 5, 40, 300))) for i in range(60)]
    texts += [texts[-1], texts[-1], texts[-2]]
    for k in range(40):  # near copies of long texts
        words = prose(900 + k % 4, 400).split()
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    fps = [brute_fp(t) for t in texts]
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    rows = {x["id"]: x for x in simhash.groups(frame(spark, texts)).collect()}
    assert [rows[i]["fp"] & (1 << 64) - 1 for i in range(len(texts))] == fps
    assert [rows[i]["component"] for i in range(len(texts))] == want
    assert [rows[i]["kept"] for i in range(len(texts))] == [i == w for i, w in enumerate(want)]
    assert len(set(want)) < len(texts) - 10
    kept = simhash.drop_near(frame(spark, texts, extra=True)).collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(set(want))


def test_simhash_links_lose_no_pair(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(25)} | set(base))
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp bigint").repartition(3))
    e = edges.collect()
    assert all(((x["a"] ^ x["b"]) & (1 << 64) - 1).bit_count() <= 64 for x in e)
    roots = {x["node"]: x["root"] for x in graph.components(edges).collect()}
    got = [roots.get(signed(x), signed(x)) for x in fps]
    assert len(set(got)) == len(set(want))
    assert len(set(zip(got, want))) == len(set(want))


def test_large_list_equals_small_method():
    r = np.random.default_rng(1)
    low = np.unique(r.integers(0, 1 << 16, 5000)).astype(np.uint64)
    members = ((low & np.uint64(255)) << np.uint64(8) | (low >> np.uint64(8)) << np.uint64(40) | np.uint64(7)).view(np.int64)
    members.sort()
    big = simhash.star(members)
    want = brute_components([int(x) for x in members[:900]], lambda a, b: (a ^ b).bit_count() <= 2)
    small = simhash.star(members[:900])
    assert small.tolist() == [int(members[w]) for w in want]
    left, bits = set(low_bits := [int(x) & (1 << 64) - 1 for x in members]), [1 << b for b in (*range(8, 16), *range(40, 48))]
    flips = bits + [x | y for x, y in itertools.combinations(bits, 2)]
    root = {}
    for x in low_bits:
        todo = [x] if x in left else []
        left.discard(x)
        while todo:
            root[y := todo.pop()] = x
            todo += (near := {y ^ f for f in flips} & left)
            left -= near
    assert [int(x) for x in big] == [root[x] for x in low_bits]


def test_components_of_a_chain(spark):
    n = 200
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7), (5, 6)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in graph.components(chain).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


# --- sketches -----------------------------------------------------------------------

def brute_sketch(text, k=64):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not words:
        return []
    out = set()
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i:i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return sorted(out)[:k]


def test_sketches_against_brute_force(spark):
    texts = ODD + [prose(i, n) for i, n in enumerate((3, 5, 9, 60, 500, 900))]
    rows = {r["id"]: r for r in sketch.fingerprints(frame(spark, texts).repartition(5)).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        m = len(t) // 4
        edited = t[:len(t) - m] + nxt[:m]
        assert rows[i]["edited"] == edited
        assert rows[i]["sketch"] == brute_sketch(t) and rows[i]["edited_sketch"] == brute_sketch(edited) and rows[i]["next_sketch"] == brute_sketch(nxt)
    same = sketch.fingerprints(frame(spark, ["one row"])).first()
    assert same["edited"] == "one ro" + "o" and same["next_sketch"] == same["sketch"]


def test_sketch_estimates_and_merging(spark):
    words = [f"w{i}" for i in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[1000:5000])
    df = spark.createDataFrame([(a, b)], "a string, b string").select(sketch.sketch(F.col("a"), 512).alias("a"), sketch.sketch(F.col("b"), 512).alias("b"))
    r = df.select(sketch.resemblance(F.col("a"), F.col("b"), 512), sketch.containment(F.col("a"), F.col("b"), 512), sketch.distinct_shingles(F.col("a"), 512)).first()
    assert abs(r[0] - 3000 / 5000) < 0.08 and abs(r[1] - 0.75) < 0.12 and abs(r[2] / 3996 - 1) < 0.15
    parts = spark.createDataFrame([("g", brute_sketch(" ".join(words[i:i + 104]))) for i in range(0, 1000, 100)], "g string, sketch array<bigint>")
    assert sketch.merge_parts(parts, ["g"]).first()["sketch"] == brute_sketch(" ".join(words[:1004]))


# --- language model -------------------------------------------------------------------

def test_short_numbers_round_trip():
    x = np.array([1, 127, 128, 16383, 16384, 2**31, 2**40 + 5, 3])
    assert (lm.lengthen(lm.shorten(x)) == x).all() and len(lm.shorten(x[:2])) == 2


def test_lm_against_brute_force(spark):
    texts = [prose(i, 30) for i in range(12)] + ["", None, "zebra", prose(3, 30), "fox"]
    toks = [(t or "").lower().split() for t in texts]
    uni = Counter(w for t in toks for w in t)
    bi = Counter(p for t in toks for p in zip(t, t[1:]))
    n = sum(map(len, toks))
    got = {r["id"]: r for r in lm.scores(frame(spark, texts), block=3).collect()}
    for i, t in enumerate(toks):
        own1, own2 = Counter(t), Counter(zip(t, t[1:]))
        one = lambda w: math.log(max(uni[w] - own1[w], 0.5) / max(n - len(t), 1))
        s = one(t[0]) if t else 0.0
        for a, b in zip(t, t[1:]):
            hit, context = bi[a, b] - own2[a, b], uni[a] - own1[a]
            s += math.log(hit / context) if hit > 0 and context > 0 else math.log(0.4) + one(b)
        assert got[i]["n_tokens"] == len(t)
        assert got[i]["log_score"] == pytest.approx(s, abs=1e-9)
    table = {(r["n"], r["gram"]): r["total"] for r in lm.count_table(frame(spark, texts)).collect()}
    assert table[1, "fox"] == uni["fox"] and {k[1]: v for k, v in table.items() if k[0] == 2} == {" ".join(k): v for k, v in bi.items()}


# --- embeddings -----------------------------------------------------------------------

def brute_links(rows):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    deg, pairs = Counter(), []
    for i, j in itertools.combinations(ok, 2):
        a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
        if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
            deg[i] += 1
            deg[j] += 1
            pairs.append((i, j))
    return deg, pairs


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).tolist(), int(i % 3)) for i in range(60)]
    centre = rng.standard_normal(16)
    for i in range(120):  # one dense group, split into blocks
        rows.append((100 + i, (centre + rng.standard_normal(16) * rng.choice((0.05, 0.2))).tolist(), 1))
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(7)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, rows[70][1], None), (404, [None] * 16, 1), (405, [], 1), (406, [float("inf")] * 16, 1), (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1), (409, [1e300] * 16, 1), (410, [-0.0] + rows[5][1][1:], 2), (rows[0][0], rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
    got = embeddings.links(df, block=16).collect()
    assert len(got) == len(rows)
    deg, pairs = brute_links(rows)
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"]].append(r)
    want = sum(deg.values())
    have = sum(r["n_links"] for r in got)
    assert 0.9 * want <= have <= want
    assert all(r["n_links"] <= max(deg[i] for i, x in enumerate(rows) if x[0] == r["vec_id"]) for r in got)
    root = {i: x[0] for i, x in enumerate(rows)}
    for _ in range(len(rows)):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    exact = sum(r["component_id"] == min(root[i] for i, x in enumerate(rows) if x[0] == r["vec_id"]) for r in got)
    assert exact >= 0.95 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    for vec in (400, 401, 402, 403, 404, 405, 406):
        assert (by[vec][0]["n_links"], by[vec][0]["component_id"]) == (0, vec)
    assert by[407][0]["n_links"] == 1 and by[408][0]["component_id"] == 407
    assert embeddings.links(df.limit(0)).count() == 0


def test_embeddings_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    deg, _ = brute_links(rows)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.links(df).collect()}
    assert sum(got.values()) >= 0.95 * sum(deg.values())
    assert all(got[r[0]] <= deg[i] for i, r in enumerate(rows))


# --- packing ----------------------------------------------------------------------------

def test_windows_are_optimal():
    r = random.Random(5)
    for _ in range(40):
        place = sorted(r.sample(range(1, 120), r.randrange(2, 30)))
        while max(b - a for a, b in zip([0, *place], place)) > 25:
            place = sorted({*place, *(a + 20 for a, b in zip([0, *place], place) if b - a > 25)})
        penalty = [r.choice((0.0, 4.0, 9.0)) for _ in place]
        ends, tail = packing.windows(place, penalty, 0, 25)
        assert ends == sorted(set(ends)) and all(b - a <= 25 for a, b in zip([0, *ends], ends)) and (ends[-1] if ends else 0) == tail

        def cost(chosen):
            return sum(25 - (b - a) + penalty[place.index(b)] for a, b in zip([0, *chosen], chosen))
        best = {0: 0.0}
        for i, p in enumerate(place):
            best[p] = min(best[q] + 25 - (p - q) + penalty[i] for q in [0, *place[:i]] if p - q <= 25)
        assert cost(ends) == best[tail]
        assert cost(ends) == min(best[p] for p in [0, *place] if place[-1] - p < 25)


def cheapest(places, inner, end, size):
    """Cost and cost + place of the best cuts up to every token, each token a place."""
    best = {0: 0.0}
    for p in range(1, end + 1):
        best[p] = min(best[q] + size - (p - q) + places.get(p, inner) for q in range(max(0, p - size), p))
    return best


def test_windows_end_at_any_token():
    r = random.Random(6)
    for _ in range(60):
        end, size, inner = r.randrange(1, 400), 16, float(r.choice((5, 9, 32)))
        places = {p: r.choice((0.0, 4.0)) for p in (*r.sample(range(1, end + 1), r.randrange(end + 1) // r.choice((1, 3, 20))), end)}
        ends, tail = packing.windows(sorted(places), [places[p] for p in sorted(places)], 0, size, inner)
        assert all(0 < b - a <= size for a, b in zip([0, *ends], ends)) and (ends[-1] if ends else 0) == tail
        best = cheapest(places, inner, end, size)
        got = sum(size - (b - a) + places.get(b, inner) for a, b in zip([0, *ends], ends))
        assert got == best[tail] == min(best[p] for p in best if end - p < size)


def test_every_sentence_end_is_a_cut_point():
    ends, sentences = [40, 700], np.array([3, 5, 9, 40, 47, 50, 51, 690, 695])
    place, penalty = packing.cut_points(ends, sentences, 4)
    assert place == [5, 9, 40, 47, 50, 51, 690, 695, 700]
    assert [p for p, x in zip(place, penalty) if not x] == ends and set(penalty) == {0.0, packing.SENTENCE_PENALTY}


def test_packing_costs_least():
    """A block of short and long sentences, cut as if every token had been tried."""
    r = random.Random(7)
    for size in (16, 64):
        packer = packing.Packer(0, size)
        for i in range(8):
            n = r.randrange(1, 300)
            packer.add(i, bytes(4 * n), np.array(sorted(r.sample(range(1, n + 1), n // r.choice((1, 2, 9, 60)))), np.int64))
        places = {int(p): packing.SENTENCE_PENALTY for x in packer.sentences for p in x} | {p: 0.0 for p in packer.ends}
        end = packer.end
        best = cheapest(places, packing.INNER_PENALTY, end, size)
        rows = packer.flush(False)
        length = defaultdict(int)
        for x in rows:
            length[x[5]] += x[2]
        stops = list(itertools.accumulate(length[k] for k in sorted(length)))
        assert packer.start == (stops or [0])[-1]
        got = sum(size - (b - a) + places.get(b, packing.INNER_PENALTY) for a, b in zip([0, *stops], stops))
        assert got == min(best[p] for p in best if end - p < size)


def test_sentence_ends_beside_special_tokens():
    tool = packing.Words(WORDS)
    mark = tool.marks[0].decode()
    text = f"One two. Three {mark} four? Five"
    (_, got), = [x for x in tool.encode(pa.array([text]))]
    count = lambda x: len(tool.tokenizer.encode(x, add_special_tokens=False).ids)
    assert got[0][1].tolist() == [count("One two."), count(f"One two. Three {mark} four?")]


def test_packing_keeps_every_id_once(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORDS)
    texts = ODD + [prose(i, n) for i, n in enumerate((10, 3000, 200, 7000, 1, 900))]
    rows = packing.pack(frame(spark, texts).repartition(2), WORDS).collect()
    per, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        per[r["id"]].append(r)
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        parts = sorted(per[i], key=lambda r: r["start"])
        assert [r["start"] for r in parts] == [0, *itertools.accumulate(r["length"] for r in parts)][:-1]
        assert b"".join(r["ids"] for r in parts) == struct.pack(f"<{len(ids)}I", *ids)
        assert all(r["doc_tokens"] == len(ids) and len(r["ids"]) == 4 * r["length"] for r in parts)
    padding = 0
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.02 * sum(n for parts in seq.values() for _, n in parts)


# --- toxicity -----------------------------------------------------------------------------

def test_grammar_roles():
    g = toxicity.Grammar(toxicity.Lexicon({"idiot": 2.0}, {"vequ": 3.0}))
    role = lambda s: [r for a, b in g.clauses(s) for r, _ in g.clause(s[a:b])]
    assert role("what an idiot was here.") == ["plain"]
    assert role("well. you are an idiot, yes.") == ["aimed"]
    assert role("he is not an idiot.") == ["negated"]
    assert role("they quoted the word idiot there") == ["reported"]
    assert role('the word "idiot" stands here') == ["reported"]
    assert role("i will kill you") == ["threat"] and role("you kill") == ["threat_aimed"]
    assert role("le vequté arrive. un idiotic mot") == ["plain"]
    assert role("nothing here. xidiot") == []


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels)
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, labels.filter(fold != 0))
    rows = toxicity.score(docs, model).join(labels.filter(fold == 0).select(F.col("doc_id").alias("id"), "toxic"), "id").collect()
    assert auc([r["score"] for r in rows], [r["toxic"] for r in rows]) >= 0.85
    clean = [r["score"] < 0.5 for r in rows if r["toxic"] == 0]
    assert np.mean(clean) >= 0.97
    none = toxicity.fit(docs, labels.limit(0))
    assert none.lexicon.words == {} and toxicity.score(docs.limit(2), none).count() == 2


def test_copied_toxic_text_teaches_only_its_insults(spark):
    texts = [prose(i, 40) for i in range(60)]
    copied = prose(999, 30) + " grumblewort plonk sentence"
    texts += [copied + f" {i}" for i in range(20)] + [prose(500 + i, 20) + " plonk" for i in range(20)]
    y = spark.createDataFrame([(i, int(i >= 60)) for i in range(100)], "doc_id bigint, toxic int")
    model = toxicity.fit(frame(spark, texts), y)
    assert model.lexicon.weight("plonk") > 0 and model.lexicon.weight("grumblewort") == 0
    assert toxicity.score(frame(spark, ["you plonk", "the fox"]), model).orderBy("id").collect()[0]["score"] > 0.5


# --- bpe ------------------------------------------------------------------------------------

def test_bpe_equals_the_library(spark, sf):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BYTES)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows = {r["id"]: r for r in bpe.decode(bpe.encode(frame(spark, texts), BYTES), BYTES).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == struct.pack(f"<{len(ids)}I", *ids), x
        assert rows[i]["decoded"] == t.decode(ids, skip_special_tokens=False) == (x or "")


def test_verification_sends_only_wrong_words_to_exact_merging():
    v = bpe.Vocabulary(BYTES)
    r = random.Random(2)
    words = list({"".join(r.choice("abcdeghinorst ") for _ in range(r.randrange(1, 14))).encode() for _ in range(3000)})
    got, failed = v.encode_words(words)
    assert got == [v.exact(w) for w in words]
    assert failed == sum(v.propose(w) != v.exact(w) for w in words)


# --- html -----------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a> site name</header>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><div class="cookie-notice">We use cookies to make this site work for you</div>
<main><h1>A   title &amp; more</h1><script>var x = "</p>";</script><p>First <b>bold</b>&nbsp;text<br>next line</p><div class="ad box">Buy now and save a lot</div>
<ul><li>item one of the list<li>item two of the list</ul><form><label>Name</label><input></form><p>Last words of the piece&hellip;</main>
<aside>Related: other stories that you may like</aside><section id="comments"><p>A reader writes a long comment about the article here</p></section><footer>&copy; site, all rights</footer></body></html>"""


def test_html_leaves_furniture_out():
    want = "A title & more\nFirst bold text next line\nitem one of the list\nitem two of the list\nLast words of the piece…"
    assert html_text.extract(PAGE) == want
    plain = PAGE.replace("<main>", "<div class=content>").replace("</main>", "</div>")
    assert html_text.extract(plain) == want
    assert [html_text.extract(x) for x in ("", "<p>", "<script>a b c", "<nav>a b</nav>", "<!-- x")] == [""] * 5
    assert html_text.extract("plain words only") == "plain words only"
    assert html_text.extract("<p>one <a href=\"x>two</a> three") == "one two three"
    assert html_text.extract("<div class='with sidebar'><nav>a b</nav><p>all of the text</div>") == "all of the text"
    assert html_text.extract("<p>open <b>tags <i>everywhere<p>second one") == "open tags everywhere\nsecond one"


def test_region_is_the_best_contiguous_sum():
    r = random.Random(6)
    for _ in range(200):
        x = [r.randrange(-5, 5) for _ in range(r.randrange(0, 12))]
        a, b = html_text.region([float(v) for v in x])
        best = max([0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])
        assert sum(x[a:b]) == best


def test_html_weights_and_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = html_text.fit(pages)
    assert all(w < 0 for w in weights.values()) and weights["li"] < weights["p"]
    for r in html_text.main_text(pages, weights).limit(20).collect():
        page = pages.filter(F.col("page_id") == r["id"]).first()["html"]
        body = re.search(r"<article>(.*)</article>", page, re.S)[1]
        import html
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b)
    assert html_text.fit(pages.limit(0)) == html_text.DEFAULT


# --- secrets --------------------------------------------------------------------------------

def test_base_spans_and_entropy():
    allow = secret_scan.allow_list()
    s = lambda t: secret_scan.spans(t, allow)
    assert s('PassWord = "abc123" x') == [("assign", 0, 18)]
    assert s("token: abc") == [] and s("api-key=abcdefg") == [] and s("api_key:abcdefg") == [("assign", 0, 15)]
    assert s("AKIA" + "B" * 16) == [("access", 0, 20)] and s("AKIA" + "B" * 15) == []
    assert s("x" + "0123456789abcdef" * 2) == [("hex", 1, 33)]
    both = "secret=" + "0123456789abcdef" * 2
    assert s(both) == [("assign", 0, len(both)), ("hex", 7, len(both))]
    assert s("ſecret=abcdefgh") == []  # only the letters of ASCII match in either case
    key = "Zk3Qx9LmT7vRb2YwN8sHc4PdF6gJ1aUe"
    assert s(f"key {key} end") == [("entropy", 4, 4 + len(key))]
    for clean in (f"https://example.com/{key}", f"sha256:{key}", "123e4567-e89b-12d3-a456-426614174000", "internationalization/of/documents-2024", "2024-01-01/2024-12-31_00000", "a" * 40 + "1"):
        assert [x for x in s(clean) if x[0] == "entropy"] == [], clean


def test_incremental_entropy_equals_direct():
    r = random.Random(9)
    for _ in range(50):
        t = "".join(r.choice("abcdef0123456789XYZ") for _ in range(r.randrange(0, 60)))
        hot = set()
        for i in range(len(t) - 19):
            n = Counter(t[i:i + 20])
            if -sum(k / 20 * math.log2(k / 20) for k in n.values()) >= 3.4 - 1e-9:
                hot.update(range(i, i + 20))
        assert {k for a, b in secret_scan.hot_windows(t, 3.4) for k in range(a, b)} == hot


def test_redaction_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a password=hunter2x b", 99), (2, None, None), (3, "clean", 5)], "doc_id bigint, text string, n_chars bigint")
    got = [tuple(r) for r in secret_scan.redact(df).orderBy("doc_id").collect()]
    assert got == [(1, "a [SECRET] b", 12), (2, None, None), (3, "clean", 5)]
