"""Near copies by SimHash links, MinHash bands and rare shingles, each verified by the resemblance of whole texts.

Resemblance is the Jaccard similarity of two texts' sets of five-word
shingles.  Texts of one set are one member.

The SimHash index links fingerprints within two bits (``simhash.links``: they
meet in a list of six positional bytes).  Two bits miss many pairs of
resemblance 0.8, and some fingerprints within two bits are of texts that
resemble each other less: every link is verified, and MinHash bands list the
members for what the fingerprints leave apart.  A member is listed under 16
bands of four minima; two members of resemblance 0.8 share a band with
probability 1 - (1 - 0.8^4)^16 = 0.9998, of 0.9 with more than 0.9999999.

Lists are not joined with themselves.  In a few rounds, the first beside the
SimHash links, one member of each list is held against the others, as long as
the links found leave a list apart; a group of copies grows together at a few pairs per member.  Members of lists
that stay apart meet by their rare shingles: in any common order the first
shingle that two sets of resemblance s share has so few before it that the rest
can still hold the overlap they need, so no pair among them is missed, and
texts that share a frequent passage but have a ninth of their own meet nowhere.
Those that meet are compared by 512 parities of each set: every parity in which
two sets differ takes a shingle that only one of them has, so the parities bound
from above what the sets can share, and no pair that resembles is passed over.
Pairs grow with the square of a group only where texts are so near the threshold
that the parities cannot tell (for 150 shingles from about 0.78 on) and still not
linked through others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.llm import common as c, simhash
from tidemark.llm.graph import components, dealt
from tidemark.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Rounds in which a member of each list is held against the others.
ROUNDS = 2
#: A head is held against those of which at most so many of 64 minima, cut to four bits, differ: nine in ten
#: of resemblance 0.8.  What it passes over stays apart and meets by its rare shingles.
UNLIKE = 16
#: Parities kept of a set, a power of two.
CELLS = 512
SLICE = 4096

_rng = np.random.Generator(np.random.Philox(key=[5, 8]))
FLIP = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | _rng.integers(0, 2, BANDS * ROWS, dtype=np.uint64)
FACTOR = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending; one shingle for fewer words, none without words."""
    ws = (text or "").encode("utf-8", "replace").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    line = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(ws) - words + 1)
    starts, ends = starts[:n], ends[-n:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, n))


def bands(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key per band of the minima of a shingle set, and the last four bits of each minimum in four numbers."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(members), SLICE):
        x = (members[k:k + SLICE, None] ^ FLIP) * FACTOR
        np.minimum(low, (x ^ x >> np.uint64(29)).min(axis=0), out=low)
    key = np.zeros(BANDS, np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    bits = (low & np.uint64(15)).reshape(4, -1) << np.arange(0, 64, 4, dtype=np.uint64)
    return key, np.bitwise_or.reduce(bits, axis=1)


def parity(members: np.ndarray) -> np.ndarray:
    """The parities of how many shingles of a set fall in each cell, as longs; two sets' differ in at most as many as their symmetric difference has."""
    cell = (members >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=CELLS) & 1).astype(np.uint8), bitorder="little").view("<i8")


def signatures(df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, fp, member, n, bits, keys): a text's SimHash fingerprint, the hash of its whole shingle set, its size, its short sketch and its band keys."""
    src = c.only(df, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c.held(("resemblance",), object)  # frees what an earlier stage held
        for part in c.small(batches, rows=256):
            fp, member, size, bits, keys = [], [], [], [], []
            for t in part.column("text").to_pylist():
                s = shingles(t, words)
                key, low = bands(s)
                fp.append(simhash.fingerprint(t))
                member.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                size.append(len(s))
                bits.append(low.view(np.int64))
                keys.append(key.view(np.int64) if len(s) else np.zeros(0, np.int64))
            cols = [part.column("row"), part.column("id"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(np.array(member, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["row", "id", "fp", "member", "n", "bits", "keys"])
    return src.mapInArrow(task, c.struct(("row", c.LONG), ("id", c.column_type(src, "id")), ("fp", c.LONG), ("member", c.LONG), ("n", c.LONG), ("bits", T.ArrayType(c.LONG)), ("keys", T.ArrayType(c.LONG))))


def sets(df: DataFrame, rows: DataFrame, words: int, text_col: str) -> DataFrame:
    """(member, s, parity): the shingle sets of the members whose ``row`` is in ``rows`` (row, member), and their parities."""
    src = c.only(df, text=text_col).withColumn("row", F.monotonically_increasing_id()).join(rows, "row").select("member", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c.held(("resemblance",), object)
        for part in c.small(batches, rows=64):
            s = [shingles(t, words) for t in part.column("text").to_pylist()]
            cols = [part.column("member"), pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64())), pa.array([parity(x) for x in s], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["member", "s", "parity"])
    return src.mapInArrow(task, c.struct(("member", c.LONG), ("s", T.ArrayType(c.LONG)), ("parity", T.ArrayType(c.LONG))))


def verified(pairs: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, and whatever else) whose sets resemble each other at least so much."""
    whole = whole.select("member", "s")
    both = pairs.join(whole.withColumnsRenamed({"member": "a", "s": "sa"}), "a").join(whole.withColumnsRenamed({"member": "b", "s": "sb"}), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared) - 1e-9).select(pairs.columns)


def simhash_pairs(docs: DataFrame) -> DataFrame:
    """(a, b, ra, rb), the roots being themselves: members whose fingerprints link in the SimHash index, and members of one fingerprint; one member stands for each fingerprint."""
    prints = docs.filter("n > 0").select("fp", "member").distinct()
    heads = c.written(prints.groupBy("fp").agg(F.min("member").alias("head")))
    same = prints.join(dealt(heads), "fp").select(F.col("member").alias("a"), F.col("head").alias("b"))
    of = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"_{side}"))
    linked = simhash.links(heads.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    both = same.unionByName(linked).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return both.select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb")).distinct()


def alike_in_size(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9


def differing(a: Column, b: Column) -> Column:
    """How many of the 64 minima of two short sketches differ."""
    total = F.lit(0)
    for i in range(4):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        half = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        quarter = half.bitwiseOR(F.shiftrightunsigned(half, 2))
        total = total + F.bit_count(quarter.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def may_share(a: Column, b: Column, n: Column, m: Column) -> Column:
    """At most how many shingles sets of n and m share, by their parities."""
    odd = F.lit(0)
    for i in range(CELLS // 64):
        odd = odd + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return (n + m - odd) / 2


def head_pairs(listed: DataFrame, rounds: int, similarity: float) -> DataFrame:
    """(a, b, ra, rb): members of lists that have two roots beside one of another root, another one in every round, and their roots."""
    order = F.xxhash64(F.lit(rounds), "member") if not rounds else F.xxhash64(F.lit(rounds), "band", "member")
    head = F.min(F.struct(order.alias("h"), "member", "n", "bits", "root")).alias("head")
    heads = listed.groupBy("band", "key").agg(head, F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band", "key", "head")
    met = listed.join(dealt(heads), ["band", "key"]).filter("root <> head.root")
    near = met.filter(alike_in_size(F.col("n"), F.col("head.n"), similarity) & (differing(F.col("bits"), F.col("head.bits")) <= UNLIKE))
    swap = F.col("member") > F.col("head.member")
    ends = [F.when(swap == turn, F.col(f"head.{x}")).otherwise(F.col(x)).alias(to) for x, turn, to in (("member", True, "a"), ("member", False, "b"), ("root", True, "ra"), ("root", False, "rb"))]
    return near.select(ends).distinct()


def rare_pairs(members: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ra, rb, shared): members (member, n, root) of different roots that share one of the rarest shingles of each, and enough of all by their parities.

    Rarity is the number of these members that have the shingle; a shingle of
    one member keeps its place among the rarest but meets nobody.
    """
    has = members.join(whole, "member").select("member", "n", "root", F.explode("s").alias("x"))
    often = has.groupBy("x").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    place = F.row_number().over(Window.partitionBy("member").orderBy("df", "x"))
    # what a set of n must share with one of m or more, m >= n: s / (1 + s) (n + m)
    most = lambda share: F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1
    rare = has.join(often, "x").withColumn("place", place).filter(F.col("place") <= most(similarity)).filter("lo <> hi").select("x", "member", "n", "root", "place")
    rare = rare.join(whole.select("member", "parity"), "member")
    smaller = rare.filter(F.col("place") <= most(2 * similarity / (1 + similarity))).withColumnRenamed("member", "a")
    larger = rare.select("x", *(F.col(k).alias(f"_{k}") for k in ("member", "n", "root", "place", "parity")))
    rest = F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place")) + 1
    most_shared = F.least(rest, may_share(F.col("parity"), F.col("_parity"), F.col("n"), F.col("_n")))
    enough = most_shared >= F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("_n")) - 1e-9
    ordered = (F.col("n") < F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("a") < F.col("_member")))
    met = smaller.join(larger, "x").filter((F.col("root") != F.col("_root")) & ordered & alike_in_size(F.col("n"), F.col("_n"), similarity) & enough)
    return met.groupBy("a", F.col("_member").alias("b"), F.col("root").alias("ra"), F.col("_root").alias("rb")).agg(F.count("*").alias("shared"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(member, root) after the links (ra, rb) between roots."""
    up = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    return cut_lineage(roots.join(up.select(F.col("root").alias("_top"), F.col("node").alias("root")), "root", "left").select("member", F.coalesce("_top", "root").alias("root")))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(row, id, component, kept): the smallest id each document reaches over texts that resemble each other; one kept row per group.

    Texts without words are copies of each other.  Null ids sort last; a group
    without an id has component null; among equal smallest ids the first row is
    kept.  An empty table gives an empty result; other columns are not read.
    Bands are made for a similarity of 0.8 or more.  ``row`` numbers the rows
    of ``df`` as it is read, so ``df`` has to give the same rows in the same
    partitions at each reading: write the result of a shuffle first
    (``common.written``).
    """
    docs = c.written(signatures(df, words, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("null_id"), F.col("id"), F.col("row"))).alias("m")
    distinct = c.written(docs.groupBy("member").agg(first, *(F.first(x).alias(x) for x in ("n", "bits", "keys"))))
    listed = distinct.select("member", F.posexplode("keys").alias("band", "key"))
    several = listed.groupBy("band", "key").agg(F.count("*").alias("_k")).filter("_k > 1").select("band", "key")
    met = c.written(listed.join(several, ["band", "key"]).join(distinct.select("member", "n", "bits"), "member"))
    near = cut_lineage(simhash_pairs(docs))
    some = met.select("member").union(near.select("a")).union(near.select("b")).distinct()
    chosen = c.written(distinct.join(some, "member", "left_semi").select(F.col("m.row").alias("row"), "member"))
    whole = c.written(sets(df, chosen, words, text_col))
    roots = chosen.select("member", F.col("member").alias("root"))
    for k in range(ROUNDS):
        pairs = head_pairs(met.withColumn("root", F.col("member")) if not k else cut_lineage(met.join(roots, "member")), k, similarity)
        pairs = pairs if k else pairs.unionByName(near).distinct()
        roots = joined(roots, verified(pairs, whole, similarity))
    known = met.join(roots, "member")
    apart = known.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band", "key")
    left = cut_lineage(known.join(apart, ["band", "key"], "left_semi").select("member", "n", "root").distinct())
    pairs = cut_lineage(rare_pairs(left, whole, similarity))
    # each member against its likeliest partner of every other group first: those that hold leave few pairs apart
    likely = pairs.groupBy("a", "rb").agg(F.max_by(F.struct("b", "ra"), F.struct("shared", "b")).alias("t")).select("a", "t.b", "t.ra", "rb")
    tops = joined(left.select(F.col("root").alias("member"), "root").distinct(), verified(likely, whole, similarity))
    of = lambda side: tops.select(F.col("member").alias(f"r{side}"), F.col("root").alias(f"_{side}"))
    apart = pairs.join(of("a"), "ra").join(of("b"), "rb").filter("_a <> _b").join(likely, ["a", "b"], "left_anti").select("a", "b", F.col("_a").alias("ra"), F.col("_b").alias("rb"))
    tops = joined(tops, verified(apart, whole, similarity)).select(F.col("member").alias("root"), F.col("root").alias("_top"))
    roots = roots.join(tops, "root", "left").select("member", F.coalesce("_top", "root").alias("root"))
    member = distinct.select("member", "m").join(roots, "member", "left").withColumn("root", F.coalesce("root", "member"))
    least = member.groupBy("root").agg(F.min("m").alias("m"))
    named = member.select("member", "root").join(least, "root").select("member", F.col("m.id").alias("component"), F.col("m.row").alias("_row"))
    return docs.join(named, "member").select("row", "id", "component", (F.col("row") == F.col("_row")).alias("kept"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies, all columns unchanged; ``df`` as in ``groups``."""
    row = "_row"
    while row in df.columns:
        row += "_"
    kept = groups(df, id_col, text_col, words, similarity).filter("kept").select(F.col("row").alias(row))
    return df.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").drop(row)
