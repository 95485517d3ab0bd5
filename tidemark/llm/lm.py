"""Stupid-backoff language-model scores.

Count tables hold how often each n-gram occurs in the corpus, partitioned by a
hash of the n-gram.  Documents are dealt into blocks; a block sends each of
its distinct n-grams once to the partition that counts it, and gets the corpus
counts back in the same order, a byte each where they are small.  Frequent
n-grams thus cross the network once per block.  An n-gram is known by its
partition and 48 bits of its hash.  Scores are then summed per document:

    S(w | h) = c(h w) / c(h)  if h w occurs in another document, else alpha S(w | shorter h)

A document's own occurrences are left out of all counts, so a text does not
vouch for itself; a copy elsewhere does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.llm import common as c

ORDER = 2
ALPHA = 0.4
BLOCK = 2_000
MIX = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64((1 << 48) - 1)


class Hasher:
    """Token and n-gram hashes of texts; word hashes come from a cache of bounded size."""

    LIMIT = 150_000

    def __init__(self, order: int, parts: int):
        self.order, self.parts = order, np.uint64(parts)
        self.seen: dict[str, int] = {}

    def tokens(self, text: str | None) -> np.ndarray:
        seen, out = self.seen, []
        if len(seen) > self.LIMIT:
            seen.clear()
        for w in (text or "").lower().split():
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 1)
            out.append(h)
        return np.array(out, np.uint64)

    def grams(self, text: str | None) -> list[np.ndarray]:
        """The n-grams that end at each token, from one word to ``order`` (shorter at the start): partition above 48 bits of hash."""
        t = self.tokens(text)
        out = [t]
        for n in range(2, self.order + 1):
            prev = out[-1]
            out.append((prev[:-1] * MIX ^ (prev[:-1] >> np.uint64(29))) + t[n - 1:] * np.uint64(2 * n + 1))
        return [(h >> np.uint64(48)) % self.parts << np.uint64(48) | h & LOW for h in out]


def distinct(grams: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a block and their counts."""
    every = [g for gs in grams for g in gs]
    return np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_counts=True)


def shorten(numbers: np.ndarray) -> bytes:
    """Counts in base 128, lowest digits first; a byte below 128 ends a number."""
    sizes = np.ones(len(numbers), np.int64)
    for k in range(1, 9):
        sizes += numbers >= 1 << 7 * k
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        here = sizes > k
        out[starts[here] + k] = (numbers[here] >> 7 * k & 127) | np.where(sizes[here] > k + 1, 128, 0)
    return out.tobytes()


def lengthen(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts)


def text_score(grams: list[np.ndarray], keys: np.ndarray, counts: np.ndarray, total: int, alpha: float) -> float:
    """Sum of log S over the tokens of one text."""
    n = len(grams[0])
    if not n:
        return 0.0
    own_total = n
    others, owns = [], []
    for g in grams:
        u, inverse, own = np.unique(g, return_inverse=True, return_counts=True)
        c_all = counts[np.searchsorted(keys, u)]
        others.append((c_all - own)[inverse])
        owns.append(own)
    rest = max(total - own_total, 1)
    # one word: counted elsewhere, or as if half a time
    logp = np.log(np.maximum(others[0], 0.5) / rest)
    for k in range(1, len(grams)):
        hit, context = others[k], others[k - 1][:-1]
        seen = (hit > 0) & (context > 0)
        tail = math.log(alpha) + logp[k:]
        logp[k:] = np.where(seen, np.log(np.where(seen, hit, 1) / np.where(seen, context, 1)), tail)
    return float(logp.sum())


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, block: int = BLOCK) -> DataFrame:
    """(id, n_tokens, log_score) of every whole text, under the counts of all other documents.

    Tokens are lower-case words between white space.  A null or empty text has
    no token and score 0; repeated rows vouch for each other; an empty table
    gives an empty one.  A task holds one block of documents and the counts
    of its n-grams, or one part of the count table.
    """
    spark = docs.sparkSession
    src = c.only(docs, id=id_col, text=text_col)
    n_docs = src.select("id").count()
    blocks = max(1, math.ceil(n_docs / block), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = min(60_000, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_docs / 4_000)))
    dealt = src.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(order, parts)
        texts: dict[int, list] = {}
        for b in batches:
            for k, t in zip(b.column("block").to_pylist(), b.column("text").to_pylist()):
                texts.setdefault(k, []).append(t)
        for k, ts in texts.items():
            keys, counts = distinct([hasher.grams(t) for t in ts])  # sorted, so by partition
            part = (keys >> np.uint64(48)).astype(np.int32)
            low, high, counts = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), (keys >> np.uint64(32)).astype(np.uint16).view(np.int16), counts.astype(np.int32)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]).astype(np.int32)
            if len(part):
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[cut[:-1]]), pa.array(np.full(len(cut) - 1, k, np.int32)),
                    *[pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (low, high, counts)]], ["part", "block", "low", "high", "counts"])
    ints = T.ArrayType(c.INT)
    asked = dealt.mapInArrow(ask, c.struct(("part", c.INT), ("block", c.INT), ("low", ints), ("high", T.ArrayType(T.ShortType())), ("counts", ints)))
    # the n-grams of all blocks meet the count table in its own partition: one exchange, one sort
    each = asked.repartition(parts, "part").select("part", "block", "high", "counts", F.posexplode("low").alias("at", "low"))
    word = F.shiftleft(F.get("high", F.col("at")).cast("bigint"), 32).bitwiseOR(F.col("low").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    exploded = each.select("part", "block", "at", word.alias("gram"), F.get("counts", F.col("at")).alias("n"))
    joined = exploded.withColumn("total", F.sum("n").over(Window.partitionBy("part", "gram"))).select("block", "part", "at", "total")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of each block's n-grams in the order it asked for them."""
        held = [tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(4)) for b in batches if b.num_rows]
        if held:
            block, part, at, total = (np.concatenate(x) for x in zip(*held))
            held.clear()
            by = np.lexsort((at, part, block))
            block, part, total = block[by], part[by], total[by]
            cut = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(block)]
            for k in range(0, len(cut) - 1, 64):
                some = list(zip(cut[k:k + 64], cut[k + 1:k + 65]))
                yield pa.RecordBatch.from_arrays([pa.array([block[x] for x, _ in some], pa.int32()), pa.array([part[x] for x, _ in some], pa.int32()), pa.array([shorten(total[x:y]) for x, y in some], pa.binary())], ["block", "part", "totals"])
    told = joined.mapInArrow(tell, c.struct(("block", c.INT), ("part", c.INT), ("totals", c.BINARY)))

    def score(_key, mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        hasher = Hasher(order, parts)
        grams = [hasher.grams(t) for t in mine["text"]]
        keys, counts = distinct(grams)
        if len(keys):
            counts = lengthen(b"".join(answers.sort_values("part")["totals"]))
        return pd.DataFrame({"id": mine["id"], "n_tokens": [len(g[0]) for g in grams], "log_score": [text_score(g, keys, counts, corpus, alpha) for g in grams]})
    corpus = int(src.agg(F.sum(n_words(F.col("text")))).first()[0] or 0)
    schema = c.struct(("id", c.column_type(src, "id")), ("n_tokens", c.LONG), ("log_score", c.DOUBLE))
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(score, schema)


def n_words(text: Column) -> Column:
    """Words between white space, as ``str.split`` counts them in a text of the usual white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+")), F.lit(0)).cast("bigint")


def count_table(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(n, gram, total): how often each n-gram occurs in the corpus, by its words."""
    words = F.filter(F.split(F.lower(F.coalesce(c.col(text_col), F.lit(""))), r"(?U)[\s\x1c-\x1f]+"), lambda w: F.length(w) > 0)
    bound = docs.select(words.alias("w")).filter(F.size("w") > 0)

    def grams(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: i <= F.size("w") - n + 1)
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("gram")))
    return bound.select(F.explode(F.concat(*[grams(n) for n in range(1, order + 1)])).alias("g")).groupBy("g.n", "g.gram").agg(F.count("*").alias("total"))
