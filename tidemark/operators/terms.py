"""Vocabularies and tf-idf rows of word 1-2-grams without a table of all (text, term) pairs.

The words of a text are cut once and kept packed.  Terms are counted in numpy,
a few megabytes of words at a time.  Only the most frequent terms enter a
vocabulary, so a first pass adds up the counts of terms by a hash of the term:
a bucket's sum is at least the count of each of its terms.  Only terms of the
largest buckets are then counted by name.  If they hold too few terms that are
as frequent as the smallest of these buckets, more buckets are taken, in the
end all: the vocabulary is exact whatever the hashes are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import STOP_WORDS
from ..session import cut_lineage
from .selection import top_per_key
from .sparse import blocks, gathered

BUCKETS = 1 << 20  # sums of term counts
STEP = 1 << 22     # bytes of words counted at a time
WIDEN = 4          # buckets looked into for a term that is wanted
EMPTY = ""         # stands between the texts of one key; no word is empty


def plain(df: DataFrame, column: str) -> DataFrame:
    """Lower-case text without combining accents."""
    return df.withColumn(column, F.translate(F.lower(F.col(column)), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"))


def packed_words(df: DataFrame, keys: list[str], text: str, unique: bool = False) -> DataFrame:
    """(keys, _c, _z): the words of every key's texts without stop words, compressed, and the number of its rows.

    A null text has no words.  ``unique`` says that no key comes twice;
    otherwise the texts of a key are put together, which moves no text when
    no key does.
    """
    words = F.regexp_extract_all(F.col("_t"), F.lit(r"(?U)\w\w+"), F.lit(0))
    d = plain(df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_t")), "_t")
    d = d.select(*keys, F.lit(1).cast("long").alias("_c"), F.array_join(F.filter(words, lambda w: ~w.isin(STOP_WORDS)), " ").alias("_t"))
    if not unique:
        twice = cut_lineage(df.groupBy(*keys).count().filter(F.col("count") > 1).select(*[F.col(k).alias(f"__{k}") for k in keys]))
        if not twice.isEmpty():
            same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
            merged = d.join(twice, same, "left_semi").groupBy(*keys).agg(F.sum("_c").alias("_c"), F.array_join(F.collect_list("_t"), f" {EMPTY} ").alias("_t"))
            d = d.join(twice, same, "left_anti").unionByName(merged)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [zlib.compress(t.as_py().encode(), 1) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(z, pa.binary())], names=[*b.schema.names[:-1], "_z"])

    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in [*keys, "_c"])
    return cut_lineage(d.mapInArrow(pack, f"{kinds}, _z binary"))


class Grams:
    """The terms of some texts: entry e says that text ``row[e]`` holds term ``term[e]`` ``tf[e]`` times."""

    def __init__(self, texts: list[str]):
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        code, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        gap = self.words.index(EMPTY).as_py()
        real, n = code != gap, len(self.words)
        near = np.flatnonzero((row[1:] == row[:-1]) & real[1:] & real[:-1])
        pairs, at = np.unique(code[near] * n + code[near + 1], return_inverse=True)
        self.left, self.right, self.size = pairs // n, pairs % n, n + len(pairs)
        entries, self.tf = np.unique(np.concatenate([row[real] * self.size + code[real], row[near] * self.size + n + at]), return_counts=True)
        self.row, self.term = entries // self.size, entries % self.size
        h = pd.util.hash_array(np.asarray(self.words.to_pylist(), dtype=object), categorize=False)
        both = (h[self.left] * np.uint64(0x9E3779B97F4A7C15) + h[self.right]) * np.uint64(0xBF58476D1CE4E5B9)
        self.bucket = (np.concatenate([h, both ^ (both >> np.uint64(29))]) % np.uint64(BUCKETS)).astype(np.int64)

    def names(self, terms: np.ndarray) -> pa.Array:
        """The terms of sorted term numbers."""
        n = len(self.words)
        pair = terms[np.searchsorted(terms, n):] - n
        one = self.words.take(pa.array(terms[:len(terms) - len(pair)]))
        two = pc.binary_join_element_wise(self.words.take(pa.array(self.left[pair])), self.words.take(pa.array(self.right[pair])), pa.scalar(" ", pa.large_string()))
        return pa.concat_arrays([one, two])

    def counts(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, occurrences) of every term in the texts that are inside."""
        w = inside[self.row]
        return np.bincount(self.term, w, self.size), np.bincount(self.term, w * self.tf, self.size)


def steps(batch: pa.RecordBatch) -> Iterator[tuple[slice, Grams]]:
    """The rows of a batch in ranges of about STEP bytes of words; a longer text is a range alone."""
    lo, texts, size = 0, [], 0
    for k, z in enumerate(batch.column(batch.schema.get_field_index("_z"))):
        t = zlib.decompress(z.as_py()).decode()
        if texts and size + len(t) > STEP:
            yield slice(lo, k), Grams(texts)
            lo, texts, size = k, [], 0
        texts.append(t)
        size += len(t)
    if texts:
        yield slice(lo, lo + len(texts)), Grams(texts)


def flags(batch: pa.RecordBatch, name: str | None) -> np.ndarray:
    """(rows x groups): whether a row counts in a group, from an array of booleans; without a column there is one group of all."""
    if name is None:
        return np.ones((batch.num_rows, 1), bool)
    return np.array(batch.column(batch.schema.get_field_index(name)).to_pylist(), bool).reshape(batch.num_rows, -1)


def bucket_sums(packed: DataFrame, inside: str | None, groups: int) -> np.ndarray:
    """(groups x BUCKETS): the occurrences of all terms of a bucket."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((groups, BUCKETS))
        for b in batches:
            member = flags(b, inside)
            for rows, g in steps(b):
                for k in range(groups):
                    total[k] += np.bincount(g.bucket, g.counts(member[rows, k])[1], BUCKETS)
        yield blocks(total.reshape(-1, 1))

    few = packed.coalesce(packed.sparkSession.sparkContext.defaultParallelism)  # a task sends all its sums
    return gathered(few.mapInArrow(partial, "i int, y array<double>"), 1, groups * BUCKETS).reshape(groups, BUCKETS)


def term_counts(packed: DataFrame, inside: str | None, hot: np.ndarray) -> DataFrame:
    """(g, term, df, cf): texts and occurrences of every term of the hot buckets (groups x BUCKETS)."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            member = flags(b, inside)
            for rows, g in steps(b):
                for k in range(len(hot)):
                    if not member[rows, k].any():
                        continue
                    df, cf = g.counts(member[rows, k])
                    pick = np.flatnonzero(hot[k][g.bucket] & (df > 0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), k, np.int32)), g.names(pick).cast(pa.string()), pa.array(df[pick].astype(np.int64)), pa.array(cf[pick].astype(np.int64))], ["g", "term", "df", "cf"])

    return packed.mapInArrow(partial, "g int, term string, df long, cf long").groupBy("g", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def vocabulary(packed: DataFrame, inside: str | None, sizes: list[int], max_features: int, min_df: float, max_df: float) -> list:
    """Rows (g, term, idf), at most ``max_features`` a group: the most frequent terms (ties by term) among those of at
    least ``min_df`` and at most a share ``max_df`` of the group's texts, whose numbers are ``sizes``."""
    sums = bucket_sums(packed, inside, len(sizes))
    taken, n = [WIDEN * max_features] * len(sizes), F.element_at(F.array(*[F.lit(int(s)) for s in sizes]), F.col("g") + 1)
    while True:
        level = [1.0 if t >= np.count_nonzero(s) else max(1.0, np.partition(s, -t)[-t]) for s, t in zip(sums, taken)]
        counts = cut_lineage(term_counts(packed, inside, sums >= np.array(level)[:, None]).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n)))
        least = F.element_at(F.array(*[F.lit(v) for v in level]), F.col("g") + 1)
        enough = {r["g"]: r["n"] for r in counts.groupBy("g").agg(F.count_if(F.col("cf") >= least).alias("n")).collect()}  # one row per group
        short = [k for k, v in enumerate(level) if v > 1 and enough.get(k, 0) < max_features]
        if not short:
            break
        for k in short:
            taken[k] *= 8
    return top_per_key(counts, ["g"], [F.desc("cf"), "term"], max_features).select("g", "term", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf")).collect()


def numbered(vocab: list, groups: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(terms, number, idf): all terms in order, and by group and term its number in the order of the group's terms, or -1."""
    terms = sorted({r["term"] for r in vocab})
    of = {t: u for u, t in enumerate(terms)}
    number, idf = np.full((groups, len(terms)), -1, np.int64), np.zeros((groups, len(terms)))
    for r in vocab:
        number[r["g"], of[r["term"]]], idf[r["g"], of[r["term"]]] = 0, r["idf"]
    for k in range(groups):
        live = np.flatnonzero(number[k] == 0)
        number[k, live] = np.arange(len(live))
    return terms, number, idf


def word_ends(terms: list[str]) -> tuple[pa.Array, pa.Array]:
    """First and last words of the terms of two words."""
    two = [t.split(" ") for t in terms if " " in t]
    return tuple(pa.array(sorted({t[j] for t in two}), pa.large_string()) for j in (0, 1))


def tfidf_vectors(packed: DataFrame, keys: list[str], read: str | None, vocab: list, groups: int, stride: int = 0) -> DataFrame:
    """(keys, _c, g, idx, val): tf-idf of unit length of every row in each group that reads it, term numbers plus ``g * stride``."""
    terms, number, idf = numbered(vocab, groups)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ends = pa.array(terms, pa.large_string()), word_ends(terms)
        for b in batches:
            member = flags(b, read)
            kept = b.select([*keys, "_c"])
            for rows, g in steps(b):
                named = np.flatnonzero(np.bincount(g.term, minlength=g.size))
                one = pc.index_in(g.words, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
                of = np.full(g.size, -1, np.int64)
                of[:len(one)] = one
                # a term of two words is looked up by name, if a term of the vocabulary begins and another ends with them
                pair = named[np.searchsorted(named, len(one)):]
                first, last = (pc.is_in(g.words, value_set=e).to_numpy(zero_copy_only=False) for e in ends)
                pair = pair[first[g.left[pair - len(one)]] & last[g.right[pair - len(one)]]]
                of[pair] = pc.index_in(g.names(pair), value_set=known).fill_null(-1).to_numpy()
                u = of[g.term]
                at = np.flatnonzero(u >= 0)
                at = at[np.argsort(g.row[at] * max(1, len(terms)) + u[at], kind="stable")]
                row, u, tf = g.row[at], u[at], g.tf[at]
                many = rows.stop - rows.start
                for k in range(groups):
                    here = (number[k][u] >= 0) & member[rows, k][row]
                    r, v = row[here], tf[here] * idf[k][u[here]]
                    length = np.sqrt(np.bincount(r, v * v, many))
                    wanted = np.flatnonzero(member[rows, k])
                    size = np.bincount(r, minlength=many)[wanted]
                    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                    idx = pa.ListArray.from_arrays(offsets, pa.array((number[k][u[here]] + k * stride).astype(np.int32)))
                    val = pa.ListArray.from_arrays(offsets, pa.array(v / length[r]))
                    take = kept.take(pa.array(wanted + rows.start))
                    yield pa.RecordBatch.from_arrays([*take.columns, pa.array(np.full(len(wanted), k, np.int32)), idx, val], [*keys, "_c", "g", "idx", "val"])

    kinds = ", ".join(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in [*keys, "_c"])
    return packed.mapInArrow(task, f"{kinds}, g int, idx array<int>, val array<double>")


def tfidf_entries(rows: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, term, tfidf): a row for every entry of (key, idx, val)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(terms, pa.string())
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                idx = b.column(1)
                of = np.repeat(np.arange(b.num_rows), np.diff(idx.offsets.to_numpy()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), names.take(idx.flatten()), b.column(2).flatten()], [key, "term", "tfidf"])

    return rows.select(key, "idx", "val").mapInArrow(task, f"`{key}` {rows.schema[key].dataType.simpleString()}, term string, tfidf double")
