"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

Normalised vectors at cosine s lie sqrt(2 - 2 s) apart.  Each table maps a
vector to ``BITS`` quantised random projections floor((a . x + b) / width);
near vectors fall into one bucket of some table with high probability.  In a
bucket all cosines are computed in double precision, so no link is false.

Equal vectors are one class with a count, so copies never meet each other.  A
bucket of many different vectors is cut into blocks that meet pairwise in
different tasks.  A pair is counted in the first table where it meets, so no
table of pairs is built: tasks send one count and one star edge per vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm import common as c
from tidemark.llm.graph import components
from tidemark.session import cut_lineage

COSINE = 0.93
TABLES = 12
BITS = 8
WIDTH = 2.0
BLOCK = 1024


@lru_cache(8)
def projections(dim: int, tables: int, bits: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(key=[seed, dim]))
    return rng.standard_normal((dim, tables * bits)), rng.uniform(0, width, tables * bits)


def bucket_keys(x: np.ndarray, tables: int, bits: int, width: float, seed: int) -> np.ndarray:
    """(rows x tables) 64-bit bucket numbers of normalised rows."""
    a, b = projections(x.shape[1], tables, bits, width, seed)
    cell = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, bits)
    h = np.full((len(x), tables), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(bits):
        h = (h ^ cell[:, :, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(b, "<f8") for b in raw])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_block(x: np.ndarray, y: np.ndarray | None, kx: np.ndarray, ky: np.ndarray, table: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of a block, or between two blocks, and which of them have not met in an earlier table."""
    cos = x @ (x if y is None else y).T
    i, j = np.nonzero(np.triu(cos >= least, 1) if y is None else cos >= least)
    met = (kx[i, :table] == ky[j, :table]).any(axis=1) if table else np.zeros(len(i), bool)
    return i, j, ~met


def classes(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, h, g, v, ok): the vector as doubles in bytes-comparable form; equal vectors have equal (h, g)."""
    src = c.only(df, vec_id=id_col, v=vec_col, label=label_col).withColumn("v", F.col("v").cast("array<double>"))
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return src.withColumn("ok", F.coalesce(fine, F.lit(False))).withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), F.col("v")))


def links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = COSINE,
          tables: int = TABLES, bits: int = BITS, width: float = WIDTH, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors link when labels are equal, lengths agree and the cosine is at
    least ``least``.  Null, zero-length, zero or non-finite vectors and rows
    without a label or id link with nothing and are their own component.
    Equal vectors under one label link with each other; repeated rows count
    as vectors of their own.
    """
    rows = classes(df, id_col, vec_col, label_col)
    key = ["label", "h", "g"]
    uniq = cut_lineage(rows.filter("ok").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("rep", F.col("rep").cast("bigint")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = b.column("v").to_pylist()
            keys: list[list[int]] = [[]] * len(vs)
            sizes = np.array([len(v) for v in vs], np.int64)
            for d in set(sizes.tolist()):
                at = np.flatnonzero(sizes == d)
                x = np.array([vs[k] for k in at], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for k, row in zip(at, bucket_keys(x, tables, bits, width, seed).tolist()):
                    keys[k] = row
            raw = [(lambda a: (a / np.abs(a).max()).astype("<f8").tobytes())(np.array(v, np.float64)) for v in vs]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("rep"), b.column("n"), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["label", "rep", "n", "d", "x", "keys"])
    schema = T.StructType([uniq.schema["label"], *c.struct(("rep", c.LONG), ("n", c.LONG), ("d", c.LONG), ("x", c.BINARY), ("keys", T.ArrayType(c.LONG))).fields])
    placed = cut_lineage(uniq.select("label", "rep", "n", "v").mapInArrow(place, schema))
    bucket = ["label", "d", "t", "key"]
    light = placed.select("label", "d", "rep", F.posexplode("keys").alias("t", "key"))
    # buckets with one vector have no pair; large ones are cut into blocks by a hash of the id
    sizes = light.groupBy(*bucket).agg(F.count("*").alias("m")).filter("m > 1").withColumn("nb", F.ceil(F.col("m") / block).cast("int")).drop("m")
    own = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    mine = light.join(sizes, bucket).withColumn("own", own)
    met = mine.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("p", F.least("own", "o")).withColumn("q", F.greatest("own", "o")).drop("o", "nb")
    full = met.select("rep", "t", "p", "q", "own", "key").join(placed, "rep")
    order = ["label", "d", "t", "key", "p", "q"]
    dealt = full.repartition(*order).sortWithinPartitions(*order, "rep")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def run(rows: list[tuple]) -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            _, _, t, _, p, q = rows[0][0]
            x, k = unit([r[3] for r in rows]), np.array([r[4] for r in rows], np.int64)
            rep, n, blk = (np.array([r[z] for r in rows], np.int64) for z in (1, 2, 5))
            if p == q:
                i, j, fresh = link_block(x, None, k, k, t, least)
            else:
                a, b = np.flatnonzero(blk == p), np.flatnonzero(blk == q)
                i, j, fresh = link_block(x[a], x[b], k[a], k[b], t, least)
                i, j = a[i], b[j]
            if not len(i):
                return None
            found = np.bincount(i[fresh], n[j[fresh]], len(rows)) + np.bincount(j[fresh], n[i[fresh]], len(rows))
            label = np.arange(len(rows))
            while True:
                new = label.copy()
                np.minimum.at(new, i, label[j])
                np.minimum.at(new, j, label[i])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            out = np.flatnonzero((found > 0) | (label != np.arange(len(rows))))
            return pa.RecordBatch.from_arrays([pa.array(rep[out]), pa.array(found[out].astype(np.int64)), pa.array(rep[label[out]])], ["a", "found", "b"])
        for batch in batches:
            cols = [batch.column(z).to_pylist() for z in (*order, "rep", "n", "x", "keys", "own")]
            for *head, rep, n, x, keys, blk in zip(*cols):
                row = (tuple(head), rep, n, x, keys, blk)
                if held and held[0][0] != row[0]:
                    if (got := run(held)) is not None:
                        yield got
                    held = []
                held.append(row)
        if (got := run(held)) is not None:
            yield got
    got = cut_lineage(dealt.mapInArrow(solve, c.struct(("a", c.LONG), ("found", c.LONG), ("b", c.LONG))))
    count = got.groupBy(F.col("a").alias("rep")).agg(F.sum("found").alias("found"))
    roots = components(got.select("a", "b"))
    answer = uniq.select(*key, "rep", "n").join(count, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        *key, (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"), F.lit(True).alias("ok"))
    out = rows.drop("v").join(answer, [*key, "ok"], "left")
    component = F.coalesce("component_id", F.col("vec_id").cast("bigint"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
