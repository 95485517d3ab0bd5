"""SimHash near duplicates through an inverted index on byte positions.

A 64-bit fingerprint is a set of eight (position, byte) items.  Fingerprints
that differ in at most two bits share at least six of the eight.  The index
therefore lists fingerprints under every choice of six positional bytes (28
keys): a pair reaches the guaranteed minimum of matches exactly if it meets in
a list.  In a list, shared positional bytes are tallied for its members,
pairs with six or more are kept and verified bit by bit.  A list has six bytes
fixed, so it holds at most 65,536 fingerprints whatever the data; a list of
copies is one member, since only distinct fingerprints are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import common as c
from tidemark.llm.graph import components
from tidemark.session import cut_lineage

WORDS = 3
DISTANCE = 2
SEED = 42
#: Shared positional bytes that two linked fingerprints have at least.
MATCHES = 8 - DISTANCE
SLICE = 200_000


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half the hashes of the text's three-word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= WORDS:
        starts, ends = starts[:len(words) - WORDS + 1], ends[WORDS - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), SLICE):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k:k + SLICE].tolist(), ends[k:k + SLICE].tolist())], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, fp): the fingerprint of every whole text as a signed long; row numbers equal ids apart."""
    src = c.only(df, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(fp, pa.int64())], ["row", "id", "fp"])
    return src.mapInArrow(task, c.struct(("row", c.LONG), ("id", c.column_type(src, "id")), ("fp", c.LONG)))


def masks() -> list[int]:
    """The signed mask of each choice of positional bytes."""
    out = []
    for chosen in combinations(range(8), MATCHES):
        m = sum(0xFF << 8 * p for p in chosen)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def star(members: np.ndarray) -> np.ndarray:
    """For each fingerprint of a list the smallest member it is linked with through the list."""
    n = len(members)
    label = np.arange(n)
    u = members.view(np.uint64)
    if n <= 1024:
        x = u[:, None] ^ u[None, :]
        shared = (x.view(np.uint8).reshape(n, n, 8) == 0).sum(axis=2)
        near = (shared >= MATCHES) & (np.bitwise_count(x) <= DISTANCE)
        while True:
            new = np.where(near, label[None, :], n).min(axis=1)
            new = new[new]
            if (new == label).all():
                return members[label]
            label = new
    # all but two bytes are equal: look the at most 136 neighbours of each up in a table of the two
    free = np.flatnonzero((u.view(np.uint8).reshape(n, 8) != u[:1].view(np.uint8)).any(axis=0))
    low = u.view(np.uint8).reshape(n, 8)[:, free].astype(np.int64)
    at = low[:, 0] | (low[:, 1] << 8 if low.shape[1] > 1 else 0)
    bits = [1 << i for i in range(16)]
    flips = [*bits, *(a | b for a, b in combinations(bits, 2))]
    table = np.full(1 << 16, n)
    while True:
        table[at] = label
        new = label.copy()
        for f in flips:
            np.minimum(new, table[at ^ f], out=new)
        new = new[new]
        if (new == label).all():
            return members[label]
        label = new


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect every two within the distance; few per list, not all pairs."""
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks()])).alias("c", "key"))
    lists = keyed.repartition("c", "key").sortWithinPartitions("c", "key", "fp")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(cc: np.ndarray, key: np.ndarray, fp: np.ndarray) -> list[pa.RecordBatch]:
            change = np.flatnonzero((cc[1:] != cc[:-1]) | (key[1:] != key[:-1])) + 1
            first, last = np.concatenate([[0], change]), np.concatenate([change, [len(fp)]])
            a, b = [], []
            two = first[last - first == 2]
            near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= DISTANCE
            a.append(fp[two + 1][near])
            b.append(fp[two][near])
            for k in np.flatnonzero(last - first > 2):
                run = fp[first[k]:last[k]]
                root = star(run)
                moved = root != run
                a.append(run[moved])
                b.append(root[moved])
            x, y = np.concatenate(a), np.concatenate(b)
            return [pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])] if len(x) else []
        for batch in batches:
            now = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("c", "key", "fp")]
            if held:
                now = [np.concatenate([h, x]) for h, x in zip(held, now)]
            cc, key, fp = now
            if not len(fp):
                continue
            same = (cc == cc[-1]) & (key == key[-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = [x[cut:].copy() for x in now]
            if cut:
                yield from solve(cc[:cut], key[:cut], fp[:cut])
        if held and len(held[2]):
            yield from solve(*held)
    return lists.mapInArrow(task, c.struct(("a", c.LONG), ("b", c.LONG)))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, fp, component, kept): the smallest id each document reaches by links, and one kept row per group.

    Null, empty and blank texts have fingerprint 0 and are linked like any
    other.  Null ids sort last; a group without an id has component null.
    Among equal smallest ids the first row is kept.  An empty table gives an
    empty result; other columns are not read.
    """
    docs = cut_lineage(fingerprints(df, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("row"))).alias("m")
    distinct = cut_lineage(docs.groupBy("fp").agg(first))
    roots = components(links(distinct.select("fp")))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("m").alias("m"))
    named = member.select("fp", "root").join(least, "root").select("fp", F.col("m.id").alias("component"), F.col("m.row").alias("_row"))
    return docs.join(named, "fp").select("row", "id", "fp", "component", (F.col("row") == F.col("_row")).alias("kept"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, all columns unchanged.

    ``df`` has to give the same rows in the same partitions at each reading:
    write the result of a shuffle first (``common.written``).
    """
    row = "_row"
    while row in df.columns:
        row += "_"
    kept = groups(df, id_col, text_col).filter("kept").select(F.col("row").alias(row))
    return df.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").drop(row)
