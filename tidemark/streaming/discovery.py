"""Incremental duplicates: an inverted index and a union-find forest that outlive a micro-batch.

The store holds small keyed tables, each cut into partitions by a hash of the
key it is looked up by:

``urls``    address -> the posting that came first and its key
``keys``    key -> label of its node
``pieces``  rare piece -> the keys filed under it, with title and length
``merges``  label that is no longer a root -> the label it was joined to
``order``   piece -> how frequent it was in the first batch; the order in which
            pieces count as rare stays as it was, so old entries stay valid

Batch ``n`` writes its own folder of each and reads only folders before ``n``,
of those the partitions that its own keys fall into.  A retried batch therefore
overwrites its own rows and changes nothing else; no posting's text is read again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import postings as po
from ..operators.joins import dedup_key
from ..session import cut_lineage

TABLES = {
    "postings": "id bigint, source string, title string, company string, location string, apply_url string, first_seen_at date, match_score double, location_bucket string",
    "urls": "apply_url string, uid bigint, key string",
    "keys": "key string, label bigint",
    "pieces": "g string, key string, label bigint, title_key string, size int",
    "merges": "label bigint, root bigint",
    "order": "g string, often bigint",
}
LOOKED_UP_BY = {"urls": "apply_url", "keys": "key", "pieces": "g", "merges": "label"}


def near(a: Column, b: Column, threshold: float) -> Column:
    """Whether two strings are within a relative edit distance; counting stops at the limit."""
    limit = F.floor(F.greatest(F.length(a), F.length(b)) * threshold + 1e-9).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= limit) & (F.call_function("levenshtein", a, b, limit) >= 0)


@dataclass
class Store:
    """Keyed tables of all batches before ``batch``."""
    spark: SparkSession
    folder: str
    batch: int
    parts: int = 32
    tables: dict[str, str] = field(default_factory=lambda: TABLES)
    looked_up_by: dict[str, str] = field(default_factory=lambda: LOOKED_UP_BY)

    def part(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.parts)).cast("int")

    def write(self, name: str, df: DataFrame) -> None:
        by = self.looked_up_by.get(name)
        out = (df.withColumn("part", self.part(F.col(by))).repartition("part").write.partitionBy("part") if by else df.write)
        out.mode("overwrite").parquet(f"{self.folder}/{name}/batch={self.batch}")

    def read(self, name: str) -> DataFrame:
        by = self.looked_up_by.get(name)
        schema = self.tables[name] + ", batch int" + (", part int" if by else "")
        if not self.batch:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").filter(F.col("batch") < self.batch)

    def lookup(self, name: str, wanted: DataFrame) -> DataFrame:
        """Rows of the keys of ``wanted``: only the partitions they fall into are listed and read."""
        by = self.looked_up_by[name]
        return self.touched(name, wanted).drop("part", "batch")

    def touched(self, name: str, wanted: DataFrame) -> DataFrame:
        by = self.looked_up_by[name]
        keys = wanted.select(by).distinct()
        parts = [r[0] for r in keys.select(self.part(F.col(by))).distinct().collect()]  # at most ``parts`` numbers
        return self.read(name).filter(F.col("part").isin(parts)).join(keys, by, "left_semi")

    def newest(self, name: str, wanted: DataFrame | None = None) -> DataFrame:
        """Of a table whose rows replace earlier ones, the last row of each key, or of the keys of ``wanted``."""
        by = self.looked_up_by[name]
        rows = self.read(name) if wanted is None else self.touched(name, wanted)
        values = [c for c in rows.columns if c not in (by, "batch", "part")]
        return rows.groupBy(by).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(by, "_v.*")

    def resolve(self, labels: DataFrame) -> DataFrame:
        """(label, root): the root that each label belongs to now; a step per batch that moved it."""
        at = cut_lineage(labels.select("label").distinct().withColumn("root", F.col("label")))
        while True:
            up = self.lookup("merges", at.select(F.col("root").alias("label"))).select(F.col("label").alias("root"), F.col("root").alias("_up"))
            moved = cut_lineage(at.join(up, "root", "left"))
            if not moved.filter(F.col("_up").isNotNull()).limit(1).count():
                return at
            at = moved.select("label", F.coalesce("_up", "root").alias("root"))


def filed(nodes: DataFrame, order: DataFrame, threshold: float) -> DataFrame:
    """(g, key, label, title_key, size): each key under its rarest pieces, one more than the edits allowed can change.

    Two keys within the distance meet whatever order counts as rare, as long
    as it is the same for both; pieces unknown to ``order`` are the rarest.
    """
    sized = nodes.withColumn("_n", F.length("key")).filter(F.col("_n") > 0)
    allowed = F.floor(F.floor(F.col("_n") / (1 - threshold) + 1e-9) * threshold + 1e-9).cast("int")
    every = po.pieces(sized).join(order.select("g", "often"), "g", "left")
    ranked = every.groupBy("key", "label", "title_key", "_n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g"))).alias("_gs"))
    rare = F.explode(F.slice("_gs", 1, 3 * allowed + 1)).alias("s")
    return ranked.select("key", "label", "title_key", F.col("_n").cast("int").alias("size"), rare).select(F.col("s.g").alias("g"), "key", "label", "title_key", "size")


def links(new: DataFrame, old: DataFrame, threshold: float) -> DataFrame:
    """(a, b): labels of near keys with equal or near titles, at least one of them new."""
    other = new.unionByName(old).select("g", *(F.col(c).alias(f"_{c}") for c in ("key", "label", "title_key", "size")))
    limit = F.greatest("size", "_size") * threshold + 1e-9
    met = new.join(other, "g").filter((F.col("label") != F.col("_label")) & (F.abs(F.col("size") - F.col("_size")) <= limit))
    pairs = met.select("key", "label", "title_key", "_key", "_label", "_title_key").distinct()
    titles = (F.col("title_key") == F.col("_title_key")) | (F.length("title_key") * F.length("_title_key") > 0) & near(F.col("title_key"), F.col("_title_key"), threshold)
    return pairs.filter(near(F.col("key"), F.col("_key"), threshold) & titles).select(F.col("label").alias("a"), F.col("_label").alias("b")).distinct()


def merges(store: Store, found: DataFrame) -> DataFrame:
    """(label, root): roots that stop being roots by the links of a batch; grows with the batch alone."""
    ends = found.select(F.explode(F.array("a", "b")).alias("label"))
    roots = store.resolve(ends)
    of = lambda side: roots.select(F.col("label").alias(side), F.col("root").alias(f"_{side}"))
    pairs = cut_lineage(found.join(of("a"), "a").join(of("b"), "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("rank", F.col("key"))
    joined = po.components(nodes, pairs)
    return joined.filter(F.col("label") < F.col("key")).select(F.col("key").alias("label"), F.col("label").alias("root"))


def add_batch(spark: SparkSession, kept: DataFrame, folder: str, n: int, threshold: float = 0.2) -> None:
    """Files the kept postings of batch ``n`` and joins them to the groups they belong to.

    The posting of an address that arrived first, within a batch the earliest
    one, stands for it.  A null address is an address of its own, shared by all
    postings without one.
    """
    store = Store(spark, folder, n)
    kept = cut_lineage(kept.withColumn("apply_url", F.coalesce("apply_url", F.lit(""))))
    first = kept.groupBy("apply_url").agg(F.min_by(F.struct("id", "title", "company", "location"), F.struct("first_seen_at", "id")).alias("f"))
    fresh = first.join(store.lookup("urls", first).select("apply_url"), "apply_url", "left_anti")
    key = dedup_key(F.col("f.title"), F.col("f.company"), F.col("f.location"))
    fresh = cut_lineage(fresh.select("apply_url", F.col("f.id").alias("uid"), key.alias("key"), dedup_key(F.col("f.title"), F.lit("")).alias("title_key")))
    nodes = fresh.groupBy("key").agg(F.min("uid").alias("label"), F.min("title_key").alias("title_key"))
    nodes = cut_lineage(nodes.join(store.lookup("keys", nodes).select("key"), "key", "left_anti"))
    if n:
        order = store.read("order")
    else:
        order = cut_lineage(po.pieces(nodes.filter(F.length("key") > 0)).groupBy("g").agg(F.count("*").alias("often")))
    rare = cut_lineage(filed(nodes, order, threshold))
    found = cut_lineage(links(rare, store.lookup("pieces", rare), threshold))
    moved = merges(store, found)
    store.write("postings", kept.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in TABLES["postings"].split(", ")]))
    store.write("urls", fresh.drop("title_key"))
    store.write("keys", nodes.select("key", "label"))
    store.write("pieces", rare)
    store.write("merges", moved)
    if not n:
        store.write("order", order)


def canonical(spark: SparkSession, folder: str, batches: int = (1 << 31) - 1) -> DataFrame:
    """Kept postings of all, or the first ``batches``, batches: one row per duplicate group, under its smallest id, with its sources."""
    store = Store(spark, folder, batches)
    urls, keys, up = (store.read(t).drop("part", "batch") for t in ("urls", "keys", "merges"))
    nodes = up.select(F.explode(F.array("label", "root")).alias("key")).distinct().withColumn("rank", F.col("key"))
    roots = po.components(nodes, up.select(F.col("label").alias("a"), F.col("root").alias("b"))).select(F.col("key").alias("label"), F.col("label").alias("root"))
    owned = urls.join(keys, "key").join(roots, "label", "left").withColumn("root", F.coalesce("root", "label"))
    named = cut_lineage(owned.join(owned.groupBy("root").agg(F.min("uid").alias("duplicate_of")), "root").select("apply_url", "duplicate_of"))
    members = cut_lineage(store.read("postings").drop("batch").join(named, "apply_url"))
    return members.filter(F.col("id") == F.col("duplicate_of")).join(po.merge_sources(members, "duplicate_of"), "duplicate_of")
