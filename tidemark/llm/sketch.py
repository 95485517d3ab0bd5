"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the ascending list of the k smallest distinct 64-bit hashes of a
text's five-word shingles.  Sketches of parts merge into the sketch of the
whole; two sketches estimate resemblance and containment; one estimates how
many distinct shingles its text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import common as c

K = 64
WORDS = 5
SPAN = float(1 << 64)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The k smallest shingle hashes; a text of fewer words is one shingle, one without words has none (null: empty).

    The words are bound as a lambda variable, so the text is split once.
    """
    cut = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 0)

    def hashes(ws: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(ws, i, words)))
        return F.when(F.size(ws) > 0, F.slice(F.sort_array(F.array_distinct(every)), 1, k)).otherwise(F.array().cast("array<bigint>"))
    return F.element_at(F.transform(F.array(cut), hashes), 1)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty texts, 0 for one."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + SPAN / 2) / SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    r = resemblance(a, b, k)
    size = distinct_shingles(a, k)
    shared = r * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(shared / size, F.lit(1.0)))


def as_text(a: Column) -> Column:
    """The sketch as hexadecimal digits, 16 per hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merge_parts(parts: DataFrame, by: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group from any number of parts; at most k hashes of a group leave a task."""
    rows = parts.select(*by, F.explode(sketch_col).alias("_h")).distinct()
    w = Window.partitionBy(*by).orderBy("_h")
    low = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    return low.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``_part``: the range of the whole-number ``key`` a row lies in (0 for null).

    The bounds are approximate quantiles, a few per shuffle partition; each row finds its range by bisection.
    """
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] or []))

    bounds = F.array(*map(F.lit, cuts)).cast("array<bigint>")

    def narrow(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.col(key) >= F.get(bounds, mid)
        return F.when(s["lo"] >= s["hi"], s).when(above, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))
    whole = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    part = F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), whole, narrow, lambda s: s["lo"])
    return rows.withColumn("_part", F.when(F.col(key).isNull(), F.lit(0)).otherwise(part))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (id, text, sketch, next_text, next_sketch); the successor by (id, hash of the text), nulls first, the last row's is the first.

    Each range's first row is also sent to the range before it, so one
    exchange of the texts is enough.  The table of first rows has one row per
    range, a number set by the session, and is the only thing broadcast.
    """
    spark = docs.sparkSession
    rows = dealt(docs, "id")
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    heads = rows.groupBy("_part").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "_tie")).alias("m")).orderBy("_part").collect()
    before = [heads[i - 1]["_part"] for i in range(len(heads))]
    first = spark.createDataFrame([(h["_part"], h["m"]["id"], h["m"]["_tie"], to) for h, to in zip(heads, before)], "p int, i bigint, t bigint, _to int")
    marked = rows.withColumn("sketch", sketch(F.col("text"))).join(F.broadcast(first), (F.col("_part") == F.col("p")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("_tie") == F.col("t")), "left")
    homes = F.when(F.col("_to").isNull(), F.array(F.struct(F.lit(0).alias("look"), F.col("_part").alias("part")))).otherwise(
        F.array(F.struct(F.lit(0).alias("look"), F.col("_part").alias("part")), F.struct(F.lit(1).alias("look"), F.col("_to").alias("part"))))
    sent = marked.select("id", "text", "sketch", "_tie", F.explode(homes).alias("h")).select("id", "text", "sketch", "_tie", "h.look", "h.part")
    w = Window.partitionBy("part").orderBy("look", F.col("id").asc_nulls_first(), "_tie")
    return sent.select("id", "text", "sketch", "look", F.lead("text").over(w).alias("next_text"), F.lead("sketch").over(w).alias("next_sketch")).filter("look = 0").drop("look")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edited, sketch, edited_sketch, next_sketch): every whole text, and the text after an edit.

    The edit replaces the last quarter of the code points by the first as many
    of the next document.  Ids are whole numbers; null texts are empty, null
    ids come first, repeated rows follow each other, the only row is its own
    successor, an empty table gives an empty one.
    """
    src = c.only(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(src).withColumn("_cut", F.floor(F.length("text") / 4).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("_cut")), F.substring(F.col("next_text"), F.lit(1), F.col("_cut")))
    return near.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"))).drop("_cut", "next_text")
