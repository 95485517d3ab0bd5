"""The landed tables in the shapes the operators work on.

``bars`` tables end up with one row per (key, calendar day): whatever the size
of the fact table, a key's history is bounded by the calendar, which is what
lets the time-series operators use windows partitioned by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .tables import table, text_table

GRID_START, GRID_END, GRID_STEP = "1999-01-04", "2001-08-06", 7


def _vwap() -> Column:
    return F.sum("l_extendedprice") / F.sum("l_quantity")


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars per symbol.  The sums combine on the map side, so the only
    large exchange is the join of the fact table with its dimension."""
    li = table(spark, folder, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .groupBy(F.col("p_type").alias("symbol"), F.to_date("l_shipdate").alias("date"))
            .agg(_vwap().alias("adj_close"), F.sum("l_quantity").alias("volume")))


def indices(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of the whole market and of three slices, in one pass."""
    li = table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity", "l_shipdate")
    daily = (li.groupBy("l_returnflag", F.to_date("l_shipdate").alias("date"))
             .agg(F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("qty")))
    key = (F.when(F.col("l_returnflag") == "A", "rut").when(F.col("l_returnflag") == "R", "iwd").otherwise("iwf"))
    return (daily.select(F.explode(F.array(F.lit("gspc"), key)).alias("index_key"), "date", "value", "qty")
            .groupBy("index_key", "date").agg((F.sum("value") / F.sum("qty")).alias("adj_close")))


def market(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").select("l_extendedprice", "l_quantity", "l_shipdate")
    return li.groupBy(F.to_date("l_shipdate").alias("date")).agg(_vwap().alias("adj_close"))


def _month(c: str) -> Column:
    return F.to_date(F.date_trunc("month", c))


def risk_free(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").select("l_shipdate", "l_discount")
    return li.groupBy(_month("l_shipdate").alias("date")).agg(F.avg("l_discount").alias("rate"))


def macro_series(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").select("l_returnflag", "l_shipdate", "l_tax")
    return (li.groupBy(F.col("l_returnflag").alias("series_id"), _month("l_shipdate").alias("date"))
            .agg(F.when(F.month(F.min("l_shipdate")) == 5, ".")
                 .otherwise(F.round(F.avg("l_tax") * 100, 4).cast("string")).alias("value")))


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Dated news and community documents per symbol."""
    d = text_table(spark, folder, "documents")
    symbols = F.array(*[F.lit(s) for s in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")])
    return d.select(
        "doc_id",
        F.element_at(symbols, (F.col("doc_id") % 6 + 1).cast("int")).alias("symbol"),
        F.date_add(F.lit("1999-01-01").cast("date"), ((F.col("doc_id") * 37) % 970).cast("int")).alias("published"),
        F.substring("text", 1, 80).alias("title"), "text", "source", "lang",
        F.when(F.col("doc_id") % 4 == 0, "community").otherwise("news").alias("kind"),
        F.when(F.col("doc_id") % 9 != 0,
               F.concat(F.lit("https://"), "source", F.lit("/"), (F.col("doc_id") % 700).cast("string"),
                        F.lit("?utm="), "lang")).alias("url"),
        ((F.col("n_chars") % 21).cast("double") - 10).alias("score"))


def app_log(spark: SparkSession, folder: str) -> DataFrame:
    """Application log: one row per logged application."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = table(spark, folder, "customer").select("c_custkey", "c_name")
    key = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        key.alias("id"), F.concat(F.lit("Role "), (key % 50).cast("string")).alias("title"),
        F.col("c_name").alias("company"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("platform"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", "offer").when(F.col("o_orderstatus") == "P", "interview")
        .otherwise("applied").alias("status"),
        F.concat(F.lit("https://jobs.example/"), key.cast("string")).alias("url"))


def _pick(key: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """Template postings, phrases chosen by key."""
    p = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    key = F.col("p_partkey")
    anchor = F.lit("2001-08-01").cast("date")
    return p.select(
        key.alias("id"), F.lower("p_brand").alias("source"), F.concat("p_type", F.lit(" Corp")).alias("company"),
        _pick(key, ["Senior Software Engineer", "Software Engineer, New Grad", "ML Research Engineer",
                    "Customer Support Associate", "Data Engineer (Jan 2027)", "New Graduate Rotational Program",
                    "Backend Developer"]).alias("title"),
        _pick(key, ["Calgary, AB", "Remote", "Seattle, WA", "Vancouver, WA", "Vancouver, BC", None,
                    "Toronto, ON", "Calgary, AB / Remote"]).alias("location"),
        _pick(key, ["Requires 3+ years of experience with Python and Spark.",
                    "This is a hybrid role, 3 days per week in the office.",
                    "Fully remote within Canada. 1-2 years experience.",
                    "Must be located in the US. No sponsorship mentioned? We offer visa sponsorship.",
                    "US only. Ten years in business.", "Entry level, SQL and Kafka."]).alias("description"),
        F.concat(F.lit("https://boards.example/"), (key % 150).cast("string"), F.lit("?gh_src="),
                 F.col("p_size").cast("string")).alias("apply_url"),
        F.when(key % 11 != 0, F.date_sub(anchor, F.col("p_size"))).alias("posted_date"),
        F.date_sub(anchor, (key % 90).cast("int")).alias("first_seen_at"))


def participants(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (match, seat); a match has at most ten seats by its schema."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    seats = (li.join(part, li.l_partkey == part.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
             .select(F.col("l_orderkey").alias("match_id"), F.row_number().over(w).alias("seat"),
                     F.col("p_brand").alias("champion"), F.col("l_suppkey").alias("item_id"),
                     F.col("l_extendedprice").alias("gold"), F.col("o_orderdate").alias("start_ts")))
    odd = F.col("seat") % 2 == 1
    return seats.select(
        "match_id", "seat", F.when(odd, 100).otherwise(200).alias("team_id"),
        F.floor((F.col("seat") - 1) / 2).cast("int").alias("role"), "champion", "item_id", "gold", "start_ts",
        F.when((F.col("match_id") % 3 == 0) == odd, 1).otherwise(0).alias("win"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Binary labels with a probability that knows nothing about them."""
    return table(spark, folder, "labels").select(
        "doc_id", F.col("quality").alias("y"), (((F.col("doc_id") * 7919) % 1000).cast("double") / 1000).alias("p"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", (F.col("event_id") % 5).cast("int").alias("fold"), (F.col("value") - 100).alias("y"),
        (((F.col("event_id") * 31) % 201).cast("double") - 100).alias("p"))


def status_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    to = (F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "generating")
          .when(F.col("event_type") == "click", "tailored").when(F.col("event_type") == "purchase", "applied")
          .otherwise("rejected"))
    return e.select("event_id", F.col("user_id").alias("id"), "ts", to.alias("to_status"))
