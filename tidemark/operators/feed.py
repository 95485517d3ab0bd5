"""The ranked feed and the dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import sorted_positions

# Fixed values.
ACTIVE_STATUSES = ("new", "queued", "generating", "tailored")
OUTCOME_LABELS = {"applied": "Awaiting response", "interview": "Interview", "offer": "Offer",
                  "rejected": "Rejected", "ghosted": "No response"}
WEEKDAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def weighted_mix(df: DataFrame, weights: dict[str, float], bucket: str, score: str, key: str) -> DataFrame:
    """Interleave buckets in proportion to their weights.

    The k-th best row of a bucket stands at (k + 0.5) / weight; rows of an
    unknown bucket follow by score.  Both numberings are distributed sorts.
    """
    w = F.coalesce(*[F.when(F.col(bucket) == b, F.lit(float(v))) for b, v in weights.items() if v])
    df = df.withColumn("_w", w).withColumn("_g", F.when(F.col("_w").isNull(), "").otherwise(F.col(bucket)))
    ranked = sorted_positions(df, ["_g"], [F.desc_nulls_last(score), key], "_k", "_n")
    at = F.when(F.col("_w").isNull(), F.col("_k").cast("double")).otherwise((F.col("_k") + 0.5) / F.col("_w"))
    ranked = ranked.withColumn("_late", F.col("_w").isNull()).withColumn("_at", at)
    placed = sorted_positions(ranked, [], ["_late", "_at", bucket, key], "place", "_m")
    return placed.drop("_w", "_g", "_k", "_n", "_late", "_at", "_m")


def groups(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def top_companies(df: DataFrame, n: int = 10) -> DataFrame:
    return groups(df, F.col("company"), "company").orderBy(F.desc("n"), "company").limit(n)


def sankey_edges(df: DataFrame) -> DataFrame:
    label = F.coalesce(*[F.when(F.col("status") == s, v) for s, v in OUTCOME_LABELS.items()], F.col("status"))
    return (df.groupBy(F.coalesce("platform", F.lit("Unspecified")).alias("from_node"), label.alias("to_node"))
            .agg(F.count("*").alias("flow")))


def weekday_counts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Counts per weekday with all seven present."""
    counts = df.groupBy(F.dayofweek(ts).alias("dow")).agg(F.count("*").alias("n"))
    days = df.sparkSession.createDataFrame([(i + 1, d) for i, d in enumerate(WEEKDAYS)], "dow int, weekday string")
    return days.join(counts, "dow", "left").select("dow", "weekday", F.coalesce("n", F.lit(0)).alias("n"))


def pace(df: DataFrame, today: Column, ts: str = "ts") -> DataFrame:
    days = F.datediff(today, F.to_date(F.min(ts))) + 1
    return df.agg(F.count("*").alias("total"), days.alias("days_active"), (F.count("*") / days).alias("per_day"))


def heatmap(counts: DataFrame, today: Column, day: str = "day", n: str = "n") -> DataFrame:
    """Zero-filled cells from the Sunday before the first day to the week end."""
    span = counts.agg(F.min(day).alias("_a"))
    start = F.date_sub("_a", F.dayofweek("_a") - 1)
    end = F.date_add(today, 7 - F.dayofweek(today))
    cells = span.select(F.explode(F.sequence(start, end)).alias(day)).join(counts, day, "left")
    c = F.coalesce(F.col(n), F.lit(0))
    level = F.when(c <= 0, 0).when(c == 1, 1).when(c <= 3, 2).when(c <= 5, 3).otherwise(4)
    return cells.select(day, c.alias(n), level.alias("level"), (F.col(day) > today).alias("future"))


def bucket_counts(df: DataFrame, bucket: str, active: Column) -> DataFrame:
    return (df.filter(active).groupBy(F.coalesce(bucket, F.lit("unknown")).alias("bucket"))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket"))


def feed_query(postings: DataFrame, applied: DataFrame, prefs, now: Column, *, status: str = "active", buckets: list[str] = (), q: str = "",
               sort: str = "score", max_age_days: float | None = None, hide_applied: bool = True) -> DataFrame:
    """The ranked feed: filters, then a place by score, mix or newest."""
    from ..functions.dates import is_fresh, stamp
    from .joins import anti_applied
    from .postings import max_years
    df = postings
    if status == "active":
        df = df.filter(F.col("status").isin(*ACTIVE_STATUSES))
    elif status == "all":
        df = df.filter(F.col("status") != "archived")
    else:
        df = df.filter(F.col("status") == status)
    hide = hide_applied and status not in ("applied", "archived")
    if hide:
        df = df.filter(F.col("status") != "applied")
    if buckets:
        df = df.filter(F.col("location_bucket").isin(*buckets))
    if q.strip():
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        text = F.lower(F.concat_ws(" ", *[blank(c) for c in ("title", "company", "location", "sources")]))
        df = df.filter(F.contains(text, F.lit(q.strip().lower())))
    if max_age_days and max_age_days > 0:
        df = df.filter(is_fresh(F.col("posted_date"), F.col("first_seen_at"), now, max_age_days))
    df = df.filter(~F.coalesce(max_years(F.col("description")) > prefs.experience_cap, F.lit(False)))
    if hide:
        df = anti_applied(df, applied)
    if sort == "mix":
        return weighted_mix(df, dict(prefs.location_weights), "location_bucket", "match_score", "id")
    if sort == "recent":
        df = df.withColumn("_t", F.coalesce(stamp(F.col("posted_date")), stamp(F.col("first_seen_at"))))
        order = [F.desc_nulls_last("_t"), F.desc_nulls_last("match_score"), F.desc("first_seen_at"), F.desc("id")]
    else:
        order = [F.desc_nulls_last("match_score"), F.desc("first_seen_at"), F.desc("id")]
    return sorted_positions(df, [], order, "place", "shown").drop("_t", "shown")


def feed_buckets(feed: DataFrame) -> DataFrame:
    """Rows shown per bucket; a stated but unmatched location is off-list."""
    return feed.groupBy(F.coalesce("location_bucket", F.lit("off-list")).alias("bucket")).agg(F.count("*").alias("shown"))
