"""Feed and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feed, postings as po
from ..sources import views
from .cte import APP_LOG, POSTINGS, with_
from .q_joins import applied_log
from .q_postings import APPLIED, PREFS, RULES, now, stored
from .q_returns import rounded
from .q_technical import SPINE, order_days
from .registry import query


def ready(spark, sf):
    s = po.scored(stored(spark, sf), PREFS)
    return s.withColumn("sources", F.concat(F.lit('["'), "source", F.lit('"]')))


FEED = """fd AS (SELECT *, ROUND(0.65::DOUBLE * loc + 0.35::DOUBLE * kw, 4) AS match_score FROM ap WHERE status IN ('new', 'tailored') AND NOT applied AND COALESCE(years, 0) <= 2
  AND contains(lower(concat_ws(' ', title, company, COALESCE(location, ''), '["' || source || '"]')), 'engineer')
  AND date_diff('second', COALESCE(posted_date, first_seen_at)::TIMESTAMP, TIMESTAMP '2001-08-01 12:00:00') / 86400.0 <= 40)"""
ARGS = dict(q="Engineer", max_age_days=40)


@query("feed_query", with_(POSTINGS, APP_LOG, RULES, APPLIED, FEED) + "SELECT id, location_bucket, match_score, ROW_NUMBER() OVER (ORDER BY match_score DESC, first_seen_at DESC, id DESC) - 1 AS place FROM fd")
def _(spark, sf):
    return feed.feed_query(ready(spark, sf), applied_log(spark, sf), PREFS, now(), **ARGS).select("id", "location_bucket", "match_score", "place")


@query("feed_recent", with_(POSTINGS, APP_LOG, RULES, APPLIED, FEED) + """
SELECT id, ROW_NUMBER() OVER (ORDER BY COALESCE(posted_date, first_seen_at) DESC, match_score DESC, first_seen_at DESC, id DESC) - 1 AS place FROM fd""")
def _(spark, sf):
    return feed.feed_query(ready(spark, sf), applied_log(spark, sf), PREFS, now(), sort="recent", **ARGS).select("id", "place")


@query("feed_mix", with_(POSTINGS, APP_LOG, RULES, APPLIED, FEED, """wt AS (SELECT *, CASE location_bucket WHEN 'calgary' THEN 0.5 WHEN 'edmonton' THEN 0.2 WHEN 'remote' THEN 0.15 WHEN 'vancouver' THEN 0.1 WHEN 'seattle' THEN 0.05 END::DOUBLE AS w FROM fd),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY CASE WHEN w IS NULL THEN '' ELSE location_bucket END ORDER BY match_score DESC, id) - 1 AS k FROM wt)""") + """
SELECT id, ROW_NUMBER() OVER (ORDER BY w IS NULL, CASE WHEN w IS NULL THEN k ELSE (k + 0.5::DOUBLE) / w END, location_bucket NULLS FIRST, id) - 1 AS place FROM k""")
def _(spark, sf):
    return feed.feed_query(ready(spark, sf), applied_log(spark, sf), PREFS, now(), sort="mix", **ARGS).select("id", "place")


@query("feed_buckets", with_(POSTINGS, APP_LOG, RULES, APPLIED, FEED) + "SELECT COALESCE(location_bucket, 'off-list') AS bucket, COUNT(*) AS shown FROM fd GROUP BY 1")
def _(spark, sf):
    return feed.feed_buckets(feed.feed_query(ready(spark, sf), applied_log(spark, sf), PREFS, now(), **ARGS))


@query("pace", with_(APP_LOG) + "SELECT COUNT(*) AS total, CAST(date_diff('day', CAST(MIN(ts) AS DATE), DATE '2001-08-06') + 1 AS INT) AS days_active, ROUND(COUNT(*) / (date_diff('day', CAST(MIN(ts) AS DATE), DATE '2001-08-06') + 1), 6) AS per_day FROM app_log")
def _(spark, sf):
    return rounded(feed.pace(views.app_log(spark, sf), F.lit("2001-08-06").cast("date")), [])


@query("heatmap", with_(SPINE, """g AS (SELECT CAST(UNNEST(generate_series((SELECT MIN(day) - CAST(dayofweek(MIN(day)) AS INT) FROM c), DATE '2001-08-11', INTERVAL 1 DAY)) AS DATE) AS day)""") + """
SELECT day, COALESCE(n, 0) AS n, CASE WHEN COALESCE(n, 0) <= 0 THEN 0 WHEN n = 1 THEN 1 WHEN n <= 3 THEN 2 WHEN n <= 5 THEN 3 ELSE 4 END AS level, day > DATE '2001-08-06' AS future FROM g LEFT JOIN c USING (day)""")
def _(spark, sf):
    return feed.heatmap(order_days(spark, sf), F.lit("2001-08-06").cast("date"))


@query("sankey_edges", with_(APP_LOG) + """SELECT COALESCE(platform, 'Unspecified') AS from_node, CASE status WHEN 'applied' THEN 'Awaiting response' WHEN 'interview' THEN 'Interview' WHEN 'offer' THEN 'Offer' END AS to_node, COUNT(*) AS flow FROM app_log GROUP BY 1, 2""")
def _(spark, sf):
    return feed.sankey_edges(views.app_log(spark, sf))


@query("group_counts", with_(APP_LOG) + """SELECT 'platform' AS kind, COALESCE(platform, 'Unspecified') AS name, COUNT(*) AS n FROM app_log GROUP BY 2 UNION ALL SELECT 'status', status, COUNT(*) FROM app_log GROUP BY 2
UNION ALL (SELECT 'company', company, COUNT(*) AS n FROM app_log GROUP BY 2 ORDER BY n DESC, company LIMIT 10)""")
def _(spark, sf):
    log = views.app_log(spark, sf)
    tag = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "n")
    p = tag(feed.groups(log, F.coalesce("platform", F.lit("Unspecified")), "platform"), "platform", "platform")
    s = tag(feed.groups(log, F.coalesce("status", F.lit("applied")), "status"), "status", "status")
    return p.unionByName(s).unionByName(tag(feed.top_companies(log), "company", "company"))


@query("dow_counts", with_(APP_LOG) + """SELECT CAST(i AS INT) AS dow, name AS weekday, COALESCE(n, 0) AS n FROM (VALUES (1, 'Sun'), (2, 'Mon'), (3, 'Tue'), (4, 'Wed'), (5, 'Thu'), (6, 'Fri'), (7, 'Sat')) d(i, name)
LEFT JOIN (SELECT dayofweek(ts) + 1 AS i, COUNT(*) AS n FROM app_log GROUP BY 1) c USING (i)""")
def _(spark, sf):
    return feed.weekday_counts(views.app_log(spark, sf))
