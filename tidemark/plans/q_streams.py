"""State and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import TRANSITIONS
from ..operators import lifecycle as lc
from ..operators import postings as po
from ..sources import views
from ..sources.tables import table
from ..streaming import discovery, jobs
from .cte import APP_LOG, POSTINGS, STATUS_EVENTS, with_
from .q_joins import applied_log
from .q_postings import APPLIED, KEY, NEAR, PREFS, RULES, TITLE, now
from .q_sources import scratch
from .registry import query

HEALTH = """WITH l AS (SELECT user_id, MAX((ts, event_id)) FILTER (event_type <> 'error') AS last FROM events GROUP BY 1),
c AS (SELECT user_id, COUNT(*) FILTER (event_type = 'error' AND (last IS NULL OR (ts, event_id) > last)) AS retry_count FROM events JOIN l USING (user_id) GROUP BY 1)
SELECT user_id, retry_count, CASE WHEN retry_count = 0 THEN 'ok' WHEN retry_count >= 3 THEN 'permanent-fail' ELSE 'render-failed' END AS status FROM c"""


def outcomes(df):
    return df.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))


@query("source_health", HEALTH)
def _(spark, sf):
    return lc.health_state(lc.health_delta(outcomes(table(spark, sf, "events")), "user_id", "ok", ["ts", "event_id"]), None, "user_id")


def landings(spark, df, order: str, parts: int, folder: str):
    """Writes a table's parts into a folder one after another, in order of a column; yields after each."""
    cuts = df.select(F.expr(f"percentile_approx({order}, array({', '.join(str((i + 1) / parts) for i in range(parts - 1))}))")).first()[0]
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        part = df
        if lo is not None:
            part = part.filter(F.col(order) > F.lit(lo))
        if hi is not None:
            part = part.filter(F.col(order) <= F.lit(hi))
        part.write.mode("append").parquet(folder)
        yield folder


def landed(spark, df, order: str, parts: int, name: str):
    """The table as files that have landed in order of a column."""
    folder = scratch(spark, name)
    for _ in landings(spark, df, order, parts, folder):
        pass
    return folder


@query("stream_source_health", HEALTH)
def _(spark, sf):
    e = outcomes(table(spark, sf, "events"))
    state, checkpoint = scratch(spark, "health-state"), scratch(spark, "health-ckpt")
    for folder in landings(spark, e, "event_id", 3, scratch(spark, "health-in")):
        jobs.source_health(jobs.file_stream(spark, folder, e.schema), "user_id", "ok", ["ts", "event_id"], state, checkpoint)
    return jobs.health_store(spark, state, "user_id", e.schema["user_id"].dataType.simpleString()).newest("health")


MOVES = "tr AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, to in TRANSITIONS.items() for b in to) + ") v(a, b))"


@query("status_machine", "WITH RECURSIVE " + STATUS_EVENTS + ", " + MOVES + """, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY ts, event_id) AS k FROM status_events),
m AS (SELECT id, k, event_id, 'new' AS before, to_status, EXISTS (SELECT 1 FROM tr WHERE a = 'new' AND b = to_status) AS legal FROM o WHERE k = 1
  UNION ALL SELECT o.id, o.k, o.event_id, CASE WHEN m.legal THEN m.to_status ELSE m.before END, o.to_status,
    (CASE WHEN m.legal THEN m.to_status ELSE m.before END, o.to_status) IN (SELECT (a, b) FROM tr) FROM m JOIN o ON o.id = m.id AND o.k = m.k + 1)
SELECT id, event_id, before AS from_status, to_status, legal FROM m""")
def _(spark, sf):
    m = lc.status_machine(views.status_events(spark, sf), "id", ["ts", "event_id"])
    return m.select("id", "event_id", "from_status", "to_status", "legal")


@query("transition_counts", with_(STATUS_EVENTS, MOVES, "l AS (SELECT LAG(to_status) OVER (PARTITION BY id ORDER BY ts, event_id) AS f, to_status AS t FROM status_events)") + """
SELECT f AS from_status, t AS to_status, COUNT(*) AS n, (f, t) IN (SELECT (a, b) FROM tr) AS legal FROM l WHERE f IS NOT NULL GROUP BY f, t""")
def _(spark, sf):
    return lc.transition_counts(views.status_events(spark, sf), "id", ["ts", "event_id"])


@query("ingest_checkpoint", """WITH l AS (SELECT user_id, ARG_MAX(CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END, event_id) AS s FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM l WHERE s = 'done')""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    s = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return lc.pending_ids(e, e.filter(F.col("event_id") % 3 == 0).withColumn("status", s), "user_id", ["event_id"])


INGEST = f"""ok AS (SELECT * FROM ap WHERE reason IS NULL AND NOT applied), fu AS (SELECT *, FIRST_VALUE(id) OVER (PARTITION BY apply_url ORDER BY first_seen_at, id) AS uid FROM ok),
nk AS (SELECT {KEY} AS key, MIN(id) AS rank, MIN({TITLE}) AS t FROM fu WHERE id = uid GROUP BY 1),
pr AS (SELECT a.rank AS a, b.rank AS b FROM nk a, nk b WHERE {NEAR}),
rc(a, b) AS (SELECT a, b FROM pr UNION SELECT rc.a, pr.b FROM rc JOIN pr ON rc.b = pr.a), gr AS (SELECT a AS rank, MIN(b) AS root FROM rc GROUP BY a),
rt AS (SELECT fu.id AS uid, root FROM fu JOIN nk ON nk.key = {KEY} JOIN gr USING (rank) WHERE fu.id = fu.uid), mm AS (SELECT fu.*, root FROM fu JOIN rt USING (uid)),
sr AS (SELECT root, source, MIN((first_seen_at, id)) AS o FROM mm GROUP BY root, source), fin AS (SELECT root AS id, string_agg(source, ',' ORDER BY o) AS sources FROM sr GROUP BY root)"""
INGEST_SQL = "WITH RECURSIVE " + ",\n".join((POSTINGS, APP_LOG, RULES, APPLIED, INGEST)) + " SELECT id, sources FROM fin"


@query("discovery_run", INGEST_SQL)
def _(spark, sf):
    kept, _report = po.ingest(views.postings(spark, sf), applied_log(spark, sf), PREFS, now())
    return kept.select("id", F.array_join("sources", ",").alias("sources"))


@query("stream_ingest", INGEST_SQL)
def _(spark, sf):
    p = views.postings(spark, sf)
    store, checkpoint = scratch(spark, "ingest-store"), scratch(spark, "ingest-ckpt")
    for folder in landings(spark, p, "first_seen_at", 2, scratch(spark, "ingest-in")):
        jobs.ingest_stream(jobs.file_stream(spark, folder, p.schema), applied_log(spark, sf), PREFS, now(), store, checkpoint)
    return discovery.canonical(spark, store).select("id", F.array_join("sources", ",").alias("sources"))


@query("stream_daily", """WITH w AS (SELECT MAX(ts) - INTERVAL 10 MINUTE AS wm FROM events), d AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1),
k AS (SELECT s.day, ROUND(SUM(d.n) / 7, 6) AS rolling FROM (SELECT DISTINCT CAST(UNNEST(generate_series(day, day + 6, INTERVAL 1 DAY)) AS DATE) AS day FROM d) s JOIN d ON d.day <= s.day AND d.day > s.day - 7 GROUP BY s.day)
SELECT k.day, n, rolling FROM k JOIN d USING (day), w WHERE k.day + 1 <= wm""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    folder = landed(spark, e, "event_id", 3, "daily-in")
    daily, weekly = jobs.windowed_counts(jobs.file_stream(spark, folder, e.schema), "ts")
    outs = [scratch(spark, n) for n in ("daily-out", "weekly-out")]
    for stream, out in zip((daily, weekly), outs):
        jobs.append_to(stream, out, scratch(spark, "daily-ckpt"))
    return spark.read.parquet(outs[0]).join(spark.read.parquet(outs[1]), "day").select("day", "n", F.round("rolling", 6).alias("rolling"))
