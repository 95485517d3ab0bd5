"""As-of windows, grids and filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import windows as win
from ..operators.ranking import strided_sample
from ..operators.selection import first_source
from ..functions.dates import is_fresh
from ..sources import views
from ..sources.tables import table
from .cte import DOCS, GRID, PRICES, with_
from .registry import query

WEEKLY = win.Grid.of(views.GRID_START, views.GRID_END, views.GRID_STEP)
MONTHLY = win.Grid.of(views.GRID_START, views.GRID_END, 28)
TODAY = date(2001, 8, 6)
GRID28 = "grid AS (SELECT CAST(DATE '1999-01-04' + CAST(28 * i AS INT) AS DATE) AS as_of FROM generate_series(0, 33) t(i))"


def r(c, digits=6):
    return F.round(c, digits)


@query("clip_window", """
SELECT event_id, user_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'""")
def _(spark, sf):
    return win.clip(table(spark, sf, "events"), "ts", "2024-01-08", "2024-01-15").select("event_id", "user_id", "event_type")


@query("clip_window_bars", with_(PRICES) + """
SELECT symbol, date, ROUND(adj_close, 9) AS adj_close FROM prices
WHERE date >= DATE '1999-01-04' AND date < DATE '1999-07-04'""")
def _(spark, sf):
    return win.clip(views.prices(spark, sf), "date", "1999-01-04", "1999-07-04").select(
        "symbol", "date", r(F.col("adj_close"), 9).alias("adj_close"))


@query("shift_months", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS back_1,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 6 MONTH AS DATE) AS ahead_6,
       CAST(CAST(o_orderdate AS DATE) - INTERVAL 60 MONTH AS DATE) AS back_60 FROM orders""")
def _(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", win.shift_months(d, -1).alias("back_1"),
                                             win.shift_months(d, 6).alias("ahead_6"),
                                             win.shift_months(d, -60).alias("back_60"))


def as_of_days(spark, sf):
    """As-of dates taken from the data: every order day."""
    return table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("as_of")).distinct()


ASOF = "a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of FROM orders)"


@query("window_spec", with_(ASOF) + """
SELECT as_of, name, CAST(s AS DATE) AS start, CAST(e AS DATE) AS "end", CAST(date_diff('day', s, e) AS INT) AS days FROM (
  SELECT as_of, 'prices_equity' AS name, CAST(as_of - INTERVAL 60 MONTH AS DATE) AS s, as_of AS e FROM a
  UNION ALL SELECT as_of, 'prices_index', CAST(as_of - INTERVAL 24 MONTH AS DATE), as_of FROM a
  UNION ALL SELECT as_of, 'news_baseline', CAST(as_of - INTERVAL 12 MONTH AS DATE), CAST(as_of - INTERVAL 2 MONTH AS DATE) FROM a
  UNION ALL SELECT as_of, 'news_recent', CAST(as_of - INTERVAL 2 MONTH AS DATE), as_of FROM a
  UNION ALL SELECT as_of, 'macro', CAST(as_of - INTERVAL 6 MONTH AS DATE), as_of FROM a)""")
def _(spark, sf):
    return win.window_spec(as_of_days(spark, sf))


@query("label_window", with_(ASOF) + """
SELECT as_of, as_of AS start, CAST(as_of + 34 AS DATE) AS "end" FROM a WHERE as_of + 34 <= DATE '2001-08-06'""")
def _(spark, sf):
    return win.label_window(win.labellable(as_of_days(spark, sf), today=TODAY))


@query("as_of_grid", with_("span AS (SELECT MIN(CAST(l_shipdate AS DATE)) AS a, MAX(CAST(l_shipdate AS DATE)) AS b FROM lineitem)") + """
SELECT as_of FROM (SELECT CAST(a + CAST(7 * i AS INT) AS DATE) AS as_of, b FROM span, generate_series(0, 1000) t(i)) x
WHERE as_of <= b AND as_of + 34 <= b""")
def _(spark, sf):
    span = table(spark, sf, "lineitem").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b"))
    points = span.select("b", F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("as_of"))
    return points.filter(F.date_add("as_of", win.label_days(win.DEFAULT_HORIZON)) <= F.col("b")).select("as_of")


@query("window_membership", with_(PRICES, GRID) + """
SELECT symbol, as_of, ds, COUNT(*) AS n_rows, MIN(date) AS first_day, MAX(date) AS last_day,
       ROUND(SUM(adj_close), 4) AS total FROM (
  SELECT p.*, as_of, 'prices_equity' AS ds FROM prices p JOIN grid g ON p.date >= g.as_of - INTERVAL 60 MONTH AND p.date < g.as_of
  UNION ALL
  SELECT p.*, as_of, 'prices_index' FROM prices p JOIN grid g ON p.date >= g.as_of - INTERVAL 24 MONTH AND p.date < g.as_of)
GROUP BY symbol, as_of, ds""")
def _(spark, sf):
    m = win.members(views.prices(spark, sf), "date", WEEKLY, ["prices_equity", "prices_index"])
    return m.groupBy("symbol", "as_of", "ds").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        r(F.sum("adj_close"), 4).alias("total"))


@query("window_summary", with_(PRICES, GRID28) + """
SELECT symbol, as_of, ds, COUNT(*) AS n_bars, ROUND(CASE WHEN COUNT(*) >= 2 THEN ARG_MIN(adj_close, date) END, 6) AS first_close,
       ROUND(CASE WHEN COUNT(*) >= 2 THEN ARG_MAX(adj_close, date) END, 6) AS last_close,
       ROUND(CASE WHEN COUNT(*) >= 2 THEN ARG_MAX(adj_close, date) / ARG_MIN(adj_close, date) - 1 END, 6) AS total_return FROM (
  SELECT p.*, as_of, 'prices_equity' AS ds FROM prices p JOIN grid g ON p.date >= g.as_of - INTERVAL 60 MONTH AND p.date < g.as_of
  UNION ALL
  SELECT p.*, as_of, 'prices_index' FROM prices p JOIN grid g ON p.date >= g.as_of - INTERVAL 24 MONTH AND p.date < g.as_of)
GROUP BY symbol, as_of, ds""")
def _(spark, sf):
    px, _tx = win.window_summary(views.prices(spark, sf), views.docs(spark, sf), MONTHLY)
    return px.select("symbol", "as_of", "ds", "n_bars", *[r(F.col(c)).alias(c) for c in ("first_close", "last_close", "total_return")])


@query("window_summary_docs", with_(DOCS, GRID28, """
m AS (SELECT d.symbol, d.source, g.as_of, w.ds, date_diff('day', CAST(g.as_of - to_months(w.a) AS DATE), CAST(g.as_of - to_months(w.b) AS DATE)) AS days
  FROM docs d, grid g, (VALUES ('news_baseline', 12, 2), ('news_recent', 2, 0), ('macro', 6, 0)) w(ds, a, b)
  WHERE d.published >= g.as_of - to_months(w.a) AND d.published < g.as_of - to_months(w.b)),
c AS (SELECT symbol, as_of, ds, days, source, COUNT(*) AS n FROM m GROUP BY symbol, as_of, ds, days, source),
s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, as_of, ds ORDER BY n DESC, source) AS rk FROM c)""") + """
SELECT symbol, as_of, ds, CAST(SUM(n) AS BIGINT) AS n_documents, COUNT(*) AS n_sources,
       string_agg(CASE WHEN rk <= 5 THEN source END, ',' ORDER BY rk) AS top_sources,
       ROUND(SUM(n) / GREATEST(1, MAX(days)), 6) AS documents_per_day
FROM s GROUP BY symbol, as_of, ds""")
def _(spark, sf):
    _px, tx = win.window_summary(views.prices(spark, sf), views.docs(spark, sf), MONTHLY)
    return tx.select("symbol", "as_of", "ds", "n_documents", "n_sources", F.array_join("top_sources", ",").alias("top_sources"),
                     r(F.col("documents_per_day")).alias("documents_per_day"))


@query("strided_sample", with_(DOCS, """
o AS (SELECT doc_id, symbol, published, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY published, doc_id) - 1 AS pos,
             COUNT(*) OVER (PARTITION BY symbol) AS n FROM docs)""") + """
SELECT symbol, doc_id, published FROM o
WHERE n <= 25 OR pos IN (SELECT CAST(FLOOR(i * o.n / 25) AS BIGINT) FROM generate_series(0, 24) t(i))""")
def _(spark, sf):
    d = views.docs(spark, sf).select("doc_id", "symbol", "published")
    return strided_sample(d, ["symbol"], ["published", "doc_id"], 25).select("symbol", "doc_id", "published")


@query("source_fallback", """
SELECT day, COALESCE(a, b, c) AS n_source, CASE WHEN a IS NOT NULL THEN 'purchase' WHEN b IS NOT NULL THEN 'view' ELSE 'click' END AS source
FROM (SELECT CAST(ts AS DATE) AS day, user_id, SUM(CASE WHEN event_type = 'purchase' THEN 1 END) AS a,
             SUM(CASE WHEN event_type = 'view' THEN 1 END) AS b, SUM(CASE WHEN event_type = 'click' THEN 1 END) AS c
      FROM events GROUP BY 1, 2) WHERE COALESCE(a, b, c) IS NOT NULL""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "user_id", "event_type")
    counts = e.groupBy("day", "user_id", "event_type").agg(F.count("*").alias("n_source"))
    return first_source(counts, ["day", "user_id"], "event_type", ["purchase", "view", "click"]).select(
        "day", "n_source", F.col("event_type").alias("source"))


@query("is_fresh", with_(DOCS, """
d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN strftime(published, '%Y-%m-%d 00:00:00') WHEN 1 THEN strftime(published, '%Y-%m-%dT00:00:00Z')
                              WHEN 2 THEN 'soon' END AS posted,
             CASE WHEN doc_id % 3 <> 0 THEN published + 30 END AS seen_day FROM docs),
p AS (SELECT doc_id, seen_day, posted, TRY_CAST(substr(posted, 1, 10) AS DATE) AS posted_day FROM d)""") + """
SELECT doc_id, CASE WHEN posted_day IS NOT NULL THEN date_diff('day', posted_day, DATE '2001-08-01') <= 365
                    WHEN seen_day IS NOT NULL THEN date_diff('day', CAST(seen_day AS DATE), DATE '2001-08-01') <= 365
                    ELSE true END AS fresh,
       CASE WHEN posted_day IS NOT NULL THEN date_diff('day', posted_day, DATE '2001-08-01') <= 365
            WHEN seen_day IS NOT NULL THEN date_diff('day', CAST(seen_day AS DATE), DATE '2001-08-01') <= 365
            ELSE false END AS fresh_strict FROM p""")
def _(spark, sf):
    day = F.col("published")
    posted = (F.when(F.col("doc_id") % 4 == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
              .when(F.col("doc_id") % 4 == 1, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z")))
              .when(F.col("doc_id") % 4 == 2, "soon"))
    seen = F.when(F.col("doc_id") % 3 != 0, F.date_format(F.date_add(day, 30), "yyyy-MM-dd"))
    now = F.lit("2001-08-01 00:00:00").cast("timestamp")
    return views.docs(spark, sf).select("doc_id", is_fresh(posted, seen, now, 365).alias("fresh"),
                                        is_fresh(posted, seen, now, 365, strict=True).alias("fresh_strict"))
