"""Panel queries and leakage audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import returns as ret
from ..operators.windows import edges
from ..session import cut_lineage
from ..sources import series, views
from . import panel as pn
from .cte import DOCS, GRID, PRICES, with_
from .q_documents import LEX
from .q_returns import BY, rounded
from .q_windows import MONTHLY, WEEKLY, GRID28
from .registry import query

TARGET = """t0 AS (SELECT symbol, date, adj_close, LEAD(adj_close, 21) OVER w AS f, LEAD(date) OVER w AS nxt, LN(adj_close / LAG(adj_close) OVER w) AS lr, ROW_NUMBER() OVER w AS rn FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)),
t1 AS (SELECT *, CASE WHEN f IS NOT NULL THEN STDDEV_SAMP(lr) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) * SQRT(252) END AS fv,
  CASE WHEN COUNT(lr) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) >= 5 THEN STDDEV_SAMP(lr) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) * SQRT(252) END AS vol_21d FROM t0),
tg AS (SELECT symbol, as_of, LN(f / adj_close) AS log_return, CASE WHEN f IS NOT NULL THEN CASE WHEN f > adj_close THEN 1.0 ELSE 0.0 END END AS direction, fv AS volatility
  FROM t1 JOIN grid ON date <= as_of AND (nxt IS NULL OR nxt > as_of))"""


@query("minimal_panel", with_(PRICES, GRID, TARGET) + """
SELECT symbol, as_of, ROUND(vol_21d, 6) AS vol_21d, ROUND(log_return, 6) AS target FROM (SELECT symbol, as_of, vol_21d FROM t1 JOIN grid ON date < as_of AND (nxt IS NULL OR nxt >= as_of)) e
JOIN tg USING (symbol, as_of) WHERE log_return IS NOT NULL""")
def _(spark, sf):
    px = views.prices(spark, sf)
    w = ret.history(BY).rowsBetween(-20, 0)
    vol = ret.with_returns(px, BY).withColumn("vol_21d", F.when(F.count("lr").over(w) >= 5, F.stddev_samp("lr").over(w) * (252 ** 0.5)))
    at = edges(vol, WEEKLY, by=BY).select("symbol", "as_of", "vol_21d")
    panel = at.join(pn.compute_target(px, WEEKLY), ["symbol", "as_of"]).filter(F.col("target").isNotNull())
    return rounded(panel, ["symbol", "as_of"])


@query("compute_target", with_(PRICES, GRID, TARGET) + "SELECT symbol, as_of, ROUND(log_return, 6) AS log_return, direction, ROUND(volatility, 6) AS volatility FROM tg")
def _(spark, sf):
    px = views.prices(spark, sf)
    kinds = [pn.compute_target(px, WEEKLY, kind=k).withColumnRenamed("target", k) for k in ("log_return", "direction", "volatility")]
    return rounded(kinds[0].join(kinds[1], ["symbol", "as_of"]).join(kinds[2], ["symbol", "as_of"]), ["symbol", "as_of"])


def feature_rows(spark, sf, grid=MONTHLY):
    # daily tables feed many blocks: read the fact table once and keep them
    bars, indices, rf = (cut_lineage(f(spark, sf)) for f in (views.prices, views.indices, views.risk_free))
    return pn.feature_rows(bars, indices, rf, series.forward_filled(views.macro_series(spark, sf)), views.docs(spark, sf), grid, lexicon=LEX, series_ids=["A", "N", "R"], index_keys=["gspc", "rut", "iwd", "iwf"], scl_keys=["gspc", "rut"])


def wide_panel(spark, sf):
    return pn.labelled_panel(feature_rows(spark, sf), pn.compute_target(views.prices(spark, sf), MONTHLY))


@query("build_row")
def _(spark, sf):
    return feature_rows(spark, sf)


PANEL_KEYS = """SELECT symbol AS meta_symbol, as_of AS meta_as_of, ROUND(log_return, 6) AS target, ROUND(vol_21d, 6) AS eq_vol_21d, 'sentiment' AS meta_synthetic, CAST(1 AS INT) AS meta_n_synthetic,
  (SELECT COUNT(*) FROM docs d WHERE d.symbol = e.symbol AND published >= as_of - INTERVAL 2 MONTH AND published < as_of)::DOUBLE AS ds3_n_docs
FROM (SELECT symbol, as_of, vol_21d FROM t1 JOIN grid ON date < as_of AND (nxt IS NULL OR nxt >= as_of)) e JOIN tg USING (symbol, as_of) WHERE log_return IS NOT NULL"""


@query("build_panel", with_(PRICES, DOCS, GRID28, TARGET) + PANEL_KEYS)
def _(spark, sf):
    p = wide_panel(spark, sf)
    return rounded(p.select("meta_symbol", "meta_as_of", "target", "eq_vol_21d", "meta_synthetic", "meta_n_synthetic", "ds3_n_docs"), ["meta_symbol", "meta_as_of"])


@query("leak_corr", with_(PRICES, GRID, TARGET, """p AS (SELECT e.*, log_return AS target, log_return + 0.01 * vol_21d AS leaky FROM (SELECT symbol, as_of, vol_21d, LN(adj_close) AS level
  FROM t1 JOIN grid ON date < as_of AND (nxt IS NULL OR nxt >= as_of)) e JOIN tg USING (symbol, as_of) WHERE log_return IS NOT NULL)""") + """
SELECT feature, ROUND(c, 6) AS corr, ROUND(sd, 6) AS sd FROM (SELECT 'vol_21d' AS feature, CORR(vol_21d, target) AS c, STDDEV_SAMP(vol_21d) AS sd FROM p UNION ALL
  SELECT 'level', CORR(level, target), STDDEV_SAMP(level) FROM p UNION ALL SELECT 'leaky', CORR(leaky, target), STDDEV_SAMP(leaky) FROM p) WHERE sd > 0 AND ABS(c) > 0.8""")
def _(spark, sf):
    px = views.prices(spark, sf)
    w = ret.history(BY)
    f = ret.with_returns(px, BY)
    f = f.withColumn("vol_21d", F.when(F.count("lr").over(w.rowsBetween(-20, 0)) >= 5, F.stddev_samp("lr").over(w.rowsBetween(-20, 0)) * (252 ** 0.5)))
    f = f.withColumn("level", F.log("adj_close"))
    at = edges(f, WEEKLY, by=BY).select("symbol", "as_of", "vol_21d", "level")
    p = pn.labelled_panel(at.withColumnsRenamed({"symbol": "meta_symbol", "as_of": "meta_as_of"}), pn.compute_target(px, WEEKLY))
    p = p.withColumn("leaky", F.col("target") + 0.01 * F.col("vol_21d"))  # a feature that saw the future
    return rounded(pn.leak_corr(p), ["feature"])


@query("no_future_rows", with_(PRICES, DOCS, GRID) + """
SELECT ds, COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_future FROM (
  SELECT 'prices_equity' AS ds FROM prices JOIN grid ON date >= as_of - INTERVAL 60 MONTH AND date < as_of UNION ALL SELECT 'prices_index' FROM prices JOIN grid ON date >= as_of - INTERVAL 24 MONTH AND date < as_of
  UNION ALL SELECT 'news_baseline' FROM docs JOIN grid ON published >= as_of - INTERVAL 12 MONTH AND published < as_of - INTERVAL 2 MONTH
  UNION ALL SELECT 'news_recent' FROM docs JOIN grid ON published >= as_of - INTERVAL 2 MONTH AND published < as_of) GROUP BY ds""")
def _(spark, sf):
    px = pn.future_rows(views.prices(spark, sf).select("date"), "date", WEEKLY, ["prices_equity", "prices_index"])
    return px.unionByName(pn.future_rows(views.docs(spark, sf).select("published"), "published", WEEKLY, ["news_baseline", "news_recent"]))


@query("news_windows_disjoint", with_(DOCS, GRID) + """SELECT COUNT(*) AS n_members, COUNT(*) FILTER (c > 1) AS n_overlapping FROM (SELECT doc_id, as_of, COUNT(*) AS c FROM (
  SELECT doc_id, as_of FROM docs JOIN grid ON published >= as_of - INTERVAL 12 MONTH AND published < as_of - INTERVAL 2 MONTH
  UNION ALL SELECT doc_id, as_of FROM docs JOIN grid ON published >= as_of - INTERVAL 2 MONTH AND published < as_of) GROUP BY ALL)""")
def _(spark, sf):
    return pn.overlapping_windows(views.docs(spark, sf), WEEKLY)
