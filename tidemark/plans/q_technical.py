"""Analytic functions on ordered series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import technical as tech
from ..operators.feed import weighted_mix
from ..sources import views
from ..sources.tables import table
from .cte import INDICES, MACRO, PRICES, RETURNS, with_
from .q_returns import BY, returns, rounded
from .q_windows import r
from .registry import query

W_SQL = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


@query("moving_average", with_(PRICES) + f"""
SELECT symbol, date, ROUND(CASE WHEN COUNT(*) OVER (w ROWS 49 PRECEDING) = 50 THEN AVG(adj_close) OVER (w ROWS 49 PRECEDING) END, 6) AS ma FROM prices {W_SQL}""")
def _(spark, sf):
    return tech.moving_average(views.prices(spark, sf), BY).select("symbol", "date", r(F.col("ma")).alias("ma"))


@query("ma_crossover_state", with_(PRICES) + f"""
SELECT symbol, date, CASE WHEN COUNT(*) OVER (w ROWS 49 PRECEDING) = 50 THEN CASE WHEN adj_close >= AVG(adj_close) OVER (w ROWS 49 PRECEDING) THEN 1.0 ELSE -1.0 END END AS ma_cross
FROM prices {W_SQL}""")
def _(spark, sf):
    return tech.crossover_state(views.prices(spark, sf), BY).select("symbol", "date", "ma_cross")


@query("ma_crossover_age", with_(PRICES, f"""
a AS (SELECT symbol, date, ROW_NUMBER() OVER w AS rn, CASE WHEN COUNT(*) OVER (w ROWS 49 PRECEDING) = 50 THEN SIGN(adj_close - AVG(adj_close) OVER (w ROWS 49 PRECEDING)) END AS s FROM prices {W_SQL}),
b AS (SELECT *, MAX(CASE WHEN s > 0 THEN rn END) OVER (w ROWS UNBOUNDED PRECEDING) AS u, MAX(CASE WHEN s < 0 THEN rn END) OVER (w ROWS UNBOUNDED PRECEDING) AS d,
  COUNT(s) OVER (w ROWS UNBOUNDED PRECEDING) AS n FROM a {W_SQL})""") + """
SELECT symbol, date, CASE WHEN s IS NOT NULL AND n >= 2 THEN CAST(LEAST(252, COALESCE(rn - CASE WHEN s > 0 THEN d WHEN s < 0 THEN u ELSE GREATEST(u, d) END, 252)) AS DOUBLE) END AS ma_cross_age FROM b""")
def _(spark, sf):
    return tech.crossover_age(views.prices(spark, sf), BY).select("symbol", "date", "ma_cross_age")


@query("relative_strength", with_(PRICES, INDICES, f"""
s AS (SELECT symbol, date, LN(adj_close / LAG(adj_close, 63) OVER w) AS a, LN(adj_close / LAG(adj_close, 252) OVER w) AS b,
  LN(LAG(adj_close, 63) OVER w / LAG(adj_close, 126) OVER w) AS c FROM prices {W_SQL}),
m AS (SELECT date, LN(adj_close / LAG(adj_close, 63) OVER w) AS a, LN(adj_close / LAG(adj_close, 252) OVER w) AS b,
  LN(LAG(adj_close, 63) OVER w / LAG(adj_close, 126) OVER w) AS c FROM market WINDOW w AS (ORDER BY date))""") + """
SELECT symbol, date, ROUND(s.a - m.a, 6) AS rs_63d, ROUND(s.b - m.b, 6) AS rs_252d, ROUND((s.a - m.a) - (s.c - m.c), 6) AS rs_trend_63d FROM s JOIN m USING (date)""")
def _(spark, sf):
    return rounded(tech.relative_strength(views.prices(spark, sf), views.market(spark, sf), BY), ["symbol", "date"])


@query("rsi_wilder", with_(PRICES, f"""
d AS (SELECT symbol, adj_close - LAG(adj_close) OVER w AS d, ROW_NUMBER() OVER w AS i, COUNT(*) OVER (PARTITION BY symbol) AS n FROM prices {W_SQL}),
x AS (SELECT symbol, SUM(POW(13/14.0, n - i) * CASE WHEN i = 2 THEN 1 ELSE 1/14.0 END * GREATEST(d, 0)) AS g,
  SUM(POW(13/14.0, n - i) * CASE WHEN i = 2 THEN 1 ELSE 1/14.0 END * GREATEST(-d, 0)) AS l FROM d WHERE d IS NOT NULL GROUP BY symbol)""") + """
SELECT symbol, ROUND(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi FROM x""")
def _(spark, sf):
    return rounded(tech.rsi_wilder(views.prices(spark, sf), BY), BY)


@query("pct_from_extreme", with_(PRICES) + f"""
SELECT symbol, date, ROUND(CASE WHEN COUNT(*) OVER (w ROWS 251 PRECEDING) >= 2 THEN adj_close / MAX(adj_close) OVER (w ROWS 251 PRECEDING) - 1 END, 6) AS pct_from_high,
  ROUND(CASE WHEN COUNT(*) OVER (w ROWS 251 PRECEDING) >= 2 THEN adj_close / MIN(adj_close) OVER (w ROWS 251 PRECEDING) - 1 END, 6) AS pct_from_low FROM prices {W_SQL}""")
def _(spark, sf):
    f = tech.pct_from_extreme(views.prices(spark, sf), BY)
    return rounded(f.select("symbol", "date", "pct_from_high", "pct_from_low"), ["symbol", "date"])


@query("momentum_12_1", with_(PRICES) + f"SELECT symbol, date, ROUND(LN(LAG(adj_close, 21) OVER w / LAG(adj_close, 252) OVER w), 6) AS momentum_12_1 FROM prices {W_SQL}")
def _(spark, sf):
    return rounded(tech.momentum_12_1(views.prices(spark, sf), BY).select("symbol", "date", "momentum_12_1"), ["symbol", "date"])


@query("long_horizon_reversal", with_(PRICES) + f"SELECT symbol, date, ROUND(-LN(LAG(adj_close, 252) OVER w / LAG(adj_close, 756) OVER w), 6) AS reversal FROM prices {W_SQL}")
def _(spark, sf):
    return rounded(tech.long_horizon_reversal(views.prices(spark, sf), BY).select("symbol", "date", "reversal"), ["symbol", "date"])


@query("trin_breadth", with_(PRICES, RETURNS) + """
SELECT date, COUNT(*) FILTER (sr > 0) AS n_advancing, COUNT(*) FILTER (sr < 0) AS n_declining,
  ROUND((SUM(volume) FILTER (sr < 0) / NULLIF(COUNT(*) FILTER (sr < 0), 0)) / NULLIF(SUM(volume) FILTER (sr > 0) / NULLIF(COUNT(*) FILTER (sr > 0), 0), 0), 6) AS trin FROM rets GROUP BY date""")
def _(spark, sf):
    return rounded(tech.trin(returns(spark, sf)), ["date"])


@query("parity_premium", with_(PRICES) + """
SELECT date, ROUND(a.adj_close / b.adj_close, 6) AS actual_ratio, ROUND((a.adj_close / b.adj_close - 1.5) / 1.5, 6) AS premium
FROM prices a JOIN prices b USING (date) WHERE a.symbol = 'LARGE' AND b.symbol = 'SMALL'""")
def _(spark, sf):
    return rounded(tech.parity(views.prices(spark, sf), "LARGE", "SMALL", 1.5), ["date"])


@query("macro_level_delta", with_(MACRO, """
v AS (SELECT series_id, date, TRY_CAST(NULLIF(value, '.') AS DOUBLE) AS v FROM macro_series),
f AS (SELECT series_id, date, LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM v),
g AS (SELECT series_id, date, v, v - LAG(v, 21) OVER (PARTITION BY series_id ORDER BY date) AS d FROM f WHERE v IS NOT NULL)""") + """
SELECT series_id, ROUND(ARG_MAX(v, date), 6) AS level, ROUND(ARG_MAX(d, date), 6) AS delta_21 FROM g GROUP BY series_id""")
def _(spark, sf):
    from ..sources.series import forward_filled
    return rounded(tech.level_delta(forward_filled(views.macro_series(spark, sf))), ["series_id"])


def order_days(spark, sf):
    return (table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")))


SPINE = """c AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1),
spine AS (SELECT CAST(d AS DATE) AS day FROM (SELECT UNNEST(generate_series((SELECT MIN(day) FROM c), (SELECT MAX(day) FROM c), INTERVAL 1 DAY)) AS d)),
s AS (SELECT day, COALESCE(n, 0) AS n FROM spine LEFT JOIN c USING (day))"""


@query("running_total", with_(SPINE) + "SELECT day, n, CAST(SUM(n) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM s")
def _(spark, sf):
    return tech.running_total(tech.day_spine(order_days(spark, sf)))


@query("rolling_7d_mean", with_(SPINE) + "SELECT day, n, ROUND(AVG(n) OVER (ORDER BY day ROWS 6 PRECEDING), 2) AS rolling FROM s")
def _(spark, sf):
    return tech.rolling_mean(tech.day_spine(order_days(spark, sf)))


@query("streak", with_("""d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
i AS (SELECT user_id, day, day - CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS g FROM d),
x AS (SELECT user_id, MAX(day) AS e, COUNT(*) AS n FROM i GROUP BY user_id, g)""") + """
SELECT user_id, MAX(CASE WHEN e >= DATE '2024-01-29' THEN n ELSE 0 END) AS streak FROM x GROUP BY user_id""")
def _(spark, sf):
    days = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    return tech.streak(days, ["user_id"], F.lit("2024-01-30").cast("date"))


@query("weighted_mix", with_("""k AS (SELECT o_orderkey, o_orderpriority AS bucket, o_totalprice AS score,
  CASE o_orderpriority WHEN '1-URGENT' THEN 0.5 WHEN '2-HIGH' THEN 0.2 WHEN '3-MEDIUM' THEN 0.15 WHEN '5-LOW' THEN 0.1 END AS w FROM orders),
p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY CASE WHEN w IS NULL THEN 'other' ELSE bucket END ORDER BY score DESC, o_orderkey) - 1 AS k FROM k)""") + """
SELECT o_orderkey, bucket, ROW_NUMBER() OVER (ORDER BY w IS NULL, CASE WHEN w IS NULL THEN k ELSE (k + 0.5::DOUBLE) / w::DOUBLE END, bucket) - 1 AS place FROM p""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("bucket"), F.col("o_totalprice").alias("score"))
    weights = {"1-URGENT": 0.5, "2-HIGH": 0.2, "3-MEDIUM": 0.15, "5-LOW": 0.1}
    return weighted_mix(o, weights, "bucket", "score", "o_orderkey").select("o_orderkey", "bucket", "place")
