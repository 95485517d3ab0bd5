"""Return and risk aggregates."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import finance as fin
from ..operators import returns as ret
from ..session import cut_lineage
from ..sources import views
from ..sources.tables import table
from .cte import GRID, INDICES, PRICES, RETURNS, RISK_FREE, with_
from .q_windows import WEEKLY, r
from .registry import query

BY = ["symbol"]


def rounded(df, keys, digits=6):
    return df.select(*keys, *[r(F.col(c), digits).alias(c) if df.schema[c].dataType.typeName() == "double" else F.col(c)
                              for c in df.columns if c not in keys])


def returns(spark, sf):
    return ret.with_returns(views.prices(spark, sf), BY)


@query("simple_returns", with_(PRICES, RETURNS) + "SELECT symbol, date, ROUND(sr, 6) AS sr FROM rets")
def _(spark, sf):
    return views.prices(spark, sf).select("symbol", "date", r(ret.simple_return(BY)).alias("sr"))


@query("log_returns", with_(PRICES, RETURNS) + "SELECT symbol, date, ROUND(lr, 8) AS lr FROM rets")
def _(spark, sf):
    return views.prices(spark, sf).select("symbol", "date", r(ret.log_return(BY), 8).alias("lr"))


@query("forward_log_return", with_(PRICES) + """
SELECT symbol, date, ROUND(LN(LEAD(adj_close, 21) OVER w) - LN(adj_close), 8) AS forward_log_return
FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def _(spark, sf):
    f = ret.forward_log_return(views.prices(spark, sf), 21, BY)
    return f.select("symbol", "date", r(F.col("forward_log_return"), 8).alias("forward_log_return"))


@query("holding_period_return", with_(PRICES) + """
SELECT symbol, ROUND(ARG_MIN(adj_close, date), 6) AS p_start, ROUND(ARG_MAX(adj_close, date), 6) AS p_end, ROUND(SUM(adj_close / 1000), 4) AS income,
       ROUND((ARG_MAX(adj_close, date) - ARG_MIN(adj_close, date) + SUM(adj_close / 1000)) / ARG_MIN(adj_close, date), 6) AS hpr
FROM prices GROUP BY symbol""")
def _(spark, sf):
    p = views.prices(spark, sf).withColumn("paid", F.col("adj_close") / 1000)
    h = ret.holding_period_return(p, BY, income="paid")
    return h.select("symbol", r(F.col("p_start")).alias("p_start"), r(F.col("p_end")).alias("p_end"),
                    r(F.col("income"), 4).alias("income"), r(F.col("hpr")).alias("hpr"))


@query("annualize_returns", with_(PRICES, """
t AS (SELECT symbol, ARG_MAX(adj_close, date) / ARG_MIN(adj_close, date) - 1 AS total_return,
             date_diff('day', MIN(date), MAX(date)) / 365.25 AS years FROM prices GROUP BY symbol)""") + """
SELECT symbol, ROUND(total_return, 6) AS total_return, ROUND(years, 6) AS years, ROUND(POW(1 + total_return, 1 / years) - 1, 6) AS annual_return,
       ROUND(POW(1 + total_return / 12, 12) - 1, 6) AS ear_12, ROUND(EXP(total_return) - 1, 6) AS ear_continuous,
       ROUND((1 + total_return) / 1.03 - 1, 6) AS real_exact, ROUND(total_return - 0.03, 6) AS real_approx FROM t""")
def _(spark, sf):
    t = ret.annual_return(views.prices(spark, sf), BY)
    x = F.col("total_return")
    return rounded(t.withColumn("ear_12", fin.effective_annual_rate(x, 12)).withColumn("ear_continuous", fin.effective_annual_rate(x, 0))
                   .withColumn("real_exact", fin.real_rate_exact(x, F.lit(0.03))).withColumn("real_approx", fin.real_rate_approx(x, F.lit(0.03))), BY)


@query("mean_returns", with_(PRICES, RETURNS) + """
SELECT symbol, ROUND(AVG(sr), 6) AS arith_mean,
       ROUND(CASE WHEN MAX(CASE WHEN sr <= -1 THEN 1 ELSE 0 END) = 1 THEN -1 ELSE EXP(AVG(LN(1 + sr))) - 1 END, 6) AS geo_mean
FROM rets GROUP BY symbol""")
def _(spark, sf):
    return rounded(ret.mean_returns(returns(spark, sf), BY), BY)


@query("scenario_moments", with_("""
s AS (SELECT o_orderpriority, COUNT(*) / SUM(COUNT(*)) OVER () AS p, AVG(o_totalprice) / 250000 - 1 AS r FROM orders GROUP BY o_orderpriority)""") + """
SELECT ROUND(SUM(p * r), 8) AS expected_return, ROUND(SUM(p * (r - (SELECT SUM(p * r) FROM s)) ** 2), 8) AS variance FROM s""")
def _(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("c"), (F.avg("o_totalprice") / 250000 - 1).alias("r"))
    total = F.sum("c").over(W.partitionBy(F.lit(0)))  # one row per scenario
    return rounded(ret.scenario_moments(g.select((F.col("c") / total).alias("p"), "r")), [], 8)


@query("volatility", with_(PRICES, RETURNS) + """
SELECT symbol, ROUND(STDDEV_SAMP(lr), 6) AS daily_vol, ROUND(STDDEV_SAMP(lr) * SQRT(252), 6) AS annual_vol FROM rets GROUP BY symbol""")
def _(spark, sf):
    return rounded(ret.volatility(returns(spark, sf), BY), BY)


@query("sharpe", with_(PRICES, RETURNS, "x AS (SELECT symbol, lr - (POW(1.04, 1 / 252.0) - 1) AS x FROM rets)") + """
SELECT symbol, ROUND(AVG(x) / NULLIF(STDDEV_SAMP(x), 0) * SQRT(252), 6) AS sharpe FROM x GROUP BY symbol""")
def _(spark, sf):
    return rounded(ret.sharpe(returns(spark, sf), BY, 0.04), BY)


@query("var_normal", with_(PRICES, RETURNS) + "SELECT symbol, ROUND(AVG(lr) - 2.33 * STDDEV_SAMP(lr), 6) AS var_normal FROM rets GROUP BY symbol")
def _(spark, sf):
    return rounded(ret.var_normal(returns(spark, sf), BY), BY)


@query("var_historical", with_(PRICES, RETURNS) + "SELECT symbol, ROUND(QUANTILE_CONT(lr, 0.01), 6) AS var_hist FROM rets GROUP BY symbol")
def _(spark, sf):
    return rounded(ret.var_historical(returns(spark, sf), BY), BY)


@query("expected_shortfall", with_(PRICES, RETURNS, "q AS (SELECT symbol, QUANTILE_CONT(lr, 0.01) AS q FROM rets GROUP BY symbol)") + """
SELECT symbol, ROUND(AVG(lr), 6) AS expected_shortfall, COUNT(*) AS n_tail FROM rets JOIN q USING (symbol) WHERE lr <= q GROUP BY symbol""")
def _(spark, sf):
    return rounded(ret.expected_shortfall(returns(spark, sf), BY), BY)


@query("max_drawdown", with_(PRICES, """
d AS (SELECT symbol, adj_close / MAX(adj_close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM prices)""") + """
SELECT symbol, ROUND(MIN(dd), 6) AS max_drawdown FROM d GROUP BY symbol""")
def _(spark, sf):
    return rounded(ret.drawdown(views.prices(spark, sf), BY), BY)


@query("skew_kurt", with_(PRICES, RETURNS, "m AS (SELECT symbol, AVG(lr) AS m FROM rets GROUP BY symbol)") + """
SELECT symbol, ROUND(AVG((lr - m) ** 3) / POW(AVG((lr - m) ** 2), 1.5), 6) AS skew,
       ROUND(AVG((lr - m) ** 4) / POW(AVG((lr - m) ** 2), 2) - 3, 6) AS kurt FROM rets JOIN m USING (symbol) GROUP BY symbol""")
def _(spark, sf):
    return rounded(ret.skew_kurt(returns(spark, sf), BY), BY)


@query("liquidity", with_(PRICES) + """
SELECT symbol, date, ROUND(AVG(volume) OVER (w ROWS 20 PRECEDING) / AVG(volume) OVER (w ROWS 251 PRECEDING), 6) AS rel_volume_21d,
       ROUND(LN(1 + AVG(volume) OVER (w ROWS 20 PRECEDING) * adj_close), 6) AS log_dollar_volume
FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def _(spark, sf):
    return ret.liquidity(views.prices(spark, sf), BY).select("symbol", "date", r(F.col("rel_volume_21d")).alias("rel_volume_21d"),
                                                             r(F.col("log_dollar_volume")).alias("log_dollar_volume"))


def feature_sql(bars: str, key: str, months: int, anomalies: bool, volume: bool) -> str:
    """Price features by plain trailing frames and per-window aggregates."""
    cols = []
    for lb in (5, 21, 63, 126, 252, 504):
        cols.append(f"LN(p / LAG(p, {lb}) OVER w) AS ret_{lb}d")
        cols.append(f"CASE WHEN COUNT(lr) OVER (w ROWS {lb - 1} PRECEDING) >= {max(5, lb // 4)} THEN STDDEV_SAMP(lr) OVER (w ROWS {lb - 1} PRECEDING) * SQRT(252) END AS vol_{lb}d")
    for lb in (63, 252):
        cols.append(f"AVG(lr) OVER (w ROWS {lb - 1} PRECEDING) AS m_{lb}, STDDEV_SAMP(lr) OVER (w ROWS {lb - 1} PRECEDING) AS s_{lb}")
    for lb in (21, 63, 126, 252):
        cols.append(f"CASE WHEN rn > {lb} THEN p / AVG(p) OVER (w ROWS {lb - 1} PRECEDING) - 1 END AS sma_dist_{lb}d")
    for lb in (50, 200):
        cols.append(f"CASE WHEN rn >= {lb} THEN CASE WHEN p >= AVG(p) OVER (w ROWS {lb - 1} PRECEDING) THEN 1.0 ELSE -1.0 END END AS ma_cross_{lb}d")
    cols.append("p / MAX(p) OVER (w ROWS 251 PRECEDING) - 1 AS pct_from_52w_high, p / MIN(p) OVER (w ROWS 251 PRECEDING) - 1 AS pct_from_52w_low")
    cols.append("AVG(sr) OVER (w ROWS 251 PRECEDING) - (EXP(AVG(LN(1 + sr)) OVER (w ROWS 251 PRECEDING)) - 1) AS arith_geo_gap")
    cols.append("QUANTILE_CONT(lr, 0.01) OVER (w ROWS 251 PRECEDING) AS var_hist_1pct, LIST(lr) OVER (w ROWS 251 PRECEDING) AS rs, LIST(p) OVER (w ROWS 251 PRECEDING) AS ps")
    if anomalies:
        cols.append("LN(LAG(p, 21) OVER w / LAG(p, 252) OVER w) AS momentum_12_1, -LN(LAG(p, 252) OVER w / LAG(p, 756) OVER w) AS reversal_24_36m")
    if volume:
        cols.append("AVG(volume) OVER (w ROWS 20 PRECEDING) / AVG(volume) OVER (w ROWS 251 PRECEDING) AS liq_rel_volume_21d, LN(1 + AVG(volume) OVER (w ROWS 20 PRECEDING) * p) AS liq_log_dollar_volume")
    names = [f"ret_{lb}d" for lb in (5, 21, 63, 126, 252, 504)] + [f"vol_{lb}d" for lb in (5, 21, 63, 126, 252, 504)]
    names += [f"sma_dist_{lb}d" for lb in (21, 63, 126, 252)] + ["ma_cross_50d", "ma_cross_200d", "pct_from_52w_high", "pct_from_52w_low",
              "arith_geo_gap", "var_hist_1pct"]
    names += (["momentum_12_1", "reversal_24_36m"] if anomalies else []) + (["liq_rel_volume_21d", "liq_log_dollar_volume"] if volume else [])
    return f"""
b0 AS (SELECT {key}, date, adj_close AS p, {'volume,' if volume else ''} ROW_NUMBER() OVER w AS rn, LN(adj_close / LAG(adj_close) OVER w) AS lr,
         adj_close / LAG(adj_close) OVER w - 1 AS sr, LEAD(date) OVER w AS nxt FROM {bars} WINDOW w AS (PARTITION BY {key} ORDER BY date)),
b1 AS (SELECT *, CASE WHEN rn >= 50 THEN SIGN(p - AVG(p) OVER (w ROWS 49 PRECEDING)) END AS side, {', '.join(cols)} FROM b0 WINDOW w AS (PARTITION BY {key} ORDER BY date)),
b2 AS (SELECT *, CASE WHEN COUNT(side) OVER (w ROWS UNBOUNDED PRECEDING) >= 2 THEN CAST(LEAST(252, rn - COALESCE(CASE WHEN side >= 0
         THEN MAX(CASE WHEN side < 0 THEN rn END) OVER (w ROWS UNBOUNDED PRECEDING) ELSE MAX(CASE WHEN side >= 0 THEN rn END) OVER (w ROWS UNBOUNDED PRECEDING) END, -1000)) AS DOUBLE) END AS ma_cross_age_50d
       FROM b1 WINDOW w AS (PARTITION BY {key} ORDER BY date)),
e AS (SELECT b2.*, as_of, (SELECT ARG_MAX(rate, rf.date) FROM risk_free rf WHERE rf.date < as_of) AS rf
      FROM b2 JOIN grid ON date < as_of AND (nxt IS NULL OR nxt >= as_of) AND date >= as_of - INTERVAL {months} MONTH AND rn >= 2),
full_dd AS (SELECT {key}, as_of, MIN(p / pk - 1) AS max_drawdown_full FROM (
      SELECT b0.{key}, g.as_of, p, MAX(p) OVER (PARTITION BY b0.{key}, g.as_of ORDER BY b0.date ROWS UNBOUNDED PRECEDING) AS pk
      FROM b0 JOIN grid g ON b0.date < g.as_of AND b0.date >= g.as_of - INTERVAL {months} MONTH) GROUP BY {key}, as_of),
dl AS (SELECT b0.{key}, g.as_of, p - LAG(p) OVER q AS d, ROW_NUMBER() OVER q AS i, COUNT(*) OVER (PARTITION BY b0.{key}, g.as_of) AS n
      FROM b0 JOIN grid g ON b0.date < g.as_of AND b0.date >= g.as_of - INTERVAL {months} MONTH WINDOW q AS (PARTITION BY b0.{key}, g.as_of ORDER BY b0.date)),
rs AS (SELECT {key}, as_of, SUM(wt * GREATEST(d, 0)) AS g, SUM(wt * GREATEST(-d, 0)) AS l, MAX(n) AS n FROM (
      SELECT *, POW(13 / 14.0, n - i) * CASE WHEN i = 2 THEN 1 ELSE 1 / 14.0 END AS wt FROM dl WHERE d IS NOT NULL) GROUP BY {key}, as_of),
px AS (SELECT {key}, as_of, {', '.join(f'ROUND({n}, 6) AS {n}' for n in names)}, ma_cross_age_50d,
       ROUND(vol_21d / NULLIF(vol_252d, 0), 6) AS vol_ratio_21_252,
       ROUND((m_252 - (POW(1 + COALESCE(rf, 0), 1 / 252.0) - 1)) / NULLIF(s_252, 0) * SQRT(252), 6) AS sharpe_252d,
       ROUND((m_63 - (POW(1 + COALESCE(rf, 0), 1 / 252.0) - 1)) / NULLIF(s_63, 0) * SQRT(252), 6) AS sharpe_63d,
       ROUND(m_252 - 2.33 * s_252, 6) AS var_normal_1pct, ROUND(var_hist_1pct - (m_252 - 2.33 * s_252), 6) AS var_gap,
       ROUND(list_avg(list_filter(rs, lambda x: x <= var_hist_1pct)), 6) AS expected_shortfall,
       (SELECT ROUND(MIN(v / mx - 1), 6) FROM (SELECT v, MAX(v) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS mx FROM (SELECT UNNEST(ps) AS v, generate_subscripts(ps, 1) AS i))) AS max_drawdown_252d,
       (SELECT ROUND(AVG((v - m_252) ** 3) / POW(AVG((v - m_252) ** 2), 1.5), 6) FROM (SELECT UNNEST(rs) AS v) WHERE v IS NOT NULL) AS skew_252d,
       (SELECT ROUND(AVG((v - m_252) ** 4) / POW(AVG((v - m_252) ** 2), 2) - 3, 6) FROM (SELECT UNNEST(rs) AS v) WHERE v IS NOT NULL) AS kurtosis_252d
       FROM e)"""


FEATURES_OUT = """
SELECT px.*, ROUND(max_drawdown_full, 6) AS max_drawdown_full,
       ROUND(CASE WHEN rs.n >= 15 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END, 6) AS rsi_14d
FROM px LEFT JOIN full_dd USING (symbol, as_of) LEFT JOIN rs USING (symbol, as_of)"""


@query("price_features", with_(PRICES, RISK_FREE, GRID, feature_sql("prices", "symbol", 60, True, True)) + FEATURES_OUT)
def _(spark, sf):
    f = ret.price_features(cut_lineage(views.prices(spark, sf)), WEEKLY, risk_free=views.risk_free(spark, sf))
    return rounded(f.drop("date", "adj_close"), ["symbol", "as_of"])


def _idx_sql() -> str:
    keys = ("gspc", "rut", "iwd", "iwf")
    base = feature_sql("indices", "index_key", 24, False, False)
    shown = ["ret_21d", "vol_63d", "sharpe_252d", "var_gap", "expected_shortfall", "max_drawdown_252d", "ma_cross_age_50d", "skew_252d", "sma_dist_252d"]
    picks = ", ".join(f"MAX(CASE WHEN index_key = '{k}' THEN {c} END) AS idx_{k}_{c}" for k in keys for c in shown)
    return with_(INDICES, RISK_FREE, GRID, base) + f"SELECT as_of, {picks} FROM px GROUP BY as_of"


@query("index_features", _idx_sql())
def _(spark, sf):
    f = ret.index_features(views.indices(spark, sf), WEEKLY, ["gspc", "rut", "iwd", "iwf"], views.risk_free(spark, sf))
    shown = ["ret_21d", "vol_63d", "sharpe_252d", "var_gap", "expected_shortfall", "max_drawdown_252d", "ma_cross_age_50d", "skew_252d", "sma_dist_252d"]
    return rounded(f.select("as_of", *[f"idx_{k}_{c}" for k in ("gspc", "rut", "iwd", "iwf") for c in shown]), ["as_of"])
