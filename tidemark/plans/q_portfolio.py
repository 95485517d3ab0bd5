"""Portfolio queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import portfolio as pf
from ..operators import regression as reg
from .cte import PRICES, RETURNS, with_
from .q_regression import BASE, aligned
from .q_returns import BY, returns, rounded
from .registry import query


@query("capital_allocation", with_(PRICES, RETURNS, """
a AS (SELECT symbol, AVG(sr) AS mean, STDDEV_SAMP(sr) AS sd FROM rets GROUP BY symbol),
y AS (SELECT symbol, mean, sd, ra AS risk_aversion, (mean - 0.0001) / (ra * sd * sd) AS y FROM a, (VALUES (2.0::DOUBLE), (4.0::DOUBLE), (8.0::DOUBLE)) t(ra))""") + """
SELECT symbol, ROUND(mean, 6) AS mean, ROUND(sd, 6) AS sd, risk_aversion, ROUND(y, 6) AS y_star, ROUND(0.0001 + y * (mean - 0.0001), 6) AS complete_return,
  ROUND(ABS(y) * sd, 6) AS complete_sd, ROUND((mean - 0.0001) / sd, 6) AS sharpe, ROUND(0.0001 + y * (mean - 0.0001) - 0.5 * risk_aversion * (y * sd) ** 2, 6) AS utility,
  y > 1 AS is_levered, y < 0 AS is_short, ROUND(GREATEST(0, LEAST(1, y)), 6) AS y_display FROM y""")
def _(spark, sf):
    a = returns(spark, sf).groupBy("symbol").agg(F.avg("sr").alias("mean"), F.stddev_samp("sr").alias("sd"))
    return rounded(pf.capital_allocation(a, F.lit(0.0001), [2.0, 4.0, 8.0]), BY)


@query("two_asset_mix", with_(PRICES, RETURNS, """
n AS (SELECT symbol AS d, LEAD(symbol) OVER (ORDER BY symbol) AS e FROM (SELECT DISTINCT symbol FROM prices)),
g AS (SELECT d, e, COUNT(*) AS n, AVG(a.sr) AS mean_d, AVG(b.sr) AS mean_e, STDDEV_SAMP(a.sr) AS sd_d, STDDEV_SAMP(b.sr) AS sd_e, CORR(a.sr, b.sr) AS corr, COVAR_SAMP(a.sr, b.sr) AS cov
  FROM n JOIN rets a ON a.symbol = d JOIN rets b ON b.symbol = e AND b.date = a.date WHERE a.sr IS NOT NULL AND b.sr IS NOT NULL GROUP BY d, e),
w AS (SELECT *, (sd_e ** 2 - cov) / (sd_d ** 2 + sd_e ** 2 - 2 * cov) AS wm,
  (mean_d * sd_e ** 2 - mean_e * cov) / (mean_d * sd_e ** 2 + mean_e * sd_d ** 2 - (mean_d + mean_e) * cov) AS wo FROM g)""") + """
SELECT d, e, n, ROUND(mean_d, 6) AS mean_d, ROUND(mean_e, 6) AS mean_e, ROUND(sd_d, 6) AS sd_d, ROUND(sd_e, 6) AS sd_e, ROUND(corr, 6) AS corr, ROUND(wm, 6) AS w_min_var, ROUND(wo, 6) AS w_optimal,
  ROUND(wm * mean_d + (1 - wm) * mean_e, 6) AS return_min_var, ROUND(wm ** 2 * sd_d ** 2 + (1 - wm) ** 2 * sd_e ** 2 + 2 * wm * (1 - wm) * cov, 6) AS variance_min_var,
  ROUND(wo * mean_d + (1 - wo) * mean_e, 6) AS return_optimal, ROUND(wo ** 2 * sd_d ** 2 + (1 - wo) ** 2 * sd_e ** 2 + 2 * wo * (1 - wo) * cov, 6) AS variance_optimal FROM w""")
def _(spark, sf):
    rets = returns(spark, sf).select("symbol", "date", "sr")
    names = rets.select("symbol").distinct()  # the asset list: one row per asset
    pairs = names.select(F.col("symbol").alias("d"), F.lead("symbol").over(W.partitionBy(F.lit(0)).orderBy("symbol")).alias("e")).dropna()
    return rounded(pf.two_asset_mix(rets, pairs), ["d", "e"])


@query("markowitz", with_(PRICES, RETURNS, """
wt AS (SELECT symbol, CASE symbol WHEN 'ECONOMY' THEN 0.3 WHEN 'LARGE' THEN 0.2 WHEN 'SMALL' THEN 0.1 WHEN 'PROMO' THEN 0.4 END AS w FROM (SELECT DISTINCT symbol FROM prices)),
r AS (SELECT rets.date, symbol, sr, w FROM rets JOIN wt USING (symbol) WHERE w IS NOT NULL AND sr IS NOT NULL),
full_days AS (SELECT date FROM r GROUP BY date HAVING COUNT(*) = 4),
rr AS (SELECT r.* FROM r JOIN full_days USING (date)),
c AS (SELECT a.w * b.w * COVAR_SAMP(a.sr, b.sr) AS t FROM rr a JOIN rr b USING (date) GROUP BY a.symbol, b.symbol, a.w, b.w)""") + """
SELECT (SELECT COUNT(*) FROM full_days) AS n_days, ROUND((SELECT SUM(m) FROM (SELECT ANY_VALUE(w) * AVG(sr) AS m FROM rr GROUP BY symbol)), 6) AS portfolio_return,
  ROUND((SELECT SUM(t) FROM c), 6) AS portfolio_variance""")
def _(spark, sf):
    weights = spark.createDataFrame([("ECONOMY", 0.3), ("LARGE", 0.2), ("SMALL", 0.1), ("PROMO", 0.4)], "symbol string, weight double")
    return rounded(pf.markowitz(returns(spark, sf), weights), [])


@query("treynor_black", with_(*BASE, """f AS (SELECT symbol, REGR_INTERCEPT(ye, xe) AS alpha, (REGR_SYY(ye, xe) - REGR_SXY(ye, xe) ** 2 / REGR_SXX(ye, xe)) / (COUNT(*) - 2) AS v
  FROM al WHERE index_key = 'gspc' GROUP BY symbol)""") + """
SELECT symbol, ROUND(alpha, 6) AS alpha, ROUND(SQRT(v), 6) AS residual_std, ROUND(alpha / v / (SELECT SUM(alpha / v) FROM f), 5) AS weight FROM f""")
def _(spark, sf):
    fits = reg.fit_scl(aligned(spark, sf).filter(F.col("index_key") == "gspc"), BY)
    t = pf.treynor_black(fits, BY)
    return t.select("symbol", F.round("alpha", 6).alias("alpha"), F.round("residual_std", 6).alias("residual_std"), F.round("weight", 5).alias("weight"))
