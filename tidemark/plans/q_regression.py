"""Regression, factor and event-study queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import finance as fin
from ..operators import regression as reg
from ..operators import returns as ret
from ..session import cut_lineage
from ..sources import views
from .cte import GRID, INDICES, PRICES, RISK_FREE, with_
from .q_returns import BY, rounded
from .q_windows import WEEKLY, r
from .registry import query

PAIR = ["symbol", "index_key"]
FACTORS = ["market", "smb", "hml"]

ALIGNED = """sr AS (SELECT symbol, date, LN(adj_close / LAG(adj_close) OVER w) AS y FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)),
ir0 AS (SELECT index_key, date, LN(adj_close / LAG(adj_close) OVER w) AS x, LAG(date) OVER w AS x_from FROM indices WINDOW w AS (PARTITION BY index_key ORDER BY date)),
ir AS (SELECT i.*, POW(1 + COALESCE(rf.rate, 0), 1 / 252.0) - 1 AS rfd FROM ir0 i ASOF LEFT JOIN risk_free rf ON i.date >= rf.date),
al AS (SELECT symbol, index_key, sr.date, y, x, y - rfd AS ye, x - rfd AS xe, x_from FROM sr JOIN ir USING (date) WHERE y IS NOT NULL AND x IS NOT NULL)"""
BASE = (PRICES, INDICES, RISK_FREE, ALIGNED)


def line(y: str, x: str, extra: str = "") -> str:
    return f"""COUNT(*) AS n_obs, REGR_INTERCEPT({y}, {x}) AS alpha, REGR_SLOPE({y}, {x}) AS beta, REGR_R2({y}, {x}) AS r_squared,
  SQRT((REGR_SYY({y}, {x}) - REGR_SXY({y}, {x}) ** 2 / REGR_SXX({y}, {x})) / (COUNT(*) - 2)) AS residual_std,
  REGR_SXX({y}, {x}) AS sxx, AVG({x}) AS mx"""


DERIVED = """n_obs, ROUND(alpha, 6) AS alpha, ROUND(beta, 6) AS beta, ROUND(r_squared, 6) AS r_squared, ROUND(residual_std, 6) AS residual_std,
  ROUND(residual_std * SQRT(1.0 / n_obs + mx * mx / sxx), 6) AS alpha_stderr, ROUND(residual_std / SQRT(sxx), 6) AS beta_stderr,
  ROUND(alpha / (residual_std * SQRT(1.0 / n_obs + mx * mx / sxx)), 6) AS alpha_tstat, ROUND(beta / (residual_std / SQRT(sxx)), 6) AS beta_tstat,
  ROUND(POW(1 + alpha, 252) - 1, 2) AS alpha_annual, ROUND(SIGN(beta) * SQRT(r_squared), 6) AS correlation,
  ROUND(1 - r_squared, 6) AS firm_specific_share, ROUND(alpha / residual_std, 6) AS information_ratio"""


def aligned(spark, sf, daily=None):
    """Written once: the fits read it several times."""
    return cut_lineage(reg.aligned_returns(*(daily or (f(spark, sf) for f in (views.prices, views.indices, views.risk_free)))))


@query("fit_scl", with_(*BASE, f"f AS (SELECT symbol, index_key, {line('ye', 'xe')} FROM al GROUP BY symbol, index_key)") + f"SELECT symbol, index_key, {DERIVED} FROM f")
def _(spark, sf):
    fit = reg.fit_scl(aligned(spark, sf), PAIR)
    return rounded(fit.withColumn("alpha_annual", r(F.col("alpha_annual"), 2)), PAIR)


@query("residual_series", with_(*BASE, "f AS (SELECT symbol, index_key, REGR_INTERCEPT(ye, xe) AS a, REGR_SLOPE(ye, xe) AS b FROM al GROUP BY ALL)") + """
SELECT symbol, index_key, date, ROUND(ye - (a + b * xe), 6) AS residual FROM al JOIN f USING (symbol, index_key)""")
def _(spark, sf):
    a = aligned(spark, sf)
    return rounded(reg.residuals(a, reg.fit_scl(a, PAIR), PAIR).select(*PAIR, "date", "residual"), [*PAIR, "date"])


@query("rolling_beta", with_(*BASE, """
b AS (SELECT symbol, index_key, date, CASE WHEN COUNT(*) OVER (w ROWS 125 PRECEDING) = 126 THEN COVAR_SAMP(ye, xe) OVER (w ROWS 125 PRECEDING) / VAR_SAMP(xe) OVER (w ROWS 125 PRECEDING) END AS rb
  FROM al WINDOW w AS (PARTITION BY symbol, index_key ORDER BY date))""") + """
SELECT symbol, index_key, date, ROUND(rb, 6) AS rolling_beta, ROUND(rb - LAG(rb, 125) OVER (PARTITION BY symbol, index_key ORDER BY date), 6) AS beta_delta FROM b""")
def _(spark, sf):
    return rounded(reg.rolling_beta(aligned(spark, sf), PAIR), [*PAIR, "date"])


@query("abnormal_return", with_(*BASE, "f AS (SELECT symbol, index_key, REGR_INTERCEPT(y, x) AS a, REGR_SLOPE(y, x) AS b FROM al WHERE date < DATE '1999-01-04' GROUP BY ALL)") + """
SELECT symbol, index_key, date, ROUND(y - (a + b * x), 6) AS abnormal FROM al JOIN f USING (symbol, index_key) WHERE date >= DATE '1999-01-04'""")
def _(spark, sf):
    return rounded(abnormal(spark, sf).select(*PAIR, "date", "abnormal"), [*PAIR, "date"])


def abnormal(spark, sf):
    a = aligned(spark, sf)
    cut = F.lit("1999-01-04").cast("date")
    fit = reg.fit_scl(a.filter(F.col("date") < cut), PAIR, "y", "x")
    return reg.residuals(a.filter(F.col("date") >= cut), fit, PAIR, "y", "x", "abnormal")


@query("car", with_(*BASE, "f AS (SELECT symbol, index_key, REGR_INTERCEPT(y, x) AS a, REGR_SLOPE(y, x) AS b FROM al WHERE date < DATE '1999-01-04' GROUP BY ALL)",
                    "e AS (SELECT symbol, index_key, y - (a + b * x) AS e FROM al JOIN f USING (symbol, index_key) WHERE date >= DATE '1999-01-04')") + """
SELECT symbol, index_key, ROUND(SUM(e), 6) AS car, ROUND(AVG(e), 6) AS mean_abnormal, ROUND(STDDEV_SAMP(e), 6) AS std_abnormal, COUNT(*) AS n_days,
  ROUND(SUM(e) / (STDDEV_SAMP(e) * SQRT(COUNT(*))), 6) AS tstat FROM e GROUP BY symbol, index_key""")
def _(spark, sf):
    return rounded(reg.cumulative_abnormal(abnormal(spark, sf), PAIR), PAIR)


FACTOR_SQL = """fr AS (SELECT date, MAX(CASE WHEN index_key = 'gspc' THEN x END) AS market, MAX(CASE WHEN index_key = 'rut' THEN x END) - MAX(CASE WHEN index_key = 'gspc' THEN x END) AS smb,
  MAX(CASE WHEN index_key = 'iwd' THEN x END) - MAX(CASE WHEN index_key = 'iwf' THEN x END) AS hml FROM ir0 WHERE x IS NOT NULL GROUP BY date)"""


@query("factor_spreads", with_(*BASE, FACTOR_SQL) + "SELECT date, ROUND(smb, 6) AS smb, ROUND(hml, 6) AS hml FROM fr WHERE market IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL")
def _(spark, sf):
    return rounded(reg.factor_returns(views.indices(spark, sf)).select("date", "smb", "hml"), ["date"])


def factor_rows(spark, sf):
    """Excess stock returns with the three factor returns of the day."""
    f = reg.daily_risk_free(reg.factor_returns(views.indices(spark, sf)), views.risk_free(spark, sf))
    f = f.withColumn("market", F.col("market") - F.col("rf_daily"))
    prev = views.market(spark, sf).select("date", F.lag("date").over(ret.history([F.lit(0)])).alias("x_from"))
    s = views.prices(spark, sf).select("symbol", "date", ret.log_return(BY).alias("y"))
    j = s.join(f, "date").join(prev, "date")
    return cut_lineage(j.select("symbol", "date", (F.col("y") - F.col("rf_daily")).alias("ye"), *FACTORS, "x_from"))


# normal equations on centred products, solved by cofactors
MULTI_SQL = """fx AS (SELECT fr.date, fr.market - rfd AS m, smb AS s, hml AS h, rfd, x_from FROM fr JOIN ir ON ir.date = fr.date AND index_key = 'gspc'
  WHERE smb IS NOT NULL AND hml IS NOT NULL),
rows_ AS (SELECT symbol, sr.date, y - rfd AS e, m, s, h, x_from FROM sr JOIN fx USING (date) WHERE y IS NOT NULL)"""


def cofactor_sql(source: str, keys: str) -> str:
    return f"""
c0 AS (SELECT {keys}, COUNT(*) AS n, AVG(m) AS am, AVG(s) AS as_, AVG(h) AS ah, AVG(e) AS ae,
  REGR_SXX(e, m) AS mm, REGR_SXX(e, s) AS ss, REGR_SXX(e, h) AS hh, REGR_SXY(m, s) AS ms, REGR_SXY(m, h) AS mh, REGR_SXY(s, h) AS sh,
  REGR_SXY(e, m) AS em, REGR_SXY(e, s) AS es, REGR_SXY(e, h) AS eh, REGR_SYY(e, m) AS ee FROM {source} GROUP BY {keys}),
c1 AS (SELECT *, mm * (ss * hh - sh * sh) - ms * (ms * hh - sh * mh) + mh * (ms * sh - ss * mh) AS det FROM c0),
c2 AS (SELECT *, (ss * hh - sh * sh) / det AS i11, (mh * sh - ms * hh) / det AS i12, (ms * sh - mh * ss) / det AS i13,
  (mm * hh - mh * mh) / det AS i22, (ms * mh - mm * sh) / det AS i23, (mm * ss - ms * ms) / det AS i33 FROM c1),
c3 AS (SELECT *, i11 * em + i12 * es + i13 * eh AS bm, i12 * em + i22 * es + i23 * eh AS bs, i13 * em + i23 * es + i33 * eh AS bh FROM c2),
c4 AS (SELECT *, ae - bm * am - bs * as_ - bh * ah AS alpha, ee - bm * em - bs * es - bh * eh AS res FROM c3),
fit AS (SELECT {keys}, CAST(n AS DOUBLE) AS n_obs, alpha, bm AS beta_market, bs AS beta_smb, bh AS beta_hml, 1 - res / ee AS r_squared,
  1 - (res / ee) * (n - 1) / (n - 4) AS adj_r_squared, SQRT(res / (n - 4)) AS residual_std,
  SQRT(res / (n - 4) * i11) AS stderr_market, SQRT(res / (n - 4) * i22) AS stderr_smb, SQRT(res / (n - 4) * i33) AS stderr_hml FROM c4)"""


FIT_COLS = ["alpha", "beta_market", "beta_smb", "beta_hml", "r_squared", "adj_r_squared", "residual_std", "stderr_market", "stderr_smb", "stderr_hml"]


@query("fit_multifactor", with_(*BASE, FACTOR_SQL, MULTI_SQL, cofactor_sql("rows_", "symbol")) +
       f"SELECT symbol, n_obs, {', '.join(f'ROUND({c}, 6) AS {c}' for c in FIT_COLS)} FROM fit")
def _(spark, sf):
    fit = reg.fit_multifactor(factor_rows(spark, sf), BY, FACTORS)
    return rounded(fit.select("symbol", "n_obs", *FIT_COLS), BY)


@query("multifactor_features", with_(*BASE, GRID, FACTOR_SQL, MULTI_SQL, """
wr AS (SELECT g.as_of, rows_.* FROM rows_ JOIN grid g ON date < g.as_of AND x_from >= g.as_of - INTERVAL 24 MONTH)""", cofactor_sql("wr", "symbol, as_of")) +
       "SELECT symbol, as_of, n_obs, " + ", ".join(f"ROUND({c}, 5) AS {c}" for c in FIT_COLS) + " FROM fit WHERE n_obs >= 5")
def _(spark, sf):
    fit = reg.multifactor_features(factor_rows(spark, sf), WEEKLY, "symbol", FACTORS)
    return rounded(fit.select("symbol", "as_of", "n_obs", *FIT_COLS), ["symbol", "as_of"], 5)


@query("multifactor_expected", with_(*BASE, FACTOR_SQL, MULTI_SQL, cofactor_sql("rows_", "symbol"),
       "act AS (SELECT symbol, AVG(y) * 252 AS actual_return FROM sr GROUP BY symbol)") + """
SELECT symbol, ROUND(0.04 + beta_market * 0.08 + beta_smb * 0.02, 6) AS expected_return, ROUND(1 - beta_market - beta_smb - beta_hml, 6) AS risk_free_weight,
  ROUND(actual_return, 6) AS actual_return, ROUND(0.04 + beta_market * 0.08 + beta_smb * 0.02 - actual_return, 6) AS arbitrage_profit FROM fit JOIN act USING (symbol)""")
def _(spark, sf):
    fit = reg.fit_multifactor(factor_rows(spark, sf), BY, FACTORS)
    premia = spark.createDataFrame([("market", 0.08), ("smb", 0.02)], "factor string, premium double")
    actual = ret.with_returns(views.prices(spark, sf), BY).groupBy("symbol").agg((F.avg("lr") * 252).alias("actual_return"))
    return rounded(reg.multifactor_expected(reg.long_betas(fit, BY, FACTORS), premia, BY, 0.04, actual), BY)


EVENT_SQL = """n AS (SELECT g.as_of, al.*, ROW_NUMBER() OVER (PARTITION BY symbol, index_key, g.as_of ORDER BY date DESC) AS back,
  COUNT(*) OVER (PARTITION BY symbol, index_key, g.as_of) AS cnt FROM al JOIN grid g ON date < g.as_of AND x_from >= g.as_of - INTERVAL 24 MONTH),
ef AS (SELECT symbol, index_key, as_of, REGR_INTERCEPT(y, x) AS a, REGR_SLOPE(y, x) AS b FROM n WHERE cnt >= 283 AND back > 21 AND back <= 273 GROUP BY ALL),
ev AS (SELECT symbol, index_key, as_of, SUM(y - (a + b * x)) AS car_21d, STDDEV_SAMP(y - (a + b * x)) AS abnormal_std,
  SUM(y - (a + b * x)) / (STDDEV_SAMP(y - (a + b * x)) * SQRT(21)) AS car_tstat FROM n JOIN ef USING (symbol, index_key, as_of) WHERE back <= 21 GROUP BY ALL)"""


@query("event_features", with_(*BASE, GRID, EVENT_SQL) + """
SELECT symbol, index_key, as_of, ROUND(car_21d, 5) AS car_21d, ROUND(car_tstat, 5) AS car_tstat, ROUND(abnormal_std, 5) AS abnormal_std FROM ev""")
def _(spark, sf):
    f = reg.windowed_fits(aligned(spark, sf), WEEKLY, PAIR).filter(F.col("car_21d").isNotNull())
    return rounded(f.select(*PAIR, "as_of", "car_21d", "car_tstat", "abnormal_std"), [*PAIR, "as_of"], 5)


SCL_AT = """wf AS (SELECT symbol, index_key, as_of, COUNT(*) AS n_obs, REGR_INTERCEPT(ye, xe) AS alpha, REGR_SLOPE(ye, xe) AS beta, REGR_R2(ye, xe) AS r_squared,
  SQRT((REGR_SYY(ye, xe) - REGR_SXY(ye, xe) ** 2 / REGR_SXX(ye, xe)) / (COUNT(*) - 2)) AS residual_std FROM n GROUP BY ALL HAVING COUNT(*) >= 3)"""


@query("relative_features", with_(*BASE, GRID, EVENT_SQL, SCL_AT) + """
SELECT symbol, index_key, as_of, n_obs, ROUND(alpha, 5) AS alpha, ROUND(beta, 5) AS beta, ROUND(r_squared, 5) AS r_squared, ROUND(residual_std, 5) AS residual_std,
  ROUND(car_21d, 5) AS car_21d FROM wf LEFT JOIN ev USING (symbol, index_key, as_of)""")
def _(spark, sf):
    f = reg.windowed_fits(aligned(spark, sf), WEEKLY, PAIR)
    return rounded(f.select(*PAIR, "as_of", "n_obs", "alpha", "beta", "r_squared", "residual_std", "car_21d"), [*PAIR, "as_of"], 5)


@query("mrp_estimate", with_(INDICES, "x AS (SELECT index_key, LN(adj_close / LAG(adj_close) OVER (PARTITION BY index_key ORDER BY date)) AS x FROM indices)") + """
SELECT index_key, COUNT(x) AS n, ROUND(GREATEST(0.01, COUNT(x) / (COUNT(x) + 1260) * (AVG(x) * 252 - 0.04) + (1 - COUNT(x) / (COUNT(x) + 1260)) * 0.08), 6) AS mrp FROM x GROUP BY index_key""")
def _(spark, sf):
    return rounded(reg.mrp_estimate(views.indices(spark, sf), F.lit(0.04), ["index_key"]), ["index_key"])


@query("sml_valuation", with_(*BASE, "f AS (SELECT symbol, REGR_SLOPE(ye, xe) AS beta, AVG(y) * 252 AS forecast FROM al WHERE index_key = 'gspc' GROUP BY symbol)") + """
SELECT symbol, ROUND(beta, 6) AS beta, ROUND(forecast, 6) AS forecast, ROUND(0.04 + beta * 0.08, 6) AS fair_return, ROUND(forecast - 0.04 - beta * 0.08, 6) AS alpha,
  CASE WHEN forecast - 0.04 - beta * 0.08 > 0.01 THEN 'underpriced' WHEN forecast - 0.04 - beta * 0.08 < -0.01 THEN 'overpriced' ELSE 'fairly_priced' END AS verdict,
  ROUND(0.05 + beta * (0.12 - 0.05), 6) AS zero_beta_return, ROUND(1000 * (0.04 + beta * 0.08), 4) AS fair_profit FROM f""")
def _(spark, sf):
    a = aligned(spark, sf).filter(F.col("index_key") == "gspc")
    f = reg.fit_scl(a, BY).select("symbol", "beta").join(a.groupBy("symbol").agg((F.avg("y") * 252).alias("forecast")), "symbol")
    fair = fin.sml_return(F.col("beta"), F.lit(0.04), F.lit(fin.DEFAULT_MRP))
    alpha = F.col("forecast") - fair
    return f.select("symbol", r(F.col("beta")).alias("beta"), r(F.col("forecast")).alias("forecast"), r(fair).alias("fair_return"), r(alpha).alias("alpha"),
                    fin.sml_verdict(alpha).alias("verdict"), r(fin.zero_beta_return(F.col("beta"), F.lit(0.05), F.lit(0.12))).alias("zero_beta_return"),
                    r(fin.fair_profit(F.lit(1000.0), F.col("beta"), F.lit(0.04), F.lit(fin.DEFAULT_MRP)), 4).alias("fair_profit"))


@query("capm_features", with_(*BASE, GRID, EVENT_SQL, SCL_AT, """
pr AS (SELECT index_key, as_of, COUNT(*) AS n, AVG(x) AS m, (SELECT ARG_MAX(rate, rf.date) FROM risk_free rf WHERE rf.date < as_of) AS rf
  FROM ir0 JOIN grid ON date < as_of AND x_from >= as_of - INTERVAL 24 MONTH WHERE x IS NOT NULL GROUP BY index_key, as_of),
pm AS (SELECT *, GREATEST(0.01, n / (n + 1260) * (m * 252 - COALESCE(rf, 0.04)) + (1 - n / (n + 1260)) * 0.08) AS mrp FROM pr WHERE n >= 252),
yr AS (SELECT symbol, date, adj_close / LAG(adj_close, 252) OVER w - 1 AS realised, LEAD(date) OVER w AS nxt FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)),
ya AS (SELECT symbol, as_of, realised FROM yr JOIN grid ON date < as_of AND (nxt IS NULL OR nxt >= as_of) WHERE realised IS NOT NULL)""") + """
SELECT symbol, index_key, as_of, ROUND(COALESCE(rf, 0.04) + beta * mrp, 5) AS fair_return, ROUND(mrp, 5) AS market_risk_premium,
  ROUND(realised - (COALESCE(rf, 0.04) + beta * mrp), 5) AS alpha_realised, 0.0 AS mrp_is_default FROM wf JOIN pm USING (index_key, as_of) JOIN ya USING (symbol, as_of)""")
def _(spark, sf):
    px, ix, rf = (cut_lineage(f(spark, sf)) for f in (views.prices, views.indices, views.risk_free))
    fits = reg.windowed_fits(aligned(spark, sf, (px, ix, rf)), WEEKLY, PAIR)
    prem = reg.premium_at(ix, WEEKLY, reg.rate_at(WEEKLY, rf))
    return rounded(reg.capm_features(fits, px, prem, WEEKLY), [*PAIR, "as_of"], 5)
