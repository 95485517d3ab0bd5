"""Return and risk aggregates per key.

Bars hold one row per (key, day), so a key's history is bounded by the
calendar and windows partitioned by key stay small at any data size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.finance import NORMAL_1PCT, TRADING_DAYS, annualise, daily_rate, ratio
from .windows import EQUITY_MONTHS, Grid, asof_calendar, edges

LOOKBACKS = (5, 21, 63, 126, 252, 504)
SMA_LOOKBACKS = (21, 63, 126, 252)


def history(by: list[str], date_col: str = "date"):
    return W.partitionBy(*by).orderBy(date_col)


def simple_return(by: list[str], price: str = "adj_close") -> Column:
    return F.col(price) / F.lag(price).over(history(by)) - 1


def log_return(by: list[str], price: str = "adj_close") -> Column:
    return F.log(F.col(price) / F.lag(price).over(history(by)))


def with_returns(bars: DataFrame, by: list[str], price: str = "adj_close") -> DataFrame:
    """Bars with simple (sr) and log (lr) returns and the row number (rn)."""
    return bars.select("*", simple_return(by, price).alias("sr"), log_return(by, price).alias("lr"),
                       F.row_number().over(history(by)).alias("rn"))


def forward_log_return(bars: DataFrame, horizon: int, by: list[str], price: str = "adj_close") -> DataFrame:
    if horizon < 1:
        raise ValueError("horizon must be at least one row")
    ahead = F.lead(price, horizon).over(history(by))
    return bars.withColumn("forward_log_return", F.log(ahead) - F.log(F.col(price)))


def holding_period_return(bars: DataFrame, by: list[str], price: str = "adj_close", income: str | None = None) -> DataFrame:
    paid = F.sum(income) if income else F.lit(0.0)
    g = bars.groupBy(*by).agg(F.min_by(price, "date").alias("p_start"), F.max_by(price, "date").alias("p_end"),
                              paid.alias("income"))
    start = F.when(F.col("p_start") <= 0, F.raise_error(F.lit("starting price must be positive")).cast("double")) \
             .otherwise(F.col("p_start"))
    return g.withColumn("hpr", (F.col("p_end") - start + F.col("income")) / start)


def annual_return(bars: DataFrame, by: list[str], price: str = "adj_close") -> DataFrame:
    """Total return per key and its annual rate over the calendar span."""
    g = bars.groupBy(*by).agg((F.max_by(price, "date") / F.min_by(price, "date") - 1).alias("total_return"),
                              (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"))
    return g.withColumn("annual_return", annualise(F.col("total_return"), F.col("years")))


def mean_returns(rets: DataFrame, by: list[str], r: str = "sr") -> DataFrame:
    c = F.col(r)
    ruined = F.max(F.when(c.isNotNull(), c <= -1))
    geo = F.expm1(F.avg(F.when(c > -1, F.log1p(c))))
    return rets.groupBy(*by).agg(F.avg(c).alias("arith_mean"), F.when(ruined, F.lit(-1.0)).otherwise(geo).alias("geo_mean"))


def scenario_moments(scenarios: DataFrame, p: str = "p", r: str = "r") -> DataFrame:
    """Mean and variance of a scenario table whose probabilities sum to one."""
    e, e2 = F.sum(F.col(p) * F.col(r)), F.sum(F.col(p) * F.col(r) * F.col(r))
    total = F.sum(p)
    checked = F.when(F.abs(total - 1) > 1e-8, F.raise_error(F.lit("probabilities must sum to 1")).cast("double")).otherwise(e)
    return scenarios.agg(checked.alias("expected_return"), (e2 - e * e * (2 - total)).alias("variance"))


def volatility(rets: DataFrame, by: list[str], r: str = "lr") -> DataFrame:
    sd = F.stddev_samp(r)
    return rets.groupBy(*by).agg(sd.alias("daily_vol"), (sd * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("annual_vol"))


def sharpe(rets: DataFrame, by: list[str], annual_rf: float = 0.0, r: str = "lr") -> DataFrame:
    x = F.col(r) - daily_rate(F.lit(annual_rf))
    return rets.groupBy(*by).agg((ratio(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("sharpe"))


def var_normal(rets: DataFrame, by: list[str], r: str = "lr", quantile: float = NORMAL_1PCT) -> DataFrame:
    return rets.groupBy(*by).agg((F.avg(r) - quantile * F.stddev_samp(r)).alias("var_normal"))


def var_historical(rets: DataFrame, by: list[str], r: str = "lr", level: float = 0.01) -> DataFrame:
    return rets.groupBy(*by).agg(F.percentile(F.col(r), F.lit(level)).alias("var_hist"))


def expected_shortfall(rets: DataFrame, by: list[str], r: str = "lr", level: float = 0.01) -> DataFrame:
    cut = var_historical(rets, by, r, level)
    return (rets.join(cut, by).filter(F.col(r) <= F.col("var_hist")).groupBy(*by)
            .agg(F.avg(r).alias("expected_shortfall"), F.count("*").alias("n_tail")))


def drawdown(bars: DataFrame, by: list[str], price: str = "adj_close") -> DataFrame:
    peak = F.max(price).over(history(by).rowsBetween(W.unboundedPreceding, 0))
    return bars.select(*by, (F.col(price) / peak - 1).alias("_dd")).groupBy(*by).agg(F.min("_dd").alias("max_drawdown"))


def skew_kurt(rets: DataFrame, by: list[str], r: str = "lr") -> DataFrame:
    """Population skewness and excess kurtosis, as Spark defines them."""
    n = F.count(r)
    return rets.groupBy(*by).agg(F.when(n > 2, F.skewness(r)).alias("skew"), F.when(n > 3, F.kurtosis(r)).alias("kurt"))


def liquidity(bars: DataFrame, by: list[str], price: str = "adj_close", volume: str = "volume") -> DataFrame:
    """Volume of the last 21 rows against the last 252, and log dollar volume."""
    recent = F.avg(volume).over(history(by).rowsBetween(-20, 0))
    base = F.avg(volume).over(history(by).rowsBetween(-251, 0))
    return bars.select("*", F.when(base > 0, recent / base).alias("rel_volume_21d"),
                       F.when(recent > 0, F.log1p(recent * F.col(price))).alias("log_dollar_volume"))


# --- trailing statistics in constant time per row ---------------------------

def running_sums(df: DataFrame, by: list[str], terms: dict[str, Column], date_col: str = "date") -> DataFrame:
    """Cumulative sums per key.  A trailing window is then the difference of
    two of them, so its cost does not grow with the window length."""
    w = history(by, date_col).rowsBetween(W.unboundedPreceding, 0)
    return df.select("*", *[F.sum(F.coalesce(c, F.lit(0.0))).over(w).alias(n) for n, c in terms.items()])


def with_lags(df: DataFrame, by: list[str], sums: list[str], offsets: set[int], date_col: str = "date") -> DataFrame:
    """Earlier values of all running sums, one packed ``lag`` per offset."""
    packed, w = F.struct(*sums), history(by, date_col)
    return df.select("*", *[F.lag(packed, n).over(w).alias(f"_L{n}") for n in sorted(offsets)])


def trailing(name: str, rows: int, offset: int = 0) -> Column:
    """Sum over the ``rows`` rows that end ``offset`` rows before this one.
    Needs ``with_lags`` for ``offset`` and ``rows + offset``."""
    head = F.coalesce(F.col(f"_L{offset}")[name], F.lit(0.0)) if offset else F.col(name)
    return head - F.coalesce(F.col(f"_L{rows + offset}")[name], F.lit(0.0))


def price_features(bars: DataFrame, grid: Grid, *, by: str = "symbol", risk_free: DataFrame | None = None,
                   anomalies: bool = True, window_months: int = EQUITY_MONTHS) -> DataFrame:
    """One row of price features per (key, as_of).

    Row-count features are trailing, so they are computed once per bar from
    cumulative sums and picked at the as-of edge.  Features that depend on the
    path inside the calendar window (drawdown, quantiles, RSI) come from one
    Arrow batch per key, see ``path_features``.
    """
    keys = [by]
    w = history(keys)
    base = with_returns(bars.filter(F.col("adj_close").isNotNull()), keys)
    r = F.col("lr")
    has_volume = "volume" in bars.columns
    terms = {"_s1": r, "_s2": r * r, "_p": F.col("adj_close"),
             "_a": F.col("sr"), "_g": F.log1p(F.col("sr"))}
    if has_volume:
        terms["_v"] = F.col("volume")
    base = running_sums(base, keys, terms)
    wide = with_lags(base, keys, list(terms), {50, 200, *LOOKBACKS, *SMA_LOOKBACKS})

    out: dict[str, Column] = {}
    n_ret = F.col("rn") - 1
    for lb in LOOKBACKS:
        out[f"ret_{lb}d"] = F.log(F.col("adj_close") / F.lag("adj_close", lb).over(w))
        n = F.least(n_ret, F.lit(lb))
        s1, s2 = trailing("_s1", lb), trailing("_s2", lb)
        var = F.greatest((s2 - s1 * s1 / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))
        out[f"_sd_{lb}"] = F.sqrt(var)
        out[f"_mean_{lb}"] = s1 / F.nullif(n, F.lit(0))
        out[f"vol_{lb}d"] = F.when(n >= max(5, lb // 4), F.sqrt(var) * (TRADING_DAYS ** 0.5))
    n = F.nullif(F.least(n_ret, F.lit(252)), F.lit(0))
    # third and fourth moments over the frame itself: differences of running sums lose their digits
    year = w.rowsBetween(-251, 0)
    out["skew_252d"] = F.when(n > 2, F.nanvl(F.skewness("lr").over(year), F.lit(None)))
    out["kurtosis_252d"] = F.when(n > 3, F.nanvl(F.kurtosis("lr").over(year), F.lit(None)))
    out["arith_geo_gap"] = trailing("_a", 252) / n - F.expm1(trailing("_g", 252) / n)
    for lb in SMA_LOOKBACKS:
        out[f"sma_dist_{lb}d"] = F.when(F.col("rn") > lb, F.col("adj_close") / (trailing("_p", lb) / lb) - 1)
    for lb in (50, 200):
        ma = trailing("_p", lb) / lb
        out[f"ma_cross_{lb}d"] = F.when(F.col("rn") >= lb, F.when(F.col("adj_close") >= ma, 1.0).otherwise(-1.0))
    tail = w.rowsBetween(-251, 0)
    out["pct_from_52w_high"] = F.when(F.col("rn") > 1, F.col("adj_close") / F.max("adj_close").over(tail) - 1)
    out["pct_from_52w_low"] = F.when(F.col("rn") > 1, F.col("adj_close") / F.min("adj_close").over(tail) - 1)
    if anomalies:
        out["momentum_12_1"] = F.log(F.lag("adj_close", 21).over(w) / F.lag("adj_close", 252).over(w))
        out["reversal_24_36m"] = -F.log(F.lag("adj_close", 252).over(w) / F.lag("adj_close", 756).over(w))
    if has_volume:
        recent = trailing("_v", 21) / F.least(F.col("rn"), F.lit(21))
        year = trailing("_v", 252) / F.least(F.col("rn"), F.lit(252))
        out["liq_rel_volume_21d"] = F.when(year > 0, recent / year)
        out["liq_log_dollar_volume"] = F.when(recent > 0, F.log1p(recent * F.col("adj_close")))
    wide = wide.select(by, "date", "adj_close", "rn", *[c.alias(k) for k, c in out.items()])
    from .technical import crossover_age  # the two modules share their frames
    wide = crossover_age(wide, keys, 50, rn="rn", state="ma_cross_50d", out="ma_cross_age_50d")

    at = edges(wide, grid, by=keys).filter(F.col("date") >= F.add_months("as_of", -window_months)).filter(F.col("rn") >= 2)
    if risk_free is not None:
        at = asof_calendar(at, risk_free, left_day="as_of", right_day="date", values=["rate"], strict=True)
        rf = F.coalesce(F.col("rate"), F.lit(0.0))
    else:
        rf = F.lit(0.0)
    root = F.lit(float(TRADING_DAYS) ** 0.5)
    at = (at.withColumn("sharpe_252d", ratio(F.col("_mean_252") - daily_rate(rf), F.col("_sd_252")) * root)
          .withColumn("sharpe_63d", ratio(F.col("_mean_63") - daily_rate(rf), F.col("_sd_63")) * root)
          .withColumn("var_normal_1pct", F.col("_mean_252") - NORMAL_1PCT * F.col("_sd_252"))
          .withColumn("vol_ratio_21_252", ratio(F.col("vol_21d"), F.col("vol_252d"))))
    paths = path_features(base, by, grid, window_months)
    at = at.join(paths, [by, "as_of"], "left").withColumn("var_gap", F.col("var_hist_1pct") - F.col("var_normal_1pct"))
    return at.drop(*[c for c in at.columns if c.startswith("_")], "rn", "rate")


def path_features(base: DataFrame, by: str, grid: Grid, window_months: int) -> DataFrame:
    """Drawdowns, historical VaR, shortfall and RSI at each as-of edge.

    These depend on the path inside a window, so they run as one Arrow batch
    per key: a key's bars are daily, so a group is bounded by the calendar.
    """
    points = pd.date_range(grid.start, grid.end, freq=f"{grid.step}D")
    starts = (points - pd.DateOffset(months=window_months)).to_numpy()
    points = points.to_numpy()
    decay = 13.0 / 14.0

    def worst(p: np.ndarray) -> float:
        return float((p / np.maximum.accumulate(p) - 1).min())

    def rsi(p: np.ndarray) -> float:
        if len(p) < 15:
            return np.nan
        d = np.diff(p)
        weight = decay ** np.arange(len(d) - 1, -1, -1) / 14.0
        weight[0] *= 14.0
        gain, loss = float(weight @ np.maximum(d, 0)), float(weight @ np.maximum(-d, 0))
        return 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)

    def per_key(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        days = pd.to_datetime(pdf["date"]).to_numpy()
        p, r = pdf["p"].to_numpy(float), pdf["r"].to_numpy(float)
        ends, begins = np.searchsorted(days, points, "left"), np.searchsorted(days, starts, "left")
        rows = []
        for as_of, end, begin in zip(points, ends, begins):
            if end - begin < 1:
                continue
            lo = max(end - 252, 0)
            rs = r[lo:end]
            rs = rs[np.isfinite(rs)]
            q = float(np.quantile(rs, 0.01)) if len(rs) else np.nan
            es = float(rs[rs <= q].mean()) if len(rs) else np.nan
            rows.append((pdf[by].iloc[0], as_of, q, es, worst(p[lo:end]), worst(p[begin:end]), rsi(p[begin:end])))
        out = pd.DataFrame(rows, columns=[by, "as_of", "var_hist_1pct", "expected_shortfall",
                                          "max_drawdown_252d", "max_drawdown_full", "rsi_14d"])
        out["as_of"] = pd.to_datetime(out["as_of"]).dt.date
        return out

    kind = base.schema[by].dataType.simpleString()
    schema = (f"{by} {kind}, as_of date, var_hist_1pct double, expected_shortfall double, "
              "max_drawdown_252d double, max_drawdown_full double, rsi_14d double")
    out = (base.select(by, "date", F.col("adj_close").alias("p"), F.col("lr").alias("r"))
           .groupBy(by).applyInPandas(per_key, schema))
    return out.select(by, "as_of", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in out.columns[2:]])


def index_features(indices: DataFrame, grid: Grid, keys: list[str], risk_free: DataFrame | None = None) -> DataFrame:
    """The price block per index, one row per as_of with key-prefixed columns."""
    long = price_features(indices, grid, by="index_key", risk_free=risk_free, anomalies=False, window_months=24)
    names = [c for c in long.columns if c not in ("index_key", "as_of", "date", "adj_close")]
    aggs = [F.max(F.when(F.col("index_key") == k, F.col(c))).alias(f"idx_{k}_{c}") for k in keys for c in names]
    return long.groupBy("as_of").agg(*aggs)
