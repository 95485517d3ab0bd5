"""Regression, factor and event-study jobs.

All fits come from sums of cross-products that Spark aggregates (or that a
running sum differences per row); only k x k systems are solved in Python, in
Arrow batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.finance import (DEFAULT_MRP, TRADING_DAYS, daily_rate, market_risk_premium, ratio, sml_return)
from .returns import history, log_return, running_sums, trailing, with_lags
from .windows import INDEX_MONTHS, Grid, asof_calendar, asof_join, edges

ESTIMATION, EVENT = 252, 21
SUMS = ("n", "x", "y", "xx", "xy", "yy")


def inner_align(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on the shared keys, rows with any null dropped."""
    return left.join(right, on).dropna()


def daily_risk_free(df: DataFrame, risk_free: DataFrame | None, day: str = "date") -> DataFrame:
    """Adds rf_daily: the latest annual rate at or before the day, as a daily rate."""
    if risk_free is None:
        return df.withColumn("rf_daily", F.lit(0.0))
    found = asof_calendar(df, risk_free.filter(F.col("rate").isNotNull()), left_day=day, right_day="date_rf", values=["rate"]) \
        if "date_rf" in risk_free.columns else \
        asof_calendar(df, risk_free.filter(F.col("rate").isNotNull()).withColumnRenamed("date", "date_rf"),
                      left_day=day, right_day="date_rf", values=["rate"])
    return found.withColumn("rf_daily", daily_rate(F.coalesce(F.col("rate"), F.lit(0.0)))).drop("rate")


def aligned_returns(bars: DataFrame, indices: DataFrame, risk_free: DataFrame | None, *, by: str = "symbol") -> DataFrame:
    """(key, index, date) with total (y, x) and excess (ye, xe) log returns.

    Index bars are one row per day and index, so the join adds one row per
    index to each bar.
    """
    s = bars.select(by, "date", log_return([by]).alias("y"), F.col("adj_close").alias("px"))
    m = indices.select("index_key", "date", log_return(["index_key"]).alias("x"), F.col("adj_close").alias("ix"),
                       F.lag("date").over(history(["index_key"])).alias("x_from"))
    m = daily_risk_free(m, risk_free)
    j = inner_align(s.filter(F.col("y").isNotNull()), m.filter(F.col("x").isNotNull()), ["date"])
    return j.select(by, "index_key", "date", "y", "x", (F.col("y") - F.col("rf_daily")).alias("ye"),
                    (F.col("x") - F.col("rf_daily")).alias("xe"), "x_from")


def line_fit(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column, syy: Column) -> dict[str, Column]:
    """Least squares of y on x from the six sums, with its derived figures."""
    n = F.nullif(n, F.lit(0.0))
    mx, my = sx / n, sy / n
    cxx, cxy, cyy = sxx - sx * mx, sxy - sx * my, syy - sy * my
    beta = F.try_divide(cxy, cxx)
    alpha = my - beta * mx
    ss_res = F.greatest(cyy - beta * cxy, F.lit(0.0))
    r2 = 1 - F.try_divide(ss_res, cyy)
    var = ss_res / F.nullif(n - 2, F.lit(0))
    beta_se, alpha_se = F.sqrt(F.try_divide(var, cxx)), F.sqrt(var * (1 / n + F.try_divide(mx * mx, cxx)))
    sd = F.sqrt(var)
    return {
        "alpha": alpha, "beta": beta, "r_squared": r2, "residual_std": sd, "alpha_stderr": alpha_se, "beta_stderr": beta_se,
        "alpha_tstat": F.try_divide(alpha, alpha_se), "beta_tstat": F.try_divide(beta, beta_se),
        "alpha_annual": F.pow(1 + alpha, F.lit(float(TRADING_DAYS))) - 1,
        "correlation": F.signum(beta) * F.sqrt(F.greatest(r2, F.lit(0.0))),
        "firm_specific_share": 1 - r2, "information_ratio": F.try_divide(alpha, sd)}


def fit_scl(aligned: DataFrame, by: list[str], y: str = "ye", x: str = "xe") -> DataFrame:
    """Security characteristic line per group, in one aggregate."""
    c, d = F.col(x), F.col(y)
    sums = aligned.dropna(subset=[x, y]).groupBy(*by).agg(
        F.count("*").alias("n_obs"), F.avg(c).alias("_mx"), F.avg(d).alias("_my"),
        F.regr_sxx(d, c).alias("_cxx"), F.regr_sxy(d, c).alias("_cxy"), F.regr_syy(d, c).alias("_cyy"))
    sums = sums.filter(F.col("n_obs") >= 3)
    n = F.col("n_obs").cast("double")
    fit = line_fit(n, F.col("_mx") * n, F.col("_my") * n, F.col("_cxx") + F.col("_mx") * F.col("_mx") * n,
                   F.col("_cxy") + F.col("_mx") * F.col("_my") * n, F.col("_cyy") + F.col("_my") * F.col("_my") * n)
    return sums.select(*by, "n_obs", *[v.alias(k) for k, v in fit.items()])


def residuals(aligned: DataFrame, fit: DataFrame, by: list[str], y: str = "ye", x: str = "xe", name: str = "residual") -> DataFrame:
    """y - (alpha + beta x) per row; abnormal returns when y and x are totals."""
    return (aligned.join(fit.select(*by, "alpha", "beta"), by)
            .withColumn(name, F.col(y) - (F.col("alpha") + F.col("beta") * F.col(x))))


def cumulative_abnormal(abnormal: DataFrame, by: list[str], name: str = "abnormal") -> DataFrame:
    n, sd, total = F.count(name), F.stddev_samp(name), F.sum(name)
    return abnormal.groupBy(*by).agg(total.alias("car"), F.avg(name).alias("mean_abnormal"), sd.alias("std_abnormal"),
                                     n.alias("n_days"), F.when(n >= 2, ratio(total, sd * F.sqrt(n))).alias("tstat"))


def pair_sums(df: DataFrame, by: list[str], y: str, x: str, tag: str) -> DataFrame:
    a, b = F.col(y), F.col(x)
    return running_sums(df, by, {f"{tag}n": F.lit(1.0), f"{tag}x": b, f"{tag}y": a, f"{tag}xx": b * b, f"{tag}xy": a * b, f"{tag}yy": a * a})


def beta_over(tag: str, rows: int) -> Column:
    t = lambda v: trailing(f"{tag}{v}", rows)
    cov = t("xy") - t("x") * t("y") / rows
    var = t("xx") - t("x") * t("x") / rows
    return F.when((t("n") == rows) & (var > 0), cov / var)


def rolling_beta(aligned: DataFrame, by: list[str], rows: int = 126) -> DataFrame:
    """Trailing cov / var in constant time per row, and its change."""
    s = pair_sums(aligned.dropna(subset=["xe", "ye"]), by, "ye", "xe", "_e")
    s = with_lags(s, by, [f"_e{v}" for v in SUMS], {rows})
    s = s.select(*by, "date", beta_over("_e", rows).alias("rolling_beta"))
    return s.withColumn("beta_delta", F.col("rolling_beta") - F.lag("rolling_beta", rows - 1).over(history(by)))


def event_columns(tag: str = "_t") -> dict[str, Column]:
    """Market model on rows [-273, -21) and the abnormal returns of the last 21."""
    est = lambda v: trailing(f"{tag}{v}", ESTIMATION, offset=EVENT)
    ev = lambda v: trailing(f"{tag}{v}", EVENT)
    fit = line_fit(est("n"), est("x"), est("y"), est("xx"), est("xy"), est("yy"))
    a, b = fit["alpha"], fit["beta"]
    car = ev("y") - EVENT * a - b * ev("x")
    squares = (ev("yy") + EVENT * a * a + b * b * ev("xx") - 2 * a * ev("y") - 2 * b * ev("xy") + 2 * a * b * ev("x"))
    sd = F.sqrt(F.greatest((squares - car * car / EVENT) / (EVENT - 1), F.lit(0.0)))
    return {"car_21d": car, "abnormal_std": sd, "car_tstat": ratio(car, sd * (EVENT ** 0.5))}


def windowed_fits(aligned: DataFrame, grid: Grid, by: list[str], months: int = INDEX_MONTHS) -> DataFrame:
    """SCL, rolling beta and event window per (group, as_of).

    A calendar window is the difference of two running sums: the one at the
    edge and the one at the window start, both found by as-of picks.
    """
    rows = aligned.dropna(subset=["xe", "ye"])
    s = pair_sums(pair_sums(rows, by, "ye", "xe", "_e"), by, "y", "x", "_t")
    sums = [f"_e{v}" for v in SUMS]
    s = with_lags(s, by, [*sums, *[f"_t{v}" for v in SUMS]], {126, EVENT, ESTIMATION + EVENT})
    s = s.select(*by, "date", "x_from", *sums, beta_over("_e", 126).alias("_b"),
                 *[c.alias(f"_{k}") for k, c in event_columns().items()])
    s = s.withColumn("beta_delta", F.col("_b") - F.lag("_b", 125).over(history(by)))
    at = edges(s, grid, by=by).withColumn("_start", F.add_months("as_of", -months))
    before = s.select(*by, "x_from", F.struct(*sums).alias("_cut"))
    at = asof_join(at.filter(F.col("date") >= F.col("_start")), before, by=by, left_time="_start", right_time="x_from",
                   values=["_cut"], strict=True)
    diff = {v: F.col(f"_e{v}") - F.coalesce(F.col(f"_cut._e{v}"), F.lit(0.0)) for v in SUMS}
    at = at.select("*", *[c.alias(f"_w{v}") for v, c in diff.items()]).filter(F.col("_wn") >= 3)
    fit = line_fit(*[F.col(f"_w{v}") for v in SUMS])
    long_enough = F.col("_wn") > 251
    event_ok = F.col("_wn") >= ESTIMATION + EVENT + 10
    return at.select(
        *by, "as_of", F.col("_wn").cast("long").alias("n_obs"), *[c.alias(k) for k, c in fit.items()],
        F.when(long_enough, F.col("_b")).alias("beta_now"), F.when(long_enough, F.col("beta_delta")).alias("beta_delta"),
        *[F.when(event_ok, F.col(f"_{k}")).alias(k) for k in ("car_21d", "car_tstat", "abnormal_std")])


def mrp_estimate(indices: DataFrame, rf: Column, by: list[str]) -> DataFrame:
    m = indices.select(*by, log_return(by).alias("lr"))
    return m.groupBy(*by).agg(market_risk_premium(F.avg("lr"), F.count("lr"), rf).alias("mrp"), F.count("lr").alias("n"))


def premium_at(indices: DataFrame, grid: Grid, rf_at: DataFrame, months: int = INDEX_MONTHS) -> DataFrame:
    """Risk premium per (index, as_of) from the returns inside the window."""
    by = ["index_key"]
    m = indices.select("index_key", "date", log_return(by).alias("x"), F.lag("date").over(history(by)).alias("x_from"))
    s = running_sums(m, by, {"_s": F.col("x"), "_n": F.when(F.col("x").isNotNull(), 1.0)})
    at = edges(s, grid, by=by).withColumn("_start", F.add_months("as_of", -months))
    cut = s.filter(F.col("x_from").isNotNull()).select("index_key", "x_from", F.struct("_s", "_n").alias("_cut"))
    at = asof_join(at.filter(F.col("date") >= F.col("_start")), cut, by=by, left_time="_start", right_time="x_from", values=["_cut"], strict=True)
    n = F.col("_n") - F.coalesce(F.col("_cut._n"), F.lit(0.0))
    total = F.col("_s") - F.coalesce(F.col("_cut._s"), F.lit(0.0))
    at = at.join(rf_at, "as_of", "left").withColumn("rf", F.coalesce("rate", F.lit(0.04)))
    return at.select("index_key", "as_of", n.cast("long").alias("n_index"), "rf",
                     market_risk_premium(total / F.nullif(n, F.lit(0.0)), n, F.col("rf")).alias("mrp"))


def rate_at(grid: Grid, risk_free: DataFrame) -> DataFrame:
    """Latest annual rate before each grid date."""
    spark = risk_free.sparkSession
    points = spark.range(grid.last_index + 1).select(grid.at(F.col("id")).alias("as_of"))
    return asof_calendar(points, risk_free.filter(F.col("rate").isNotNull()).withColumnRenamed("date", "date_rf"),
                         left_day="as_of", right_day="date_rf", values=["rate"], strict=True)


def capm_features(fits: DataFrame, bars: DataFrame, premiums: DataFrame, grid: Grid, by: str = "symbol") -> DataFrame:
    """Fair return, premium and realised gap per (key, index, as_of)."""
    w = history([by])
    year = bars.select(by, "date", (F.col("adj_close") / F.lag("adj_close", 252).over(w) - 1).alias("realised"))
    at = edges(year, grid, by=[by]).select(by, "as_of", "realised")
    j = fits.select(by, "index_key", "as_of", "beta").join(premiums, ["index_key", "as_of"]).join(at, [by, "as_of"])
    j = j.filter((F.col("n_index") >= 252) & F.col("realised").isNotNull() & F.col("beta").isNotNull())
    mrp = F.coalesce(F.col("mrp"), F.lit(DEFAULT_MRP))
    fair = sml_return(F.col("beta"), F.col("rf"), mrp)
    return j.select(by, "index_key", "as_of", fair.alias("fair_return"), mrp.alias("market_risk_premium"),
                    (F.col("realised") - fair).alias("alpha_realised"),
                    F.when(F.col("mrp").isNull(), 1.0).otherwise(0.0).alias("mrp_is_default"))


# --- joint factor fits --------------------------------------------------------

def factor_returns(indices: DataFrame, *, market: str = "gspc", small: str = "rut", value: str = "iwd", growth: str = "iwf") -> DataFrame:
    """Daily market return and the two long-short spreads."""
    lr = indices.select("index_key", "date", log_return(["index_key"]).alias("lr")).filter(F.col("lr").isNotNull())
    pick = lambda k: F.max(F.when(F.col("index_key") == k, F.col("lr")))
    wide = lr.groupBy("date").agg(pick(market).alias("market"), pick(small).alias("_s"), pick(value).alias("_v"), pick(growth).alias("_g"))
    return wide.select("date", "market", (F.col("_s") - F.col("market")).alias("smb"), (F.col("_v") - F.col("_g")).alias("hml")).dropna()


def cross_products(names: list[str], y: str) -> dict[str, Column]:
    """The distinct products of (1, factors, y) whose sums determine the fit."""
    terms = [F.lit(1.0)] + [F.col(n) for n in names] + [F.col(y)]
    return {f"_q{i}_{j}": terms[i] * terms[j] for i in range(len(terms)) for j in range(i, len(terms))}


def centred(rows: DataFrame, by: list[str], names: list[str], y: str) -> DataFrame:
    """Factors and ``y`` less their group means, which stay as ``_m_`` columns: products keep their digits."""
    means = rows.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in (*names, y)])
    return rows.join(means, by).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in (*names, y)})


def solve_factors(sums: DataFrame, keys: list[str], names: list[str], y: str) -> DataFrame:
    """One joint fit per row of summed products of centred columns, solved in Arrow batches; the intercept is moved back by the means."""
    k = len(names)
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    outs = ["n_obs", "alpha", "alpha_stderr", "r_squared", "adj_r_squared", "residual_std"]
    outs += [f"beta_{n}" for n in names] + [f"stderr_{n}" for n in names]
    schema = ", ".join([f"{c} {kinds[c]}" for c in keys] + [f"{c} double" for c in outs])

    def solve(batches):
        for pdf in batches:
            m = len(pdf)
            full = np.zeros((m, k + 2, k + 2))
            for i in range(k + 2):
                for j in range(i, k + 2):
                    full[:, i, j] = full[:, j, i] = pdf[f"_q{i}_{j}"].to_numpy(float)
            xtx, xty, yty, n = full[:, :k + 1, :k + 1], full[:, :k + 1, k + 1], full[:, k + 1, k + 1], full[:, 0, 0]
            inv = np.linalg.pinv(xtx) if m else xtx
            coef = np.einsum("mij,mj->mi", inv, xty)
            tot = yty - xty[:, 0] ** 2 / n
            res = np.maximum(yty - np.einsum("mi,mi->m", coef, xty), 0)
            dof = n - k - 1
            with np.errstate(all="ignore"):
                r2 = 1 - res / tot
                var = res / dof
                mean = np.column_stack([np.ones(m), *[-pdf[f"_m_{c}"].to_numpy(float) for c in names]])
                coef[:, 0] = np.einsum("mi,mi->m", coef, mean) + pdf[f"_m_{y}"].to_numpy(float)
                spread = np.einsum("mii->mi", inv).copy()
                spread[:, 0] = np.einsum("mi,mij,mj->m", mean, inv, mean)
                err = np.sqrt(np.clip(var[:, None] * spread, 0, None))
                adj = 1 - (1 - r2) * (n - 1) / dof
            out = pdf[keys].copy()
            for c, v in zip(outs, [n, coef[:, 0], err[:, 0], r2, adj, np.sqrt(var),
                                   *coef[:, 1:].T, *err[:, 1:].T]):
                out[c] = v
            yield out[n >= k + 2]

    return sums.mapInPandas(solve, schema)


def fit_multifactor(rows: DataFrame, by: list[str], names: list[str], y: str = "ye") -> DataFrame:
    """Joint least squares on k factors per group: Spark sums, numpy solves."""
    clean = centred(rows.dropna(subset=[y, *names]), by, names, y)
    sums = clean.groupBy(*by, *[f"_m_{c}" for c in (*names, y)]).agg(*[F.sum(c).alias(q) for q, c in cross_products(names, y).items()])
    return solve_factors(sums, by, names, y)


def multifactor_features(rows: DataFrame, grid: Grid, by: str, names: list[str], y: str = "ye", months: int = INDEX_MONTHS) -> DataFrame:
    """The joint fit over the index window at each as-of date."""
    keys = [by]
    means = [f"_m_{c}" for c in (*names, y)]
    clean = centred(rows.dropna(subset=[y, *names]), keys, names, y)
    qs = cross_products(names, y)
    s = running_sums(clean, keys, qs)
    at = edges(s, grid, by=keys).withColumn("_start", F.add_months("as_of", -months))
    cut = s.select(by, "x_from", F.struct(*qs).alias("_cut"))
    at = asof_join(at.filter(F.col("date") >= F.col("_start")), cut, by=keys, left_time="_start", right_time="x_from", values=["_cut"], strict=True)
    sums = at.select(by, "as_of", *means, *[(F.col(q) - F.coalesce(F.col(f"_cut.{q}"), F.lit(0.0))).alias(q) for q in qs])
    return solve_factors(sums, [by, "as_of"], names, y)


def long_betas(fit: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row per (fit, factor) with beta and standard error."""
    parts = F.array(*[F.struct(F.lit(n).alias("factor"), F.col(f"beta_{n}").alias("beta"), F.col(f"stderr_{n}").alias("stderr")) for n in names])
    return fit.select(*keys, F.inline(parts))


def multifactor_expected(betas: DataFrame, premia: DataFrame, keys: list[str], rf: float, actual: DataFrame | None = None) -> DataFrame:
    """rf + sum of beta x premium; a factor without premium counts zero."""
    j = betas.join(premia, "factor", "left")
    out = j.groupBy(*keys).agg((F.lit(rf) + F.sum(F.col("beta") * F.coalesce("premium", F.lit(0.0)))).alias("expected_return"),
                               (1 - F.sum("beta")).alias("risk_free_weight"))
    if actual is not None:
        out = out.join(actual, keys).withColumn("arbitrage_profit", F.col("expected_return") - F.col("actual_return"))
    return out
