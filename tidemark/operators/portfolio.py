"""Portfolio jobs over tables of assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.finance import ratio, utility
from .ranking import with_row


def capital_allocation(assets: DataFrame, rf: Column, aversions: list[float], mean: str = "mean", sd: str = "sd") -> DataFrame:
    """Optimal risky share per asset for each risk aversion in a short list."""
    if any(a <= 0 for a in aversions):
        raise ValueError("risk aversion must be positive")
    e, s = F.col(mean), F.col(sd)
    s = F.when(s <= 0, F.raise_error(F.lit("risky sd must be positive")).cast("double")).otherwise(s)
    a = F.col("risk_aversion")
    df = assets.withColumn("risk_aversion", F.explode(F.array(*[F.lit(float(x)) for x in aversions])))
    df = df.withColumn("y_star", (e - rf) / (a * s * s))
    y = F.col("y_star")
    out = df.withColumn("complete_return", rf + y * (e - rf)).withColumn("complete_sd", F.abs(y) * s)
    return (out.withColumn("sharpe", (e - rf) / s)
            .withColumn("utility", utility(F.col("complete_return"), F.col("complete_sd"), a))
            .withColumn("is_levered", y > 1).withColumn("is_short", y < 0)
            .withColumn("y_display", F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))))


def two_asset_mix(rets: DataFrame, pairs: DataFrame, rf: float = 0.0, by: str = "symbol", r: str = "sr") -> DataFrame:
    """Moments and optimal weights for the listed pairs (columns d, e).

    Pairs are given, so the work grows with the list: each side is joined on
    its own key and day, and every pair reduces to one row of sums.
    """
    x = rets.select(F.col(by).alias("_k"), "date", F.col(r).alias("_r")).filter(F.col("_r").isNotNull())
    d = pairs.join(x, pairs["d"] == x["_k"]).select("d", "e", "date", F.col("_r").alias("rd"))
    y = x.select(F.col("_k").alias("e"), "date", F.col("_r").alias("re"))
    g = d.join(y, ["e", "date"]).groupBy("d", "e").agg(
        F.count("*").alias("n"), F.avg("rd").alias("mean_d"), F.avg("re").alias("mean_e"),
        F.stddev_samp("rd").alias("sd_d"), F.stddev_samp("re").alias("sd_e"), F.corr("rd", "re").alias("corr"))
    vd, ve = F.col("sd_d") * F.col("sd_d"), F.col("sd_e") * F.col("sd_e")
    cov = F.col("corr") * F.col("sd_d") * F.col("sd_e")
    xd, xe = F.col("mean_d") - rf, F.col("mean_e") - rf
    g = g.withColumn("w_min_var", ratio(ve - cov, vd + ve - 2 * cov))
    g = g.withColumn("w_optimal", ratio(xd * ve - xe * cov, xd * ve + xe * vd - (xd + xe) * cov))

    def mix(w: Column) -> tuple[Column, Column]:
        return w * F.col("mean_d") + (1 - w) * F.col("mean_e"), w * w * vd + (1 - w) * (1 - w) * ve + 2 * w * (1 - w) * cov
    for name in ("min_var", "optimal"):
        mean, var = mix(F.col(f"w_{name}"))
        g = g.withColumn(f"return_{name}", mean).withColumn(f"variance_{name}", var)
    return g


def markowitz(rets: DataFrame, weights: DataFrame, by: str = "symbol", r: str = "sr") -> DataFrame:
    """Return and variance of a weighted portfolio.

    w'Sw equals the variance of the weighted return series on the days where
    every asset has a return, so no covariance matrix and no pairs are built:
    one sum per day, then one variance.
    """
    n = weights.agg(F.count("*").alias("_n_assets"))
    daily = (rets.filter(F.col(r).isNotNull()).join(weights, by)
             .groupBy("date").agg(F.sum(F.col("weight") * F.col(r)).alias("_p"), F.count("*").alias("_have")))
    whole = with_row(daily, n).filter(F.col("_have") == F.col("_n_assets"))
    return whole.agg(F.count("*").alias("n_days"), F.avg("_p").alias("portfolio_return"), F.var_samp("_p").alias("portfolio_variance"))


def treynor_black(fits: DataFrame, keys: list[str], alpha: str = "alpha", residual_sd: str = "residual_std") -> DataFrame:
    """alpha / residual variance, normalised to one; combined squared Sharpe.

    The total is one aggregated row, read as a scalar subquery.
    """
    x = ratio(F.col(alpha), F.col(residual_sd) * F.col(residual_sd))
    f = fits.select(*keys, alpha, residual_sd, x.alias("_x")).filter(F.col("_x").isNotNull())
    total = f.agg(F.sum("_x").alias("_t"))
    weight = F.when(F.col("_t") == 0, F.raise_error(F.lit("weights undefined")).cast("double")).otherwise(F.col("_x") / F.col("_t"))
    return with_row(f, total).select(*keys, alpha, residual_sd, weight.alias("weight"))


def combined_sharpe_squared(market_sharpe: Column, active_ratio: Column) -> Column:
    return market_sharpe * market_sharpe + active_ratio * active_ratio
