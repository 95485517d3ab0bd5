"""Finance expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
TRADING_DAYS = 252
NORMAL_1PCT = 2.33
DEFAULT_MRP = 0.08
MRP_SHRINK_DAYS = 1260
MRP_FLOOR = 0.01
DEFAULT_RISK_AVERSION = 4.0
CONSTANT_RISK_FREE = 0.04
FAIR_BAND = 0.01


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def daily_rate(annual: Column) -> Column:
    """Geometric de-annualisation."""
    return F.pow(1 + annual, F.lit(1.0 / TRADING_DAYS)) - 1


def annualise(total: Column, years: Column) -> Column:
    return F.when(years <= 0, F.raise_error(F.lit("years must be positive")).cast("double")) \
            .otherwise(F.pow(1 + total, 1 / years) - 1)


def effective_annual_rate(apr: Column, periods: int) -> Column:
    if periods < 0:
        raise ValueError("periods must be >= 0")
    return F.expm1(apr) if periods == 0 else F.pow(1 + apr / periods, F.lit(float(periods))) - 1


def real_rate_exact(nominal: Column, inflation: Column) -> Column:
    return (1 + nominal) / (1 + inflation) - 1


def real_rate_approx(nominal: Column, inflation: Column) -> Column:
    return nominal - inflation


def utility(expected: Column, sd: Column, aversion: Column) -> Column:
    return expected - 0.5 * aversion * sd * sd


def sml_return(beta: Column, rf: Column, premium: Column) -> Column:
    """Fair return on the security market line; also the hurdle rate."""
    return rf + beta * premium


def zero_beta_return(beta: Column, zero_beta: Column, market: Column) -> Column:
    return zero_beta + beta * (market - zero_beta)


def fair_profit(capital: Column, beta: Column, rf: Column, premium: Column) -> Column:
    return capital * sml_return(beta, rf, premium)


def sml_verdict(alpha: Column) -> Column:
    return (F.when(alpha.isNull() | F.isnan(alpha), "unknown")
            .when(alpha > FAIR_BAND, "underpriced").when(alpha < -FAIR_BAND, "overpriced")
            .otherwise("fairly_priced"))


def market_risk_premium(mean_daily: Column, n: Column, rf: Column, prior: float = DEFAULT_MRP) -> Column:
    """Sample premium blended with the prior by history length, floored."""
    weight = n / (n + MRP_SHRINK_DAYS)
    blended = weight * (mean_daily * TRADING_DAYS - rf) + (1 - weight) * prior
    return F.when(n >= 2, F.greatest(F.lit(MRP_FLOOR), blended))


def parity_premium(actual: Column, fair: Column) -> Column:
    return ratio(actual - fair, fair)
