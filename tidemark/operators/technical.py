"""Trailing and positional analytics on ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.finance import parity_premium, ratio
from .returns import history


def moving_average(bars: DataFrame, by: list[str], n: int = 50, price: str = "adj_close") -> DataFrame:
    """Trailing mean, null until ``n`` rows exist."""
    frame = history(by).rowsBetween(-n + 1, 0)
    return bars.withColumn("ma", F.when(F.count(price).over(frame) == n, F.avg(price).over(frame)))


def crossover_state(bars: DataFrame, by: list[str], n: int = 50, price: str = "adj_close") -> DataFrame:
    out = moving_average(bars, by, n, price)
    return out.withColumn("ma_cross", F.when(F.col("ma").isNotNull(), F.when(F.col(price) >= F.col("ma"), 1.0).otherwise(-1.0)))


def crossover_age(bars: DataFrame, by: list[str], n: int = 50, *, price: str = "adj_close", max_lookback: int = 252,
                  rn: str | None = None, state: str | None = None, out: str = "ma_cross_age") -> DataFrame:
    """Rows since the price was last on the other side of its average.

    With a ``state`` column (+1 / -1) the average itself is not needed again:
    touching the average counts as above, which is how the state is defined.
    """
    df = bars
    if rn is None:
        df = df.withColumn("_rn", F.row_number().over(history(by)))
    if state is None:
        df = moving_average(df, by, n, price)
        df = df.withColumn("_side", F.signum(F.col(price) - F.col("ma")))
    else:
        df = df.withColumn("_side", F.col(state))
    row = F.col(rn or "_rn")
    upto = history(by).rowsBetween(W.unboundedPreceding, 0)
    last_up = F.max(F.when(F.col("_side") > 0, row)).over(upto)
    last_down = F.max(F.when(F.col("_side") < 0, row)).over(upto)
    other = F.when(F.col("_side") > 0, last_down).when(F.col("_side") < 0, last_up) \
             .otherwise(F.greatest(last_up, last_down))
    defined = F.count("_side").over(upto)
    age = F.when(other.isNull() | (row - other >= max_lookback), F.lit(max_lookback)).otherwise(row - other)
    df = df.withColumn(out, F.when(F.col("_side").isNotNull() & (defined >= 2), age.cast("double")))
    return df.drop("_side", "_rn", *([] if state else ["ma"]))


def relative_strength(bars: DataFrame, bench: DataFrame, by: list[str], windows: tuple[int, ...] = (63, 252),
                      trend: int = 63) -> DataFrame:
    """Log return against a benchmark's on the same dates, and its change.

    The benchmark is a daily table, so its join brings one row per day.
    """
    def logs(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        w = history(keys) if keys else W.partitionBy(F.lit(0)).orderBy("date")
        p = F.col("adj_close")
        cols = [F.log(p / F.lag(p, n).over(w)).alias(f"_{tag}_{n}") for n in windows]
        cols.append(F.log(F.lag(p, trend).over(w) / F.lag(p, 2 * trend).over(w)).alias(f"_{tag}_prev"))
        return df.select(*keys, "date", *cols)

    both = logs(bars, by, "s").join(logs(bench, [], "b"), "date")
    spread = lambda n: F.col(f"_s_{n}") - F.col(f"_b_{n}")
    return both.select(*by, "date", *[spread(n).alias(f"rs_{n}d") for n in windows],
                       (spread(trend) - spread("prev")).alias(f"rs_trend_{trend}d"))


def rsi_wilder(bars: DataFrame, by: list[str], period: int = 14, price: str = "adj_close") -> DataFrame:
    """RSI at the last row from the closed form of the exponential average:
    weights depend only on the distance to the end, so it is one aggregate."""
    a = 1.0 / period
    w = history(by)
    d = bars.select(*by, (F.col(price) - F.lag(price).over(w)).alias("_d"), F.row_number().over(w).alias("_rn"),
                    F.count("*").over(W.partitionBy(*by)).alias("_n"))
    back = F.col("_n") - F.col("_rn")
    weight = F.pow(F.lit(1 - a), back) * F.when(F.col("_rn") == 2, F.lit(1.0)).otherwise(F.lit(a))
    g = d.filter(F.col("_d").isNotNull()).groupBy(*by).agg(
        F.sum(weight * F.greatest(F.col("_d"), F.lit(0.0))).alias("_g"),
        F.sum(weight * F.greatest(-F.col("_d"), F.lit(0.0))).alias("_l"), F.max("_n").alias("_n"))
    value = F.when(F.col("_l") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("_g") / F.col("_l")))
    return g.select(*by, F.when(F.col("_n") >= period + 1, value).alias("rsi"))


def pct_from_extreme(bars: DataFrame, by: list[str], lookback: int = 252, price: str = "adj_close") -> DataFrame:
    frame = history(by).rowsBetween(-lookback + 1, 0)
    enough = F.count(price).over(frame) >= 2
    high, low = F.max(price).over(frame), F.min(price).over(frame)
    return bars.select("*", F.when(enough & (high > 0), F.col(price) / high - 1).alias("pct_from_high"),
                       F.when(enough & (low > 0), F.col(price) / low - 1).alias("pct_from_low"))


def momentum_12_1(bars: DataFrame, by: list[str], price: str = "adj_close") -> DataFrame:
    w = history(by)
    return bars.withColumn("momentum_12_1", F.log(F.lag(price, 21).over(w) / F.lag(price, 252).over(w)))


def long_horizon_reversal(bars: DataFrame, by: list[str], price: str = "adj_close") -> DataFrame:
    w = history(by)
    return bars.withColumn("reversal", -F.log(F.lag(price, 252).over(w) / F.lag(price, 756).over(w)))


def trin(rets: DataFrame, r: str = "sr", volume: str = "volume") -> DataFrame:
    """Declining volume per decliner over advancing volume per advancer, by day."""
    up, down = F.col(r) > 0, F.col(r) < 0
    g = rets.groupBy("date").agg(
        F.count_if(up).alias("n_advancing"), F.count_if(down).alias("n_declining"),
        F.sum(F.when(up, F.col(volume))).alias("_au"), F.sum(F.when(down, F.col(volume))).alias("_du"))
    ok = (F.col("n_advancing") > 0) & (F.col("n_declining") > 0) & (F.col("_au") > 0)
    value = ratio(F.col("_du") / F.col("n_declining"), F.col("_au") / F.col("n_advancing"))
    return g.select("date", "n_advancing", "n_declining", F.when(ok, value).alias("trin"))


def parity(bars: DataFrame, first: str, second: str, fair: float, by: str = "symbol") -> DataFrame:
    """Premium of the price ratio of two keys over a fair ratio, by day."""
    a = bars.filter(F.col(by) == first).select("date", F.col("adj_close").alias("_a"))
    b = bars.filter(F.col(by) == second).select("date", F.col("adj_close").alias("_b"))
    actual = ratio(F.col("_a"), F.col("_b"))
    return a.join(b, "date").select("date", actual.alias("actual_ratio"),
                                    parity_premium(actual, F.lit(fair)).alias("premium"))


def level_delta(series: DataFrame, by: str = "series_id", rows: int = 21) -> DataFrame:
    """Last level per series, and that level minus the one ``rows`` rows earlier."""
    w = history([by])
    s = series.filter(F.col("value").isNotNull()).select(by, "date", "value", F.lag("value", rows).over(w).alias("_prev"))
    return s.groupBy(by).agg(F.max_by("value", "date").alias("level"),
                             F.max_by(F.col("value") - F.col("_prev"), "date").alias(f"delta_{rows}"))


def day_spine(counts: DataFrame, day: str = "day", n: str = "n") -> DataFrame:
    """Daily counts on a gap-free calendar from the first to the last day."""
    span = counts.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    spine = span.select(F.explode(F.sequence("_a", "_b")).alias(day))
    return spine.join(counts, day, "left").select(day, F.coalesce(F.col(n), F.lit(0)).alias(n))


def calendar_window():
    """One ordered frame over calendar days: its size is the number of days."""
    return W.partitionBy(F.lit(0)).orderBy("day")


def running_total(spine: DataFrame, n: str = "n") -> DataFrame:
    return spine.withColumn("running", F.sum(n).over(calendar_window().rowsBetween(W.unboundedPreceding, 0)))


def rolling_mean(spine: DataFrame, days: int = 7, n: str = "n") -> DataFrame:
    return spine.withColumn("rolling", F.round(F.avg(n).over(calendar_window().rowsBetween(-days + 1, 0)), 2))


def streak(active_days: DataFrame, by: list[str], today: Column, day: str = "day") -> DataFrame:
    """Length of the run of active days that ends today or yesterday.

    ``active_days`` has one row per (key, day), so a key's rows are bounded by
    the calendar.
    """
    w = W.partitionBy(*by).orderBy(day)
    runs = (active_days.filter(F.col(day) <= today)
            .withColumn("_island", F.date_sub(F.col(day), F.row_number().over(w)))
            .groupBy(*by, "_island").agg(F.max(day).alias("_end"), F.count("*").alias("_n")))
    current = F.when(F.col("_end") >= F.date_sub(today, 1), F.col("_n")).otherwise(0)
    return runs.groupBy(*by).agg(F.max(current).cast("long").alias("streak"))
