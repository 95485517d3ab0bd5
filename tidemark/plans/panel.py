"""Panel assembly: every block of every (symbol, as_of) in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators import brief as br
from ..operators import documents as doc
from ..operators import regression as reg
from ..operators import returns as ret
from ..operators import technical as tech
from ..session import cut_lineage
from ..operators.windows import DEFAULT_HORIZON, MACRO_MONTHS, Grid, edges, members

KEYS = ["symbol", "as_of"]
SCL = ("alpha", "alpha_annual", "alpha_tstat", "beta", "beta_tstat", "r_squared", "correlation", "residual_std", "information_ratio", "firm_specific_share",
       "beta_now", "beta_delta")
FACTORS = ["market", "smb", "hml"]


def compute_target(bars: DataFrame, grid: Grid, horizon: int = DEFAULT_HORIZON, kind: str = "log_return", by: str = "symbol") -> DataFrame:
    """Label per (key, as_of) from the last row at or before the date."""
    w = ret.history([by])
    end = F.lead("adj_close", horizon).over(w)
    if kind == "log_return":
        target = F.log(end / F.col("adj_close"))
    elif kind == "direction":
        target = F.when(end.isNotNull(), F.when(end > F.col("adj_close"), 1.0).otherwise(0.0))
    elif kind == "volatility":
        bars = bars.withColumn("_lr", ret.log_return([by]))
        target = F.when(end.isNotNull(), F.stddev_samp("_lr").over(w.rowsBetween(1, horizon)) * (252 ** 0.5))
    else:
        raise ValueError(f"unknown target kind {kind}")
    return edges(bars.withColumn("target", target), grid, by=[by], inclusive=True).select(by, "as_of", "target")


def pivot(long: DataFrame, keys: list[str], by: str, values: list[str], cols, name) -> DataFrame:
    """Fixed-value pivot: the columns are known, so no pass looks for them."""
    aggs = [F.max(F.when(F.col(by) == v, F.col(c))).alias(name(v, c)) for v in values for c in cols]
    return long.groupBy(*keys).agg(*aggs)


def macro_block(series: DataFrame, grid: Grid, ids: list[str], by: str = "series_id") -> DataFrame:
    """Level and 21-row change of each series at the edge of the macro window."""
    w = ret.history([by])
    s = series.filter(F.col("value").isNotNull()).select(by, "date", "value", F.lag("value", 21).over(w).alias("_p"), F.lag("date", 21).over(w).alias("_pd"))
    at = edges(s, grid, by=[by]).filter(F.col("date") >= F.add_months("as_of", -MACRO_MONTHS))
    inside = F.col("_pd") >= F.add_months("as_of", -MACRO_MONTHS)
    at = at.select(by, "as_of", F.col("value").alias("level"), F.when(inside, F.col("value") - F.col("_p")).alias("delta_21d"))
    return pivot(at, ["as_of"], by, ids, ["level", "delta_21d"], lambda v, c: f"macro_{v}_{c}")


def prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def feature_rows(bars: DataFrame, indices: DataFrame, risk_free: DataFrame, series: DataFrame, docs: DataFrame, grid: Grid, *,
                 lexicon, series_ids: list[str], index_keys: list[str], scl_keys: list[str], benchmark: str = "gspc",
                 fallback: DataFrame | None = None) -> DataFrame:
    """One wide row per (symbol, as_of) with the same columns in every row.

    Blocks are planned and kept one by one: each has a row per (symbol, as_of),
    and one plan of all would hold some of them several times.
    """
    eq = cut_lineage(prefixed(ret.price_features(bars, grid, risk_free=risk_free).drop("date", "adj_close"), KEYS, "eq_"))
    idx = cut_lineage(ret.index_features(indices, grid, index_keys, risk_free))

    aligned = reg.aligned_returns(bars, indices.filter(F.col("index_key").isin(*scl_keys)), risk_free)
    fits = cut_lineage(reg.windowed_fits(aligned, grid, ["symbol", "index_key"]))
    scl = pivot(fits, KEYS, "index_key", scl_keys, SCL, lambda v, c: f"scl_{v}_{c}")
    evt = pivot(fits, KEYS, "index_key", scl_keys, ("car_21d", "car_tstat", "abnormal_std"), lambda v, c: f"evt_{v}_{c}")
    premium = reg.premium_at(indices, grid, reg.rate_at(grid, risk_free))
    capm = pivot(reg.capm_features(fits, bars, premium, grid), KEYS, "index_key", scl_keys,
                 ("fair_return", "market_risk_premium", "alpha_realised", "mrp_is_default"), lambda v, c: f"capm_{v}_{c}")
    bench = indices.filter(F.col("index_key") == benchmark).select("date", "adj_close")
    rs = prefixed(edges(tech.relative_strength(bars, bench, ["symbol"]), grid, by=["symbol"]).drop("date"), KEYS, "tech_")

    f = reg.daily_risk_free(reg.factor_returns(indices, market=benchmark), risk_free).withColumn("market", F.col("market") - F.col("rf_daily"))
    prev = bench.select("date", F.lag("date").over(W.partitionBy(F.lit(0)).orderBy("date")).alias("x_from"))
    rows = (bars.select("symbol", "date", ret.log_return(["symbol"]).alias("y")).join(f, "date").join(prev, "date")
            .select("symbol", "date", (F.col("y") - F.col("rf_daily")).alias("ye"), *FACTORS, "x_from"))
    ff = reg.multifactor_features(rows, grid, "symbol", FACTORS)
    ff = ff.select(*KEYS, *[F.col(f"beta_{n}").alias(f"ff_beta_{n}") for n in FACTORS],
                   *[F.try_divide(F.col(f"beta_{n}"), F.col(f"stderr_{n}")).alias(f"ff_tstat_{n}") for n in FACTORS],
                   F.col("alpha").alias("ff_alpha"), (F.pow(1 + F.col("alpha"), F.lit(252.0)) - 1).alias("ff_alpha_annual"), F.col("r_squared").alias("ff_r_squared"),
                   F.col("adj_r_squared").alias("ff_adj_r_squared"), F.col("residual_std").alias("ff_residual_std"), (1 - F.col("r_squared")).alias("ff_firm_specific_share"))

    symbols = bars.select("symbol").distinct()
    scores = cut_lineage(doc.doc_scores(docs, lexicon))  # each text is read once
    novelty = cut_lineage(doc.vocab_novelty(docs, grid))
    stats = cut_lineage(doc.text_stats(scores, grid, ["symbol"], doc.NEWS, symbols))
    tag = {"news_baseline": "ds2", "news_recent": "ds3"}
    stat_cols = [c for c in stats.columns if c not in (*KEYS, "ds")]
    text = pivot(stats, KEYS, "ds", list(tag), stat_cols, lambda v, c: f"{tag[v]}_{c}")
    shared = doc.text_stats(scores.withColumn("_all", F.lit(1)), grid, ["_all"], ["macro"])
    shared = prefixed(shared.drop("_all", "ds"), ["as_of"], "ds5_")
    shift = doc.sentiment_shift(stats, novelty)
    gem = br.brief_features(br.lexicon_brief(scores, novelty, grid, symbols), KEYS)

    out = eq
    for block in (scl, evt, cut_lineage(capm), cut_lineage(rs), cut_lineage(ff), text, shift, cut_lineage(gem)):
        out = out.join(block, KEYS, "left")
    out = out.join(idx, "as_of", "left").join(shared, "as_of", "left").join(macro_block(series, grid, series_ids), "as_of", "left")
    names = F.lit("sentiment") if fallback is None else None
    if fallback is not None:
        out = out.join(fallback, "symbol", "left")
        names = F.concat_ws(",", F.array_sort("fallback_sources"))
    meta = [F.col("symbol").alias("meta_symbol"), F.col("as_of").alias("meta_as_of"), names.alias("meta_synthetic"),
            F.when(names == "", 0).otherwise(F.size(F.split(names, ","))).alias("meta_n_synthetic"), F.lit("synthetic").alias("meta_grounding")]
    return out.select(*meta, *[c for c in out.columns if c not in (*KEYS, "fallback_sources")])


def labelled_panel(features: DataFrame, target: DataFrame) -> DataFrame:
    """Features with their label; unlabelled rows dropped, ordered by as_of."""
    t = target.filter(F.col("target").isNotNull()).select(F.col("symbol").alias("meta_symbol"), F.col("as_of").alias("meta_as_of"), "target")
    return features.join(t, ["meta_symbol", "meta_as_of"]).orderBy("meta_as_of", "meta_symbol")


def numeric_features(panel: DataFrame) -> list[str]:
    return [f.name for f in panel.schema.fields if f.dataType.typeName() in ("double", "integer", "long", "float")
            and not f.name.startswith("meta_") and f.name != "target"]


def leak_corr(panel: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Features whose correlation with the target is suspiciously high.

    All correlations are one aggregate over the panel; the result is turned
    into rows afterwards.
    """
    names = numeric_features(panel)
    wide = panel.agg(*[F.struct(F.corr(c, "target").alias("corr"), F.stddev_samp(c).alias("sd")).alias(c) for c in names])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["corr"].alias("corr"), F.col(c)["sd"].alias("sd")) for c in names])))
    return long.filter((F.col("sd") > 0) & (F.abs("corr") > threshold))


def future_rows(rows: DataFrame, column: str, grid: Grid, names: list[str]) -> DataFrame:
    """Feature inputs dated at or after their as-of date, per window."""
    m = members(rows, column, grid, names)
    return m.groupBy("ds").agg(F.count("*").alias("n_rows"), F.count_if(F.to_date(column) >= F.col("as_of")).alias("n_future"))


def overlapping_windows(docs: DataFrame, grid: Grid) -> DataFrame:
    """Documents that sit in both news windows of one as-of date."""
    m = members(docs.select("doc_id", "published"), "published", grid, doc.NEWS)
    per = m.groupBy("doc_id", "as_of").agg(F.count("*").alias("_n"))
    return per.agg(F.count("*").alias("n_members"), F.count_if(F.col("_n") > 1).alias("n_overlapping"))
