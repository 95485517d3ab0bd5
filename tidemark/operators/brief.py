"""The deterministic sentiment brief and its features.

A null score means "could not tell" and never becomes zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.finance import ratio
from .documents import daily_sums, universe, window_sums
from .windows import Grid

# Fixed values.
SIGNED = ("baseline_sentiment", "recent_sentiment", "sentiment_shift", "community_sentiment", "macro_sentiment", "narrative_change", "forward_looking_tone")
UNSIGNED = ("attention_level", "controversy", "uncertainty", "confidence")
FIELDS = ("baseline_sentiment", "recent_sentiment", "sentiment_shift", "community_sentiment", "macro_sentiment", "narrative_change",
          "attention_level", "controversy", "uncertainty", "forward_looking_tone", "confidence")


def clamp(c: Column, lo: float, hi: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def lexicon_brief(scores: DataFrame, novelty: DataFrame, grid: Grid, keys: DataFrame | None = None) -> DataFrame:
    """Eleven fields per (symbol, as_of) from document sums only.

    The macro window is the same for every symbol, so it is summed once per
    as-of date and joined.
    """
    on = ["symbol", "as_of"]
    w = window_sums(daily_sums(scores, ["symbol"]), ["symbol"], grid, ["news_baseline", "news_recent"])
    side = lambda ds, tag: w.filter(F.col("ds") == ds).select(*on, *[F.col(c).alias(f"{tag}_{c}") for c in ("n", "s1", "s2", "com_s", "n_com", "n_hedged", "fwd_s", "n_fwd")])
    macro = window_sums(daily_sums(scores.withColumn("_all", F.lit(1)), ["_all"]), ["_all"], grid, ["macro"]).select("as_of", F.col("n").alias("m_n"), F.col("s1").alias("m_s1"))
    base = universe(keys if keys is not None else scores.select("symbol").distinct(), grid)
    j = (base.join(side("news_baseline", "b"), on, "left").join(side("news_recent", "r"), on, "left").join(macro, "as_of", "left")
         .join(novelty.select(*on, "vocab_novelty"), on, "left"))
    tone = lambda s, n: clamp(ratio(F.col(s), F.col(n)), -1.0)
    b, r = tone("b_s1", "b_n"), tone("r_s1", "r_n")
    rn = F.col("r_n")
    sd = F.sqrt(F.greatest(F.col("r_s2") / rn - (F.col("r_s1") / rn) * (F.col("r_s1") / rn), F.lit(0.0)))
    sign = F.when(F.coalesce(r, F.lit(0.0)) >= F.coalesce(b, F.lit(0.0)), 1.0).otherwise(-1.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        *on, b.alias("baseline_sentiment"), r.alias("recent_sentiment"), (r - b).alias("sentiment_shift"), tone("r_com_s", "r_n_com").alias("community_sentiment"),
        tone("m_s1", "m_n").alias("macro_sentiment"), clamp(F.col("vocab_novelty") * sign, -1.0).alias("narrative_change"),
        F.when(rn > 0, F.least(F.lit(1.0), rn / 60.0 / 5.0)).alias("attention_level"), F.when(rn > 0, F.least(F.lit(1.0), sd * 2)).alias("controversy"),
        (F.col("r_n_hedged") / rn).alias("uncertainty"), tone("r_fwd_s", "r_n_fwd").alias("forward_looking_tone"), F.lit(0.0).alias("confidence"),
        (zero("b_n") + zero("r_n") + zero("m_n")).alias("n_documents"), F.array().cast("array<string>").alias("themes"), F.lit(True).alias("is_synthetic"))


BRIEF_JSON = ", ".join(f"{f} string" for f in FIELDS) + ", rationale string, themes array<string>"


def brief_clamp(raw: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """Incoming briefs: scores into range, unreadable scores null, at most five
    themes of sixty characters."""
    j = raw.withColumn("_j", F.from_json(body, BRIEF_JSON))

    def score(f: str) -> Column:
        v = F.col(f"_j.{f}").try_cast("double")
        return clamp(F.when(~F.isnan(v), v), 0.0 if f in UNSIGNED else -1.0).alias(f)
    themes = F.slice(F.transform(F.coalesce("_j.themes", F.array().cast("array<string>")), lambda t: F.substring(t, 1, 60)), 1, 5)
    return j.select(*keys, *[score(f) for f in FIELDS], F.substring(F.coalesce("_j.rationale", F.lit("")), 1, 1000).alias("rationale"), themes.alias("themes"))


def brief_features(brief: DataFrame, keys: list[str], prefix: str = "gem_") -> DataFrame:
    c = F.col
    missing = sum((F.when(c(f).isNull(), 1.0).otherwise(0.0) for f in FIELDS[1:]), F.when(c(FIELDS[0]).isNull(), 1.0).otherwise(0.0))
    damp = F.greatest(F.lit(0.0), 1 - F.coalesce(c("uncertainty"), F.lit(0.0)))
    return brief.select(
        *keys, *[c(f).alias(prefix + f) for f in FIELDS], c("n_documents").cast("double").alias(prefix + "n_documents"),
        F.size("themes").cast("double").alias(prefix + "n_themes"), missing.alias(prefix + "n_missing"), F.when(c("is_synthetic"), 1.0).otherwise(0.0).alias(prefix + "is_synthetic"),
        (c("recent_sentiment") * c("confidence") * damp).alias(prefix + "conviction"), (c("sentiment_shift") * c("attention_level")).alias(prefix + "weighted_shift"),
        (c("sentiment_shift") - (c("recent_sentiment") - c("baseline_sentiment"))).alias(prefix + "sentiment_gap"),
        (c("recent_sentiment") - c("macro_sentiment")).alias(prefix + "macro_divergence"))
