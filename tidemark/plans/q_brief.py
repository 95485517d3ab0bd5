"""Sentiment brief queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import brief as br
from ..operators import documents as doc
from ..session import cut_lineage
from ..sources import views
from ..sources.tables import table
from .cte import DOCS, with_
from .q_documents import NOVELTY, SCORES, WIN, scores
from .q_returns import rounded
from .q_windows import GRID28, MONTHLY
from .registry import query

KEYS = ["symbol", "as_of"]
BRIEF = """a AS (SELECT b.symbol, b.as_of, b.ds, COUNT(doc_id) AS n, AVG(s) AS m, STDDEV_POP(s) AS sd, AVG(CASE WHEN kind = 'community' THEN s END) AS com,
  AVG(CAST(hedged AS INT)) AS unc, AVG(CASE WHEN fwd THEN s END) AS fwd FROM (SELECT symbol, as_of, ds, st, en FROM (SELECT DISTINCT symbol FROM docs), ws WHERE ds <> 'macro') b
  LEFT JOIN sc ON sc.symbol = b.symbol AND published >= st AND published < en GROUP BY ALL),
mc AS (SELECT as_of, COUNT(*) AS mn, AVG(s) AS mm FROM sc JOIN ws ON published >= st AND published < en WHERE ds = 'macro' GROUP BY as_of),
bf AS (SELECT symbol, as_of, b.m AS baseline_sentiment, r.m AS recent_sentiment, r.m - b.m AS sentiment_shift, r.com AS community_sentiment, mm AS macro_sentiment,
  n_new / n_recent * CASE WHEN COALESCE(r.m, 0) >= COALESCE(b.m, 0) THEN 1 ELSE -1 END AS narrative_change, CASE WHEN r.n > 0 THEN LEAST(1.0, r.n / 60.0 / 5.0) END AS attention_level,
  CASE WHEN r.n > 0 THEN LEAST(1.0, r.sd * 2) END AS controversy, r.unc AS uncertainty, r.fwd AS forward_looking_tone, 0.0 AS confidence, b.n + r.n + COALESCE(mn, 0) AS n_documents
  FROM (SELECT * FROM a WHERE ds = 'news_baseline') b JOIN (SELECT * FROM a WHERE ds = 'news_recent') r USING (symbol, as_of) LEFT JOIN mc USING (as_of) LEFT JOIN nv USING (symbol, as_of))"""
PARTS = (DOCS, SCORES, GRID28, WIN, NOVELTY, BRIEF)


def brief(spark, sf):
    return br.lexicon_brief(cut_lineage(scores(spark, sf)), doc.vocab_novelty(views.docs(spark, sf), MONTHLY), MONTHLY)


@query("lexicon_brief", with_(*PARTS) + f"SELECT symbol, as_of, {', '.join(f'ROUND({f}::DOUBLE, 6) AS {f}' for f in br.FIELDS)}, n_documents FROM bf")
def _(spark, sf):
    return rounded(brief(spark, sf).drop("themes", "is_synthetic"), KEYS)


@query("brief_features", with_(*PARTS) + f"""SELECT symbol, as_of, {', '.join(f'ROUND({f}::DOUBLE, 6) AS gem_{f}' for f in br.FIELDS)}, n_documents::DOUBLE AS gem_n_documents, 0.0 AS gem_n_themes,
  ({' + '.join(f'CASE WHEN {f} IS NULL THEN 1 ELSE 0 END' for f in br.FIELDS)})::DOUBLE AS gem_n_missing, 1.0 AS gem_is_synthetic,
  ROUND(recent_sentiment * 0.0, 6) AS gem_conviction, ROUND(sentiment_shift * attention_level, 6) AS gem_weighted_shift,
  ROUND(sentiment_shift - (recent_sentiment - baseline_sentiment), 6) AS gem_sentiment_gap, ROUND(recent_sentiment - macro_sentiment, 6) AS gem_macro_divergence FROM bf""")
def _(spark, sf):
    return rounded(br.brief_features(brief(spark, sf), KEYS), KEYS)


@query("brief_clamp", """WITH k AS (SELECT event_id, value, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS n FROM events)
SELECT event_id, ROUND(GREATEST(-1, LEAST(1, value / 100 - 1)), 6) AS recent_sentiment, CASE WHEN n % 3 = 0 THEN NULL ELSE ROUND(GREATEST(0, LEAST(1, value / 50 - 1)), 6) END AS attention_level,
  CAST(LEAST(5, n % 8) AS INT) AS n_themes, CASE WHEN n % 8 > 0 THEN repeat('t', CAST(LEAST(60, n) AS INT)) END AS first_theme FROM k""")
def _(spark, sf):
    e = table(spark, sf, "events")
    n = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    theme = F.repeat(F.lit("t"), n)
    body = F.to_json(F.struct((F.col("value") / 100 - 1).cast("string").alias("recent_sentiment"),
                              F.when(n % 3 == 0, "high").otherwise((F.col("value") / 50 - 1).cast("string")).alias("attention_level"),
                              F.when(n % 8 > 0, F.array_repeat(theme, n % 8)).alias("themes")))
    c = br.brief_clamp(e.select("event_id", body.alias("raw")), "raw", ["event_id"])
    return rounded(c.select("event_id", "recent_sentiment", "attention_level", F.size("themes").alias("n_themes"), F.get("themes", F.lit(0)).alias("first_theme")), ["event_id"])
