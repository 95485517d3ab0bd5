"""Split and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators.ranking import with_row
from ..sources import views
from ..sources.tables import table
from . import panel as pn
from .cte import GRID, PARTICIPANTS, PREDICTIONS, PRICES, RETURNS, SCORED, with_
from .q_panel import TARGET
from .q_returns import BY, returns, rounded
from .q_windows import WEEKLY
from .registry import query


@query("walk_forward", with_(PRICES, GRID, TARGET, """p AS (SELECT as_of, ROW_NUMBER() OVER (ORDER BY as_of, symbol) - 1 AS pos, COUNT(*) OVER () AS n FROM tg WHERE log_return IS NOT NULL),
f AS (SELECT *, i AS fold, n // 6 AS sz, (n // 6) * (i + 1) AS te FROM p, generate_series(0, 4) t(i)),
r AS (SELECT *, CASE WHEN pos < te THEN 'train' WHEN pos >= te + 5 AND pos < LEAST(te + 5 + sz, n) THEN 'valid' END AS role FROM f WHERE te + 5 < n)""") + """
SELECT fold, role, COUNT(*) AS n_rows, MIN(as_of) AS first_as_of, MAX(as_of) AS last_as_of FROM r WHERE role IS NOT NULL GROUP BY fold, role""")
def _(spark, sf):
    panel = pn.compute_target(views.prices(spark, sf), WEEKLY).filter(F.col("target").isNotNull())
    f = ev.walk_forward(panel, ["as_of", "symbol"], 5, ev.purge_gap(7, 21))
    return f.groupBy("fold", "role").agg(F.count("*").alias("n_rows"), F.min("as_of").alias("first_as_of"), F.max("as_of").alias("last_as_of"))


@query("regression_metrics", with_(PREDICTIONS) + """SELECT fold, COUNT(*) AS n, ROUND(1 - SUM((y - p) ** 2) / (VAR_POP(y) * COUNT(*)), 6) AS r2, ROUND(SQRT(AVG((y - p) ** 2)), 6) AS rmse,
  ROUND(AVG(ABS(y - p)), 6) AS mae FROM predictions GROUP BY ROLLUP (fold)""")
def _(spark, sf):
    return rounded(ev.regression_metrics(views.predictions(spark, sf)), ["fold"])


@query("directional_accuracy", with_(PREDICTIONS) + """SELECT fold, ROUND(AVG(CASE WHEN y <> 0 THEN CASE WHEN SIGN(p) = SIGN(y) THEN 1.0 ELSE 0.0 END END), 6) AS directional_accuracy, COUNT(*) FILTER (y <> 0) AS n
FROM predictions GROUP BY ROLLUP (fold)""")
def _(spark, sf):
    return rounded(ev.directional_accuracy(views.predictions(spark, sf)), ["fold"])


@query("information_coef", with_(PREDICTIONS, "r AS (SELECT RANK() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS a, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2.0 AS b FROM predictions)") + """
SELECT COUNT(*) AS n, ROUND(CORR(a, b), 6) AS information_coefficient FROM r""")
def _(spark, sf):
    return rounded(ev.information_coefficient(views.predictions(spark, sf)), [])


@query("hit_rate_top", with_(PREDICTIONS, "q AS (SELECT QUANTILE_CONT(ABS(p), 0.9) AS c FROM predictions)") + """
SELECT COUNT(*) FILTER (y <> 0) AS n_top, ROUND(AVG(CASE WHEN y <> 0 THEN CASE WHEN SIGN(p) = SIGN(y) THEN 1.0 ELSE 0.0 END END), 6) AS hit_rate FROM predictions, q WHERE ABS(p) >= c""")
def _(spark, sf):
    return rounded(ev.hit_rate_top(views.predictions(spark, sf)), [])


@query("zero_baseline", with_(PRICES, RETURNS) + """SELECT symbol, date, 0.0 AS zero, ROUND(SUM(lr) OVER (w ROWS 20 PRECEDING), 6) AS trailing_21,
  ROUND(CASE WHEN COUNT(lr) OVER (w ROWS UNBOUNDED PRECEDING) > 60 THEN AVG(lr) OVER (w ROWS 251 PRECEDING) * 21 * 0.25 ELSE 0 END, 6) AS drift FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def _(spark, sf):
    return rounded(ev.zero_baseline(returns(spark, sf), BY), ["symbol", "date"])


CUT = """CASE WHEN pos >= n - GREATEST(1, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT)) THEN 'test' WHEN pos >= n - 2 * GREATEST(1, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT)) THEN 'val' ELSE 'train' END"""


@query("split_grouped", with_(PARTICIPANTS, "m AS (SELECT match_id, ROW_NUMBER() OVER (ORDER BY md5(CAST(match_id AS VARCHAR) || '|7'), match_id) - 1 AS pos, COUNT(*) OVER () AS n FROM (SELECT DISTINCT match_id FROM participants))",
                             f"s AS (SELECT match_id, {CUT} AS split FROM m)") + "SELECT match_id, seat, split FROM participants JOIN s USING (match_id)")
def _(spark, sf):
    p = views.participants(spark, sf)
    return p.join(ev.split_grouped(p, "match_id", 7), "match_id").select("match_id", "seat", "split")


@query("split_chronological", f"""WITH f AS (SELECT l_orderkey, MIN(l_shipdate) AS ts FROM lineitem GROUP BY 1), m AS (SELECT l_orderkey, ts, ROW_NUMBER() OVER (ORDER BY ts, l_orderkey) - 1 AS pos, COUNT(*) OVER () AS n FROM f)
SELECT l_orderkey, CAST(ts AS DATE) AS first_day, {CUT} AS split FROM m""")
def _(spark, sf):
    s = ev.split_chronological(table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate"), "l_orderkey", "l_shipdate")
    return s.select("l_orderkey", F.to_date("first_ts").alias("first_day"), "split")


@query("split_leak_check", f"""WITH k AS (SELECT l_orderkey, l_linenumber, concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber, '-', CAST(l_quantity AS INT), '-', epoch_ms(l_shipdate)) AS rid FROM lineitem),
m AS (SELECT l_orderkey, ROW_NUMBER() OVER (ORDER BY md5(rid || '|7'), rid) - 1 AS pos, COUNT(*) OVER () AS n FROM k), s AS (SELECT l_orderkey, {CUT} AS split FROM m),
g AS (SELECT l_orderkey, MAX(split = 'test') AS t, MAX(split = 'train') AS r FROM s GROUP BY 1)
SELECT COUNT(*) FILTER (t) AS n_test_groups, COUNT(*) FILTER (t AND r) AS n_leaked, ROUND(COUNT(*) FILTER (t AND r) / COUNT(*) FILTER (t), 6) AS leak_share FROM g""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int"),
                                                                         F.unix_millis(F.col("l_shipdate").cast("timestamp"))).alias("rid"))
    return rounded(ev.group_leak(ev.split_rows(li, "rid", 7), "l_orderkey"), [])


Q = "LEAST(1 - 1e-7::DOUBLE, GREATEST(1e-7::DOUBLE, p))"


def metrics_sql(source: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    grp, sel = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""rk AS (SELECT *, {Q} AS q, RANK() OVER ({part} ORDER BY {Q}) + (COUNT(*) OVER (PARTITION BY {by + ', ' if by else ''}{Q}) - 1) / 2.0 AS rk FROM {source}),
mt AS (SELECT {sel}COUNT(*) AS n, SUM(y) AS n1, COUNT(*) - SUM(y) AS n0, (SUM(CASE WHEN y = 1 THEN rk END) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y) * (COUNT(*) - SUM(y))) AS roc_auc,
  -AVG(y * LN(q) + (1 - y) * LN(1 - q)) AS log_loss, AVG((q - y) ** 2) AS brier, AVG(CASE WHEN (q >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END) AS accuracy FROM rk {grp})"""


@query("classification_metrics", with_(SCORED, metrics_sql("scored", "")) + "SELECT n, ROUND(roc_auc, 6) AS roc_auc, ROUND(log_loss, 6) AS log_loss, ROUND(brier, 6) AS brier, ROUND(accuracy, 6) AS accuracy FROM mt")
def _(spark, sf):
    return rounded(ev.classification_metrics(views.scored(spark, sf), []), [])


@query("auc_null_se", with_(SCORED, metrics_sql("scored", "")) + """SELECT CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0, ROUND(roc_auc, 6) AS roc_auc, ROUND(SQRT((n0 + n1 + 1) / (12.0 * n0 * n1)), 6) AS null_se,
  ABS(roc_auc - 0.5) > 3 * SQRT((n0 + n1 + 1) / (12.0 * n0 * n1)) AS canary_leak FROM mt""")
def _(spark, sf):
    return rounded(ev.auc_null_se(views.scored(spark, sf), []), [])


MODELS = """ml AS (SELECT doc_id, y, 'logistic' AS model, p FROM scored UNION ALL SELECT doc_id, y, 'mlp', CASE WHEN y = 1 THEN 0.4 + p * 0.6 ELSE p * 0.7 END FROM scored
  UNION ALL SELECT doc_id, y, 'sharp', CASE WHEN p > 0.5 THEN 0.999 ELSE 0.001 END FROM scored UNION ALL SELECT doc_id, y, 'majority', (SELECT AVG(y) FROM scored) FROM scored)"""


@query("compare_models", with_(SCORED, MODELS, metrics_sql("ml", "model")) + """SELECT m.model, m.n, ROUND(m.roc_auc, 6) AS roc_auc, ROUND(m.log_loss, 6) AS log_loss, ROUND(m.brier, 6) AS brier, ROUND(m.accuracy, 6) AS accuracy,
  ROUND(m.roc_auc - f.roc_auc, 6) AS d_auc, ROUND(m.log_loss - f.log_loss, 6) AS d_log_loss, m.model <> 'majority' AND m.log_loss > 1.05 * b.log_loss AS overconfident
FROM mt m, (SELECT * FROM mt WHERE model = 'logistic') f, (SELECT * FROM mt WHERE model = 'majority') b""")
def _(spark, sf):
    s = views.scored(spark, sf)
    rate = s.agg(F.avg("y").alias("_rate"))
    p = F.col("p")
    rows = F.array(F.struct(F.lit("logistic").alias("model"), p.alias("p")), F.struct(F.lit("mlp").alias("model"), F.when(F.col("y") == 1, 0.4 + p * 0.6).otherwise(p * 0.7).alias("p")),
                   F.struct(F.lit("sharp").alias("model"), F.when(p > 0.5, 0.999).otherwise(0.001).alias("p")), F.struct(F.lit("majority").alias("model"), F.col("_rate").alias("p")))
    pred = with_row(s, rate).select("doc_id", "y", F.inline(rows))
    return rounded(ev.compare_models(pred), ["model"])
