"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, matches, regression as reg
from ..operators.windows import asof_calendar
from ..functions.finance import daily_rate
from ..sources import views
from ..sources.tables import table
from .cte import APP_LOG, INDICES, PARTICIPANTS, POSTINGS, PRICES, RISK_FREE, with_
from .q_windows import r
from .registry import query


@query("inner_align", with_(PRICES, INDICES) + """
SELECT symbol, date, ROUND(p.adj_close, 9) AS px, ROUND(m.adj_close, 9) AS mx FROM prices p JOIN market m USING (date)""")
def _(spark, sf):
    p = views.prices(spark, sf).select("symbol", "date", F.col("adj_close").alias("px"))
    m = views.market(spark, sf).select("date", F.col("adj_close").alias("mx"))
    return reg.inner_align(p, m, ["date"]).select("symbol", "date", r(F.col("px"), 9).alias("px"), r(F.col("mx"), 9).alias("mx"))


@query("asof_ffill_join", with_(PRICES, RISK_FREE, "mid AS (SELECT date + 14 AS date, rate FROM risk_free)") + """
SELECT symbol, p.date, ROUND(COALESCE(rate, 0), 8) AS rate, ROUND(POW(1 + COALESCE(rate, 0), 1 / 252.0) - 1, 8) AS rf_daily
FROM prices p ASOF LEFT JOIN mid m ON p.date >= m.date""")
def _(spark, sf):
    mid = views.risk_free(spark, sf).select(F.date_add("date", 14).alias("rf_day"), "rate")
    j = asof_calendar(views.prices(spark, sf).select("symbol", "date"), mid, left_day="date", right_day="rf_day", values=["rate"])
    rate = F.coalesce(F.col("rate"), F.lit(0.0))
    return j.select("symbol", "date", r(rate, 8).alias("rate"), r(daily_rate(rate), 8).alias("rf_daily"))


@query("self_join_opponent", with_(PARTICIPANTS) + """
SELECT a.match_id, a.seat, a.champion, b.champion AS enemy_laner FROM participants a JOIN participants b
ON a.match_id = b.match_id AND a.role = b.role AND a.team_id <> b.team_id""")
def _(spark, sf):
    return matches.opponents(views.participants(spark, sf)).select("match_id", "seat", "champion", "enemy_laner")


@query("anti_applied", with_(POSTINGS, APP_LOG, """
log AS (SELECT id, CASE WHEN id % 3 = 0 THEN concat('https://boards.example/', CAST(id % 40 AS VARCHAR), '/#top') ELSE url END AS url,
  CASE WHEN id % 500 = 0 THEN 'Backend Developer' ELSE title END AS title, CASE WHEN id % 500 = 0 THEN 'Small corp.' ELSE company END AS company FROM app_log),
u AS (SELECT DISTINCT lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) AS u FROM log),
k AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(title || ' ' || company || ' '), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS k FROM log)""") + """
SELECT id, title, company, apply_url FROM postings p
WHERE lower(regexp_replace(regexp_replace(apply_url, '[?#].*$', ''), '/+$', '')) NOT IN (SELECT u FROM u WHERE u <> '')
  AND trim(regexp_replace(regexp_replace(lower(title || ' ' || company || ' '), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) NOT IN (SELECT k FROM k)""")
def _(spark, sf):
    return joins.anti_applied(views.postings(spark, sf), applied_log(spark, sf)).select("id", "title", "company", "apply_url")


def applied_log(spark, sf):
    """The application log, with some rows that name postings of the feed."""
    a = views.app_log(spark, sf).select("id", "title", "company", "url")
    named = F.col("id") % 500 == 0
    url = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://boards.example/"), (F.col("id") % 40).cast("string"), F.lit("/#top"))).otherwise(F.col("url"))
    return a.select("id", url.alias("url"), F.when(named, "Backend Developer").otherwise(F.col("title")).alias("title"),
                    F.when(named, "Small corp.").otherwise(F.col("company")).alias("company"))


@query("anti_existing_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return joins.anti_existing(o, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("cross_probe", with_("""c AS (SELECT s_suppkey, replace(s_name, '#', ' No. ') AS company FROM supplier),
p AS (SELECT * FROM c, (VALUES ('greenhouse', 0), ('lever', 1), ('ashby', 2), ('workable', 3)) v(platform, n)),
t AS (SELECT * FROM p WHERE NOT (s_suppkey % 7 = 0 AND n = 1) AND NOT (s_suppkey % 5 = n AND (s_suppkey % 2 = 0 OR s_suppkey % 60 < 30))),
s AS (SELECT company, platform, trim(regexp_replace(lower(company), '[^a-z0-9\\s-]', '', 'g')) AS clean FROM t)""") + """
SELECT DISTINCT company, platform, slug FROM (SELECT company, platform, UNNEST([regexp_replace(clean, '\\s+', '', 'g'), regexp_replace(clean, '\\s+', '-', 'g')]) AS slug FROM s) WHERE slug <> ''""")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.replace("s_name", F.lit("#"), F.lit(" No. ")).alias("company"))
    names = F.array(*[F.lit(p) for p in ("greenhouse", "lever", "ashby", "workable", "none")])
    overrides = s.filter(F.col("s_suppkey") % 7 == 0).select("company", F.lit("lever").alias("platform"))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    cache = s.select("company", F.element_at(names, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("platform"),
                     F.when(F.col("s_suppkey") % 2 == 0, "override").otherwise("probe").alias("origin"),
                     F.date_sub(F.lit("2024-06-01").cast("date"), (F.col("s_suppkey") % 60).cast("int")).alias("checked_at"))
    return joins.cross_probe(s.select("company"), ["greenhouse", "lever", "ashby", "workable"], overrides, cache, now)


ALIAS_ROWS = [("ring", "RNG"), ("red ring", "RR"), ("large bolt", "LB"), ("bolt", "BLT"), ("blue", "BLU"), ("gear", "GR"), ("hot green gear set", "HGG"), ("wi", "WI"), ("small", "SML")]


@query("ticker_lookup", with_("al(alias, symbol) AS (VALUES " + ", ".join(f"('{a}', '{s}')" for a, s in ALIAS_ROWS) + ")", """
q AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(substr(p_name, 1, 3)) WHEN 1 THEN p_name || ' Inc' ELSE p_name END AS query FROM part),
n AS (SELECT query, regexp_replace(trim(regexp_replace(lower(trim(query)), '[^a-z0-9&'' ]', '', 'g')), '\\s+(inc|corp|corporation|company|co|ltd|plc|sa|nv|ag)\\.?$', '') AS nm FROM q),
f AS (SELECT query, upper(trim(query)) AS symbol, 1.0::DOUBLE AS confidence, 'literal' AS source FROM q WHERE regexp_matches(trim(query), '^\\^?[A-Z]{1,6}(?:[.\\-][A-Z]{1,4})?$')
  UNION ALL SELECT query, symbol, 0.9, 'alias' FROM n JOIN al ON nm = alias
  UNION ALL SELECT query, symbol, 0.7, 'alias-partial' FROM n JOIN al ON length(nm) >= 4 AND (contains(alias, nm) OR contains(nm, alias))),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query, symbol ORDER BY confidence DESC, source) AS k FROM f),
t AS (SELECT query, symbol, confidence, source, ROW_NUMBER() OVER (PARTITION BY query ORDER BY confidence DESC, symbol) AS rank FROM b WHERE k = 1)""") + """
SELECT * FROM t WHERE rank <= 5""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    q = (F.when(F.col("p_partkey") % 4 == 0, F.upper(F.substring("p_name", 1, 3))).when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit(" Inc")))
         .otherwise(F.col("p_name")))
    aliases = spark.createDataFrame(ALIAS_ROWS, "alias string, symbol string")
    return joins.ticker_lookup(p.select(q.alias("query")), aliases)
