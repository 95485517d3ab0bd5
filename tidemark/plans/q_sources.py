"""Sources, normalisation and sinks."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import dates, markup
from ..functions.fixed import ENTITIES
from ..operators import selection
from ..session import ensure_checkpoint_dir
from ..sources import postings as raw
from ..sources import series, sinks, views
from ..sources.tables import table
from .cte import APP_LOG, DOCS, MACRO, PRICES, with_
from .q_windows import r
from .registry import query


def scratch(spark, name: str) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{os.urandom(6).hex()}"


@query("scan_ohlcv", with_(PRICES) + """
SELECT symbol, date, CAST(NULL AS DOUBLE) AS open, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS low,
  CASE WHEN dayofmonth(date) <> 13 THEN ROUND(adj_close, 9) END AS close, CASE WHEN dayofmonth(date) <> 13 THEN ROUND(adj_close, 9) END AS adj_close, volume FROM prices""")
def _(spark, sf):
    vendor = views.prices(spark, sf).select("symbol", "date", F.col("volume").cast("string").alias("Volume"),
                                            F.when(F.dayofmonth("date") == 13, "n/a").otherwise(F.col("adj_close").cast("string")).alias("Close"))
    o = series.ohlcv(vendor, {"close": "Close", "volume": "Volume", "high": "High"})
    return o.withColumn("close", r(F.col("close"), 9)).withColumn("adj_close", r(F.col("adj_close"), 9))


@query("norm_date_index", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(ts - INTERVAL 330 MINUTE AS DATE) AS day_from_zone FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", dates.utc_day(F.col("ts")).alias("day"), dates.utc_day(F.col("ts").cast("timestamp"), "Asia/Kolkata").alias("day_from_zone"))


FFILL = """v AS (SELECT series_id, date, TRY_CAST(NULLIF(value, '.') AS DOUBLE) AS v FROM macro_series)"""


@query("scan_series_ffill", with_(MACRO, FFILL) + """
SELECT series_id, date, ROUND(LAST_VALUE(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) / 100, 8) AS value FROM v""")
def _(spark, sf):
    f = series.forward_filled(views.macro_series(spark, sf), percent=True)
    return f.select("series_id", "date", r(F.col("value"), 8).alias("value"))


@query("macro_panel", with_(MACRO, FFILL, """w AS (SELECT date, MAX(CASE WHEN series_id = 'A' THEN v END) AS A, MAX(CASE WHEN series_id = 'N' THEN v END) AS N,
  MAX(CASE WHEN series_id = 'R' THEN v END) AS R FROM v GROUP BY date)""") + """
SELECT date, LAST_VALUE(A IGNORE NULLS) OVER w AS "A", LAST_VALUE(N IGNORE NULLS) OVER w AS "N", LAST_VALUE(R IGNORE NULLS) OVER w AS "R" FROM w WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    return series.panel(views.macro_series(spark, sf), ["A", "N", "R"])


@query("risk_free_fallback", with_("""d AS (SELECT CAST(UNNEST(generate_series((SELECT CAST(MIN(l_shipdate) AS DATE) FROM lineitem), (SELECT CAST(MAX(l_shipdate) AS DATE) FROM lineitem), INTERVAL 1 DAY)) AS DATE) AS date),
f AS (SELECT CAST(l_shipdate AS DATE) AS date, AVG(l_discount) AS rate FROM lineitem WHERE dayofmonth(l_shipdate) = 1 GROUP BY 1)""") + """
SELECT date, ROUND(COALESCE(rate, 0.04), 6) AS rate FROM d LEFT JOIN f USING (date) WHERE isodow(date) < 6""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"), "l_discount")
    span = li.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    found = li.filter(F.dayofmonth("date") == 1).groupBy("date").agg(F.avg("l_discount").alias("rate"))
    return (span.filter(F.weekday("date") < 5).join(found, "date", "left")
            .select("date", r(F.coalesce("rate", F.lit(series.CONSTANT_RISK_FREE))).alias("rate")))


@query("parse_article_date", """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(ts AS DATE) END AS compact, CASE WHEN event_id % 4 < 3 THEN CAST(ts AS DATE) END AS iso FROM events""")
def _(spark, sf):
    k, t = F.col("event_id") % 4, F.col("ts")
    compact = (F.when(k == 0, F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")).when(k == 1, F.date_format(t, "yyyyMMddHHmmss"))
               .when(k == 2, F.date_format(t, "yyyyMMdd")).otherwise("2024-13"))
    iso = (F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss+02:00"))
           .when(k == 2, F.date_format(t, "yyyy-MM-dd")).otherwise("yesterday"))
    return table(spark, sf, "events").select("event_id", dates.compact_date(compact).alias("compact"), dates.iso_date(iso).alias("iso"))


@query("doc_id_hash", "SELECT doc_id, substr(sha1(concat(source, '|', lang, '|', text)), 1, 16) AS hash_id FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.substring(F.sha1(F.concat_ws("|", "source", "lang", "text")), 1, 16).alias("hash_id"))


def sql_strip(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for e, v in [x for x in ENTITIES if x[0] != "&amp;"] + [("&amp;", "&")]:
        out = "replace({}, '{}', '{}')".format(out, e, v.replace("'", "''"))
    return f"trim(regexp_replace({out}, '[\\s ]+', ' ', 'g'))"


def sql_article() -> str:
    t = "html"
    for tag in ("script", "style", "nav", "header", "footer", "aside"):
        t = f"regexp_replace({t}, '<{tag}\\b[^>]*>.*?</{tag}>', '', 'gis')"
    return f"""SELECT page_id, left(COALESCE(array_to_string(list_filter(list_transform(regexp_extract_all({t}, '<p(?:\\s[^>]*)?>(.*?)</p>', 1, 'is'), lambda p: {sql_strip('p')}), lambda p: length(p) > 40), chr(10)), ''), 50000) AS body FROM pages"""


@query("extract_article_text", sql_article())
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.article_text(F.col("html")).alias("body"))


@query("strip_html", f"SELECT page_id, {sql_strip('html')} AS plain FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.strip_html(F.col("html")).alias("plain"))


def sql_text(c: str) -> str:
    out = f"regexp_replace({c}, '<!--[\\s\\S]*?-->', ' ', 'g')"
    for tag in ("script", "style"):
        out = f"regexp_replace({out}, '<{tag}\\b[^>]*>[\\s\\S]*?</{tag}>', ' ', 'gi')"
    out = f"regexp_replace({out}, '</(p|div|li|tr|h[1-6]|blockquote)>', chr(10), 'gi')"
    out = f"regexp_replace({out}, '<br\\s*/?>', chr(10), 'gi')"
    out = f"regexp_replace({out}, '<li\\b[^>]*>', chr(10) || '- ', 'gi')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for e, v in ENTITIES:
        out = "regexp_replace({}, '{}', '{}', 'gi')".format(out, e, v.replace("'", "''"))
    out = f"list_aggregate(list_transform(list_zip(regexp_split_to_array({out}, '&#\\d+;'), list_append(regexp_extract_all({out}, '&#(\\d+);', 1), '')), lambda x: x[1] || CASE WHEN x[2] <> '' THEN chr(CAST(x[2] AS INT)) ELSE '' END), 'string_agg', '')"
    out = f"regexp_replace(regexp_replace({out}, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g')"
    return f"CASE WHEN regexp_matches({c}, '<[a-z!/]', 'i') THEN regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g') ELSE {c} END"


@query("html_to_text", f"SELECT page_id, {sql_text('html')} AS plain FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", markup.html_to_text(F.col("html")).alias("plain"))


NAMES = list(raw.SCHEMAS)


def landed(spark, sf):
    """Raw postings as they land: one JSON text per row and its source."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    loc = F.when(F.col("p_size") % 2 == 0, "Remote, Canada").otherwise("Calgary")
    html = F.concat(F.lit("<p>"), name, F.lit(" &amp; co</p>\n<br/>"))
    url, day = F.concat(F.lit("https://x.example/"), key), F.lit("2024-01-02")
    a = lambda c, n: c.alias(n)
    st, even = F.struct, F.col("p_size") % 2 == 0
    bodies = {
        "greenhouse": st(a(key, "id"), a(name, "title"), a(st(a(loc, "name")), "location"), a(html, "content"), a(url, "absolute_url"), a(day, "updated_at")),
        "lever": st(a(key, "id"), a(name, "text"), a(st(a(loc, "location")), "categories"), a(st(a(F.lit("1"), "min"), a(F.lit("2"), "max"), a(F.lit("CAD"), "currency")), "salaryRange"),
                    a(html, "description"), a(url, "hostedUrl"), a(F.lit(1704153600000), "createdAt")),
        "ashby": st(a(key, "id"), a(name, "title"), a(loc, "location"), a(st(a(F.lit("1 CAD"), "summary")), "compensation"), a(name, "descriptionPlain"), a(url, "jobUrl"), a(day, "publishedAt"), a(even, "isRemote")),
        "workday": st(a(F.array(key), "bulletFields"), a(name, "title"), a(F.when(even, loc).otherwise("3 Locations"), "locationsText"), a(html, "__description"), a(url, "__applyUrl"), a(day, "__postedDate")),
        "workable": st(a(key, "shortcode"), a(name, "title"), a(F.lit(""), "city"), a(F.array(st(a(F.lit("Calgary"), "city"), a(F.lit("AB"), "region"), a(F.lit("Canada"), "country"))), "locations"),
                       a(html, "description"), a(url, "shortlink"), a(day, "created_at"), a(even, "telecommuting")),
        "recruitee": st(a(key, "id"), a(name, "title"), a(F.lit("Calgary"), "city"), a(F.lit("Canada"), "country"), a(html, "description"), a(F.lit("<b>now</b>"), "requirements"),
                        a(st(a(F.lit("5"), "min"), a(F.lit("CAD"), "currency")), "salary"), a(url, "careers_url"), a(F.lit("2024-01-02 10:30:00 UTC"), "published_at"), a(even, "remote")),
        "bamboohr": st(a(key, "id"), a(name, "jobOpeningName"), a(st(a(F.lit("Calgary"), "city"), a(F.lit("AB"), "state")), "location"), a(even, "isRemote"), a(html, "__description"), a(url, "__applyUrl"), a(day, "__datePosted")),
        "remotive": st(a(key, "id"), a(name, "title"), a(F.lit("Acme"), "company_name"), a(loc, "candidate_required_location"), a(html, "description"), a(url, "url"), a(day, "publication_date")),
        "remoteok": st(a(key, "id"), a(name, "position"), a(F.lit("Acme"), "company"), a(loc, "location"), a(F.lit(0), "salary_min"), a(F.lit(9), "salary_max"), a(html, "description"), a(url, "url"), a(day, "date")),
        "weworkremotely": st(a(name, "title"), a(F.lit("Acme"), "company"), a(loc, "location"), a(name, "description"), a(F.concat(url, F.lit("/")), "apply_url"), a(day, "posted_date")),
        "careerpage": st(a(name, "title"), a(st(a(F.lit("Acme"), "name")), "hiringOrganization"), a(st(a(st(a(F.lit("Calgary"), "addressLocality"), a(F.lit("AB"), "addressRegion")), "address")), "jobLocation"),
                         a(st(a(F.lit("CAD"), "currency"), a(st(a(F.lit("1"), "minValue"), a(F.lit("2"), "maxValue")), "value")), "baseSalary"), a(html, "description"), a(url, "__pageUrl"), a(day, "datePosted"),
                         a(F.when(even, "TELECOMMUTE"), "jobLocationType")),
    }
    k = F.col("p_partkey") % len(NAMES)
    body = F.coalesce(*[F.when(k == i, F.to_json(bodies[n])) for i, n in enumerate(NAMES)])
    source = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (k + 1).cast("int"))
    return p.select(source.alias("source"), F.col("p_brand").alias("company"), body.alias("raw"))


def _norm_sql() -> str:
    cases = {n: i for i, n in enumerate(NAMES)}

    def pick(table_: dict, default: str = "NULL") -> str:
        whens = " ".join(f"WHEN {cases[n]} THEN {v}" for n, v in table_.items())
        return f"CASE p_partkey % 11 {whens} ELSE {default} END"
    loc, rem, html = "CASE WHEN p_size % 2 = 0 THEN 'Remote, Canada' ELSE 'Calgary' END", "CASE WHEN p_size % 2 = 0 THEN 'remote' END", "p_name || ' & co'"
    key = "CAST(p_partkey AS VARCHAR)"
    url = f"'https://x.example/' || {key}"
    return f"""SELECT {pick({'careerpage': url}, key)} AS job_id, {pick({n: f"'{n}'" for n in NAMES})} AS source, p_name AS title,
  {pick({n: "'Acme'" for n in ('remotive', 'remoteok', 'weworkremotely', 'careerpage')}, 'p_brand')} AS company,
  {pick({'workday': "CASE WHEN p_size % 2 = 0 THEN 'Remote, Canada' END", 'workable': "'Calgary, AB, Canada'", 'recruitee': "'Calgary, Canada'", 'bamboohr': "'Calgary, AB'", 'careerpage': "'Calgary, AB'"}, loc)} AS location,
  {pick({'lever': "'1-2 CAD'", 'ashby': "'1 CAD'", 'recruitee': "'5- CAD'", 'remoteok': "'-9'", 'careerpage': "'1-2 CAD'"})} AS salary,
  {pick({'ashby': 'p_name', 'weworkremotely': 'p_name', 'recruitee': "p_name || ' & co now'"}, html)} AS description,
  {pick({'weworkremotely': url + " || '/'"}, url)} AS apply_url,
  {pick({'lever': "'2024-01-02T00:00:00.000Z'", 'recruitee': "'2024-01-02T10:30:00.000Z'"}, "'2024-01-02'")} AS posted_date,
  {pick({n: "'remote'" for n in ('remotive', 'remoteok', 'weworkremotely')}, rem)} AS remote_status FROM part"""


@query("norm_postings", _norm_sql())
def _(spark, sf):
    return raw.normalise(landed(spark, sf))


@query("parse_relative_date", """SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN TIMESTAMP '2024-03-31 12:00:00' WHEN 1 THEN TIMESTAMP '2024-03-30 12:00:00' WHEN 2 THEN TIMESTAMP '2024-03-31 12:00:00' - to_days(p_size)
  WHEN 3 THEN TIMESTAMP '2024-03-31 12:00:00' - to_days(7 * p_size) WHEN 4 THEN TIMESTAMP '2024-03-31 12:00:00' - to_months(p_size) END AS DATE) AS posted FROM part""")
def _(spark, sf):
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    text = (F.when(k == 0, "Posted Today").when(k == 1, "Posted Yesterday").when(k == 2, F.concat(F.lit("Posted "), n, F.lit("+ Days Ago")))
            .when(k == 3, F.concat(F.lit("posted "), n, F.lit(" weeks ago"))).when(k == 4, F.concat(F.lit("Posted "), n, F.lit(" Months Ago"))).otherwise("Posted recently"))
    now = F.lit("2024-03-31 12:00:00").cast("timestamp")
    return table(spark, sf, "part").select("p_partkey", F.to_date(dates.relative_date(text, now)).alias("posted"))


@query("keyword_prefilter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'blue')")
def _(spark, sf):
    from ..operators.postings import keyword_prefilter
    return keyword_prefilter(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name"], ["Ring", "BLUE"])


@query("union_by_query", """WITH r AS (SELECT url, page_id, 0 AS q FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, page_id, 1 FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url, page_id, 2 FROM pages)
SELECT url, page_id, q AS query_no FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY url ORDER BY q, page_id) AS k FROM r) WHERE k = 1""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("url", "page_id")
    return selection.union_by_query([p.filter(F.col("page_id") % 2 == 0), p.filter(F.col("page_id") % 3 == 0), p], "url", ["page_id"])


@query("rows_upsert", """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
FROM o WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.filter(F.col("o_orderkey") % 3 == 0).select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return selection.upsert(o.filter(F.col("o_orderkey") % 2 == 0), new, ["o_orderkey"])


@query("export_csv", with_(APP_LOG) + "SELECT CAST(id AS VARCHAR) AS id, title, company, COALESCE(platform, '') AS platform, status, url FROM app_log")
def _(spark, sf):
    folder = scratch(spark, "export")
    log = views.app_log(spark, sf).select("id", "title", "company", "platform", "ts", "status", "url")
    sinks.export_csv(log, folder)
    back = sinks.read_csv(spark, folder, "id string, title string, company string, platform string, ts string, status string, url string")
    return back.select("id", "title", "company", F.coalesce("platform", F.lit("")).alias("platform"), "status", "url")


@query("write_panel", with_(PRICES, DOCS) + """SELECT symbol, COUNT(*) AS n, ROUND(SUM(adj_close), 4) AS total, (SELECT COUNT(*) FROM docs d WHERE d.symbol = p.symbol) AS n_docs FROM prices p GROUP BY symbol""")
def _(spark, sf):
    panel, docs = scratch(spark, "panel"), scratch(spark, "docs")
    sinks.write_panel(views.prices(spark, sf), panel)
    sinks.write_documents(views.docs(spark, sf), docs)
    d = sinks.read_documents(spark, docs, "doc_id bigint, symbol string").groupBy("symbol").agg(F.count("*").alias("n_docs"))
    p = spark.read.parquet(panel).groupBy("symbol").agg(F.count("*").alias("n"), r(F.sum("adj_close"), 4).alias("total"))
    return p.join(d, "symbol")
