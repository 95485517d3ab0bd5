"""Posting pipeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import postings as po
from ..operators.joins import dedup_key, normalize_url
from ..sources import views
from ..sources.tables import table, text_table
from .cte import APP_LOG, POSTINGS, with_
from .q_documents import PROFILE, SKILLS
from .q_joins import applied_log
from .registry import query

PREFS = po.Preferences(max_age_days=45)
NOW = "2001-08-01 12:00:00"
SYN = {"red": "crimson", "ml": "machine learning", "small": "tiny"}


def now():
    return F.lit(NOW).cast("timestamp")


def sql_phrases(c: str, phrases, synonyms=fixed.SYNONYMS) -> str:
    text = c
    for k, v in synonyms.items():
        text = f"regexp_replace({text}, '\\b{k}\\b', '{v}', 'gi')"
    return "regexp_matches({}, '{}', 'i')".format(text, po.phrase_pattern(phrases, synonyms, r"\b", r"\b")[4:].replace("'", "''"))


def sql_any(c: str, patterns, flags="i") -> str:
    return "regexp_matches({}, '{}', '{}')".format(c, "|".join(f"(?:{p})" for p in patterns).replace("'", "''"), flags)


@query("expand_synonyms", "SELECT p_partkey, regexp_replace(regexp_replace(p_name, '\\bred\\b', 'crimson', 'g'), '\\bsmall\\b', 'tiny', 'g') AS expanded FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", po.expand_synonyms(F.col("p_name"), SYN).alias("expanded"))


PHRASES = ("thth", "ther ou", "tion.", "er-ly")


@query("match_phrases", f"SELECT doc_id, {sql_phrases('text', PHRASES, {})} AS matched FROM documents")
def _(spark, sf):
    return text_table(spark, sf, "documents").select("doc_id", po.match_phrases(F.col("text"), PHRASES, {}).alias("matched"))


# the classifier rules in SQL, on the template postings (no remote_status column)
HEAD = "COALESCE(location, '')"
BOTH = "COALESCE(location, '') || chr(10) || description"
CUT = "CASE WHEN regexp_matches(description, 'these\\s+do\\s+not\\s+apply', 'i') THEN '' ELSE description END"
RULES = f"""rm AS (SELECT *, {sql_any(HEAD, [fixed.CLAIMS_REMOTE])} OR {sql_any('description', fixed.FULLY_REMOTE)} AS claims_remote,
  ({sql_any(HEAD, [fixed.HYBRID_BARE])} OR {sql_any(CUT, fixed.HYBRID_SIGNALS)}) AS sig, {sql_any(BOTH, fixed.FULLY_REMOTE)} AS fully,
  CASE WHEN {sql_any(BOTH, fixed.CANADA_SCOPE)} THEN 'canada' WHEN {sql_any(BOTH, fixed.US_SCOPE_CASED, '')} OR {sql_any(BOTH, fixed.US_SCOPE)} THEN 'us' WHEN {sql_any(BOTH, fixed.GLOBAL_SCOPE)} THEN 'global' ELSE 'unknown' END AS scope FROM postings),
r2 AS (SELECT *, sig AND NOT fully AS is_hybrid, claims_remote AND NOT (sig AND NOT fully) AND scope <> 'us' AS qualifies FROM rm),
bk AS (SELECT *, CASE WHEN COALESCE(location, '') = '' THEN 'unknown' WHEN {sql_any(HEAD, fixed.BUCKET_PATTERNS['calgary'])} THEN 'calgary' WHEN {sql_any(HEAD, fixed.BUCKET_PATTERNS['edmonton'])} THEN 'edmonton'
  WHEN qualifies THEN 'remote' WHEN regexp_matches({HEAD}, '\\bvancouver\\b', 'i') AND NOT regexp_matches({HEAD}, '\\bvancouver\\s*,?\\s*(wa\\b|washington)', 'i') THEN 'vancouver' WHEN {sql_any(HEAD, fixed.BUCKET_PATTERNS['seattle'])} THEN 'seattle' END AS location_bucket FROM r2),
us AS (SELECT *, COALESCE((COALESCE(location_bucket = 'seattle', false) OR regexp_matches({HEAD}, '{fixed.US_RESTRICTED}') OR regexp_matches(title || chr(10) || description, '{fixed.US_RESTRICTED}')
  OR (COALESCE(location_bucket = 'remote', false) AND regexp_matches({HEAD}, '{fixed.US_LOCATION}') AND NOT regexp_matches({HEAD}, '\\bcanada\\b', 'i'))) AND NOT regexp_matches(title || chr(10) || description, '{fixed.SPONSORSHIP}', 'i'), false)
  AND location_bucket IS NOT NULL AS unsponsored_us FROM bk),
kw AS (SELECT *, CASE WHEN location_bucket IS NULL OR location_bucket = 'unknown' THEN 0::DOUBLE ELSE (CASE location_bucket WHEN 'calgary' THEN 0.5 WHEN 'edmonton' THEN 0.2 WHEN 'remote' THEN 0.15 WHEN 'vancouver' THEN 0.1 ELSE 0.05 END::DOUBLE / 0.5::DOUBLE) * CASE WHEN unsponsored_us THEN 0.35 ELSE 1 END::DOUBLE END AS loc,
  0.5::DOUBLE * CASE WHEN {sql_phrases('title', fixed.PRIMARY_ROLES)} THEN 1.0 WHEN {sql_phrases('title', fixed.SIMILAR_ROLES)} THEN 0.7 WHEN {sql_phrases('description', (*fixed.PRIMARY_ROLES, *fixed.SIMILAR_ROLES))} THEN 0.4 ELSE 0 END::DOUBLE
  + 0.3::DOUBLE * CASE WHEN {sql_phrases('title', fixed.LEVEL_KEYWORDS)} THEN 1.0 WHEN {sql_phrases('description', fixed.LEVEL_KEYWORDS)} THEN 0.5 ELSE 0 END::DOUBLE
  + 0.2::DOUBLE * CASE WHEN {sql_phrases('title', fixed.TIMING_KEYWORDS)} THEN 1.0 WHEN {sql_phrases('description', fixed.TIMING_KEYWORDS)} THEN 0.7 ELSE 0 END::DOUBLE AS kw FROM us),
yr AS (SELECT *, CASE WHEN description LIKE 'Requires 3+%' THEN 3 WHEN description LIKE 'Fully remote%' THEN 2 END AS years FROM kw),
gt AS (SELECT *, date_diff('second', COALESCE(posted_date, first_seen_at)::TIMESTAMP, TIMESTAMP '2001-08-01 12:00:00') / 86400.0 <= 45 AS fresh, {sql_phrases('title', fixed.EXCLUDED_TITLES)} AS senior,
  ({sql_phrases('title', fixed.ROLE_KEYWORDS)} OR {sql_phrases('title', fixed.GRAD_KEYWORDS)}) AS role_ok FROM yr),
ga AS (SELECT *, CASE WHEN NOT fresh THEN 'stale' WHEN senior THEN 'seniority' WHEN NOT role_ok THEN 'off-role' WHEN COALESCE(years > 2, false) THEN 'experience' WHEN location_bucket IS NULL THEN 'off-location' END AS reason FROM gt)"""


def cols(p):
    return F.col("location"), F.lit(None).cast("string"), F.col("description")


@query("classify_remote", with_(POSTINGS, RULES) + "SELECT id, claims_remote, is_hybrid, scope, qualifies FROM r2")
def _(spark, sf):
    p = views.postings(spark, sf)
    rc = po.remote_columns(*cols(p))
    return p.select("id", *[rc[k].alias(k) for k in ("claims_remote", "is_hybrid", "scope", "qualifies")])


@query("remote_evidence", with_(POSTINGS) + """, k AS (SELECT id, regexp_extract(COALESCE(location, ''), '\\bremote\\b', 0, 'i') AS h, regexp_extract(description, '\\b(?:100%|fully|entirely|completely)\\s*[- ]?\\s*remote\\b', 0, 'i') AS f, location, description FROM postings)
SELECT id, 'claims' AS kind, h AS matched, 'header' AS place, CAST(strpos(location, h) - 1 AS INT) AS start_at FROM k WHERE h <> '' UNION ALL SELECT id, 'fully_remote', f, 'description', CAST(strpos(description, f) - 1 AS INT) FROM k WHERE f <> ''""".replace(", k AS", ",\nk AS", 1))
def _(spark, sf):
    p = views.postings(spark, sf)
    e = p.select("id", F.explode(po.evidence(*cols(p))).alias("e")).filter(F.col("e.kind").isin("claims", "fully_remote"))
    return e.select("id", "e.kind", F.col("e.text").alias("matched"), "e.place", F.col("e.start").alias("start_at"))


@query("location_bucket", with_(POSTINGS, RULES) + "SELECT id, location, location_bucket FROM bk")
def _(spark, sf):
    p = views.postings(spark, sf)
    return p.select("id", "location", po.location_bucket(*cols(p), PREFS).alias("location_bucket"))


def scored(spark, sf):
    return po.scored(views.postings(spark, sf), PREFS)


@query("restriction_flag", with_(POSTINGS, RULES) + "SELECT id, unsponsored_us FROM us")
def _(spark, sf):
    return scored(spark, sf).select("id", "unsponsored_us")


@query("location_score", with_(POSTINGS, RULES) + "SELECT id, ROUND(loc, 4) AS location_score FROM kw")
def _(spark, sf):
    return scored(spark, sf).select("id", "location_score")


@query("keyword_score", with_(POSTINGS, RULES) + "SELECT id, ROUND(kw, 4) AS keyword_score FROM kw")
def _(spark, sf):
    return scored(spark, sf).select("id", "keyword_score")


@query("score_posting", with_(POSTINGS, RULES, """fit AS (SELECT id, CAST(description LIKE '%Python%' AS INT) + CAST(description LIKE '%SQL%' AS INT) AS have,
  CAST(description LIKE '%Python%' AS INT) + CAST(description LIKE '%SQL%' AS INT) + CAST(description LIKE '%Spark%' AS INT) + CAST(description LIKE '%Kafka%' AS INT) AS asked FROM postings),
f2 AS (SELECT id, CASE WHEN asked > 0 THEN ROUND(0.5 * (have + 1) / (asked + 2) + 0.5 * (1 - EXP(-have / 4.0)), 4) END AS resume_score FROM fit)""") + """
SELECT id, location_bucket, resume_score, ROUND(CASE WHEN resume_score IS NULL THEN 0.65::DOUBLE * loc + 0.35::DOUBLE * kw ELSE 0.7::DOUBLE * (0.65::DOUBLE * loc + 0.35::DOUBLE * kw) + 0.3::DOUBLE * resume_score END, 4) AS match_score FROM kw JOIN f2 USING (id)""")
def _(spark, sf):
    prefs = po.Preferences(max_age_days=45, resume_weight=0.3)
    s = po.scored(views.postings(spark, sf), prefs, SKILLS, PROFILE)
    return s.select("id", "location_bucket", "resume_score", "match_score")


@query("max_years", with_("""t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'We want ' || p_size || '+ years of experience.' WHEN 1 THEN p_size || ' - ' || (p_size + 2) || ' years'' experience; also 2 years of SQL'
  WHEN 2 THEN 'A firm with ' || p_size || ' years in business.' WHEN 3 THEN 'Experience: 1 year minimum. ' || repeat('x', 80) || ' ' || p_size || ' years ago we started' END AS d FROM part)""") + """
SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size + 2 WHEN 3 THEN 1 END AS BIGINT) AS years FROM part""")
def _(spark, sf):
    n = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 5
    d = (F.when(k == 0, F.concat(F.lit("We want "), n, F.lit("+ years of experience.")))
         .when(k == 1, F.concat(n, F.lit(" - "), (F.col("p_size") + 2).cast("string"), F.lit(" years' experience; also 2 years of SQL")))
         .when(k == 2, F.concat(F.lit("A firm with "), n, F.lit(" years in business.")))
         .when(k == 3, F.concat(F.lit("Experience: 1 year minimum. "), F.repeat(F.lit("x"), F.lit(80)), F.lit(" "), n, F.lit(" years ago we started"))))
    return table(spark, sf, "part").select("p_partkey", po.max_years(d).alias("years"))


@query("ingest_gate", with_(POSTINGS, RULES) + "SELECT id, reason FROM ga")
def _(spark, sf):
    return po.gated(views.postings(spark, sf), PREFS, now()).select("id", "reason")


@query("rejection_report", with_(POSTINGS, RULES) + "SELECT source, COALESCE(reason, 'kept') AS reason, COUNT(*) AS n FROM ga GROUP BY 1, 2")
def _(spark, sf):
    return po.rejection_report(po.gated(views.postings(spark, sf), PREFS, now()), ["source"])


@query("normalize_url", "SELECT page_id, lower(regexp_replace(regexp_replace(url || CASE WHEN page_id % 2 = 0 THEN '//?a=1#b' ELSE '/#x?y' END, '[?#].*$', ''), '/+$', '')) AS clean FROM pages")
def _(spark, sf):
    url = F.concat("url", F.when(F.col("page_id") % 2 == 0, "//?a=1#b").otherwise("/#x?y"))
    return table(spark, sf, "pages").select("page_id", normalize_url(url).alias("clean"))


KEY = "trim(regexp_replace(regexp_replace(lower(title || ' ' || company || ' ' || COALESCE(location, '')), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query("dedup_key", with_(POSTINGS) + f"SELECT id, {KEY} AS dedup_key FROM postings")
def _(spark, sf):
    return views.postings(spark, sf).select("id", dedup_key(F.col("title"), F.col("company"), F.col("location")).alias("dedup_key"))


@query("dedup_exact", with_(POSTINGS) + "SELECT id, apply_url FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY apply_url ORDER BY first_seen_at, id) AS k FROM postings) WHERE k = 1")
def _(spark, sf):
    return po.dedup_exact(views.postings(spark, sf)).select("id", "apply_url")


TITLE = "trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
NEAR = "levenshtein(a.key, b.key) <= 0.2::DOUBLE * GREATEST(length(a.key), length(b.key)) AND levenshtein(a.t, b.t) <= 0.2::DOUBLE * GREATEST(length(a.t), length(b.t))"
FUZZY = f"""RECURSIVE postings_ AS (SELECT 1), {POSTINGS}, nk AS (SELECT {KEY} AS key, MIN(id) AS rank, MIN({TITLE}) AS t FROM postings GROUP BY 1),
pr AS (SELECT a.rank AS a, b.rank AS b FROM nk a, nk b WHERE {NEAR}),
rc(a, b) AS (SELECT a, b FROM pr UNION SELECT rc.a, pr.b FROM rc JOIN pr ON rc.b = pr.a),
gr AS (SELECT a AS rank, MIN(b) AS duplicate_of FROM rc GROUP BY a)"""


@query("dedup_fuzzy", f"WITH {FUZZY} SELECT id, duplicate_of FROM postings p JOIN nk ON nk.key = {KEY} JOIN gr USING (rank)")
def _(spark, sf):
    return po.dedup_fuzzy(views.postings(spark, sf).select("id", "title", "company", "location")).select("id", "duplicate_of")


@query("merge_sources", with_(POSTINGS, "f AS (SELECT apply_url, source, MIN((first_seen_at, id)) AS o FROM postings GROUP BY 1, 2)") + "SELECT apply_url, string_agg(source, ',' ORDER BY o) AS sources FROM f GROUP BY 1")
def _(spark, sf):
    return po.merge_sources(views.postings(spark, sf), "apply_url").select("apply_url", F.array_join("sources", ",").alias("sources"))


APPLIED = f"""log AS (SELECT CASE WHEN id % 3 = 0 THEN concat('https://boards.example/', CAST(id % 40 AS VARCHAR), '/#top') ELSE url END AS url,
  CASE WHEN id % 500 = 0 THEN 'Backend Developer' ELSE title END AS title, CASE WHEN id % 500 = 0 THEN 'Small corp.' ELSE company END AS company FROM app_log),
lu AS (SELECT DISTINCT lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) AS u FROM log), lk AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(title || ' ' || company || ' '), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS k FROM log),
ap AS (SELECT ga.*, lower(regexp_replace(regexp_replace(apply_url, '[?#].*$', ''), '/+$', '')) IN (SELECT u FROM lu) OR trim(regexp_replace(regexp_replace(lower(title || ' ' || company || ' '), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) IN (SELECT k FROM lk) AS applied,
  CASE id % 4 WHEN 0 THEN 'archived' WHEN 3 THEN 'tailored' ELSE 'new' END AS status FROM ga)"""


def stored(spark, sf):
    status = F.when(F.col("id") % 4 == 0, "archived").when(F.col("id") % 4 == 3, "tailored").otherwise("new")
    return views.postings(spark, sf).withColumn("status", status)


@query("rescore", with_(POSTINGS, APP_LOG, RULES, APPLIED, """j AS (SELECT *, CASE WHEN senior THEN 'seniority' WHEN NOT role_ok THEN 'off-role' WHEN location_bucket IS NULL THEN 'off-location' WHEN NOT fresh THEN 'stale' WHEN applied THEN 'applied' END AS rj FROM ap WHERE status IN ('new', 'archived'))""") + """
SELECT id, rj AS reason, CASE WHEN rj IS NOT NULL AND status <> 'archived' THEN 'archived' WHEN rj IS NULL AND status = 'archived' THEN 'restored' ELSE 'unchanged' END AS change,
  CASE WHEN rj IS NOT NULL OR first_seen_at::TIMESTAMP < TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 60 DAY THEN 'archived' ELSE 'new' END AS final_status FROM j""")
def _(spark, sf):
    return po.rescore(stored(spark, sf), applied_log(spark, sf), PREFS, now()).select("id", "reason", "change", "final_status")


@query("bucket_counts", with_(POSTINGS, RULES) + "SELECT COALESCE(location_bucket, 'unknown') AS bucket, COUNT(*) AS n FROM bk WHERE id % 4 IN (1, 2) GROUP BY 1")
def _(spark, sf):
    from ..operators.feed import bucket_counts
    return bucket_counts(po.scored(stored(spark, sf), PREFS), "location_bucket", F.col("status") == "new")
