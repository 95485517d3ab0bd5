"""Document and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, tokens as tok
from ..operators import documents as doc
from ..session import cut_lineage
from ..sources import views
from ..sources.tables import table, text_table
from .cte import DOCS, GRID, POSTINGS, with_
from .q_returns import rounded
from .q_sources import sql_text
from .q_windows import GRID28, MONTHLY, WEEKLY
from .registry import query

# The fixture prose is invented, so frequent tokens stand in for the lexicon.
LEX = tok.Lexicon(positive=("tion", "thre", "ther", "thor", "ble"), negative=("thth", "ly", "ing", "nt", "sh"),
                  uncertainty=("ou", "thin", "thou"), forward=("er", "re", "thed"))


def sql_list(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


SCORES = f"""tk AS (SELECT *, trim(title || chr(10) || chr(10) || text) AS combined, regexp_extract_all(lower(trim(title || chr(10) || chr(10) || text)), '[a-z][a-z\\-'']+') AS tk FROM docs),
pn AS (SELECT *, len(list_filter(tk, lambda x: list_contains({sql_list(LEX.positive)}, x))) AS pos, len(list_filter(tk, lambda x: list_contains({sql_list(LEX.negative)}, x))) AS neg FROM tk),
sc AS (SELECT doc_id, symbol, published, source, kind, score AS tone, combined, text, COALESCE((pos - neg) / NULLIF(pos + neg, 0), 0) AS s,
  list_has_any(tk, {sql_list(LEX.uncertainty)}) AS unc, list_has_any(regexp_split_to_array(lower(combined), '\\s+'), {sql_list(LEX.uncertainty)}) AS hedged,
  list_has_any(regexp_split_to_array(lower(combined), '\\s+'), {sql_list(LEX.forward)}) AS fwd,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS wc FROM pn)"""
WIN = """wn AS (SELECT * FROM (VALUES ('news_baseline', 12, 2), ('news_recent', 2, 0), ('macro', 6, 0)) w(ds, a, b)),
ws AS (SELECT as_of, ds, CAST(as_of - to_months(a) AS DATE) AS st, CAST(as_of - to_months(b) AS DATE) AS en FROM grid, wn)"""


def scores(spark, sf):
    return doc.doc_scores(views.docs(spark, sf), LEX)


def scored_once(spark, sf):
    """Written before it is summed over several windows, so each text is scored once."""
    return cut_lineage(scores(spark, sf))


@query("doc_columns", with_(DOCS) + """SELECT doc_id, md5(trim(title || chr(10) || chr(10) || text)) AS combined_md5, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word_count FROM docs""")
def _(spark, sf):
    return doc.doc_columns(views.docs(spark, sf)).select("doc_id", F.md5("combined").alias("combined_md5"), "word_count")


@query("lexicon_score", with_(DOCS, SCORES) + "SELECT doc_id, ROUND(s, 6) AS sentiment, unc AS uncertain, hedged, fwd AS forward FROM sc")
def _(spark, sf):
    return rounded(scores(spark, sf).select("doc_id", "sentiment", "uncertain", "hedged", "forward"), ["doc_id"])


@query("sentiment_summary", with_(DOCS, SCORES, GRID, WIN) + """
SELECT symbol, as_of, ds, COUNT(*) AS n_docs, ROUND(AVG(s), 6) AS sentiment_mean, ROUND(STDDEV_POP(s), 6) AS sentiment_std, ROUND(AVG(CAST(s > 0.05 AS INT)), 6) AS positive_share,
  ROUND(AVG(CAST(s < -0.05 AS INT)), 6) AS negative_share, ROUND(AVG(CAST(s > 0.05 AS INT)) - AVG(CAST(s < -0.05 AS INT)), 6) AS sentiment_net
FROM sc JOIN ws ON published >= st AND published < en WHERE ds <> 'macro' GROUP BY symbol, as_of, ds""")
def _(spark, sf):
    return rounded(doc.sentiment_summary(scores(spark, sf), WEEKLY, ["symbol"], doc.NEWS), ["symbol", "as_of", "ds"])


BURST = """mb AS (SELECT symbol, as_of, ds, st, en, published, COUNT(*) AS n FROM sc JOIN ws ON published >= st AND published < en WHERE ds <> 'macro' GROUP BY ALL),
wk AS (SELECT *, SUM(n) OVER (PARTITION BY symbol, as_of, ds ORDER BY published RANGE BETWEEN CURRENT ROW AND INTERVAL 6 DAY FOLLOWING) AS wk FROM mb),
br AS (SELECT symbol, as_of, ds, CASE WHEN COUNT(*) >= 2 THEN MAX(wk) / (SUM(n) / date_diff('day', ANY_VALUE(st), ANY_VALUE(en)) * 7) END AS burst_ratio FROM wk GROUP BY symbol, as_of, ds)"""


@query("burst_ratio", with_(DOCS, SCORES, GRID, WIN, BURST) + "SELECT symbol, as_of, ds, ROUND(burst_ratio, 6) AS burst_ratio FROM br")
def _(spark, sf):
    daily = views.docs(spark, sf).groupBy("symbol", "published").agg(F.count("*").alias("n"))
    return rounded(doc.burst_ratio(daily, ["symbol"], WEEKLY, doc.NEWS), ["symbol", "as_of", "ds"])


STATS = BURST + """,
base AS (SELECT symbol, as_of, ds, st, en FROM (SELECT DISTINCT symbol FROM docs), ws WHERE ds <> 'macro'),
st0 AS (SELECT b.symbol, b.as_of, b.ds, COUNT(doc_id)::DOUBLE AS n_docs, COUNT(doc_id) / GREATEST(1, date_diff('day', ANY_VALUE(st), ANY_VALUE(en))) AS docs_per_day, AVG(s) AS sentiment_mean, STDDEV_POP(s) AS sentiment_std,
  AVG(CAST(s > 0.05 AS INT)) AS positive_share, AVG(CAST(s < -0.05 AS INT)) AS negative_share, AVG(CAST(s > 0.05 AS INT)) - AVG(CAST(s < -0.05 AS INT)) AS sentiment_net,
  AVG(CAST(unc AS INT)) AS uncertainty_rate, AVG(wc) AS mean_word_count, COUNT(DISTINCT source) / NULLIF(COUNT(doc_id), 0) AS source_diversity, AVG(CAST(kind = 'community' AS INT)) AS community_share,
  AVG(tone) AS provider_tone_mean, COUNT(CASE WHEN hedged THEN 1 END) AS n_hedged, AVG(CASE WHEN kind = 'community' THEN s END) AS com_mean, AVG(CASE WHEN fwd THEN s END) AS fwd_mean
  FROM base b LEFT JOIN sc ON sc.symbol = b.symbol AND published >= st AND published < en GROUP BY b.symbol, b.as_of, b.ds),
stt AS (SELECT st0.*, burst_ratio FROM st0 LEFT JOIN br USING (symbol, as_of, ds))"""
STAT_COLS = ["docs_per_day", "sentiment_mean", "sentiment_std", "positive_share", "negative_share", "sentiment_net", "uncertainty_rate", "mean_word_count",
             "source_diversity", "community_share", "burst_ratio", "provider_tone_mean"]


@query("text_stats", with_(DOCS, SCORES, GRID, WIN, STATS) + f"SELECT symbol, as_of, ds, n_docs, {', '.join(f'ROUND({c}, 6) AS {c}' for c in STAT_COLS)} FROM stt")
def _(spark, sf):
    return rounded(doc.text_stats(scored_once(spark, sf), WEEKLY, ["symbol"], doc.NEWS), ["symbol", "as_of", "ds"])


SHIFT = """SELECT symbol, as_of, ROUND(r.sentiment_mean - b.sentiment_mean, 6) AS shift_sentiment_delta, ROUND(r.sentiment_net - b.sentiment_net, 6) AS shift_sentiment_net_delta,
  ROUND(r.negative_share - b.negative_share, 6) AS shift_negative_share_delta, ROUND(CASE WHEN b.sentiment_std > 1e-7 THEN (r.sentiment_mean - b.sentiment_mean) / b.sentiment_std END, 5) AS shift_sentiment_zscore,
  ROUND(r.docs_per_day / NULLIF(b.docs_per_day, 0), 6) AS shift_attention_ratio, ROUND(r.docs_per_day - b.docs_per_day, 6) AS shift_attention_delta
FROM stt b JOIN stt r USING (symbol, as_of) WHERE b.ds = 'news_baseline' AND r.ds = 'news_recent'"""


@query("sentiment_shift", with_(DOCS, SCORES, GRID, WIN, STATS) + SHIFT)
def _(spark, sf):
    s = doc.sentiment_shift(doc.text_stats(scored_once(spark, sf), WEEKLY, ["symbol"], doc.NEWS))
    z = F.when(F.abs("shift_sentiment_zscore") < 1e6, F.round("shift_sentiment_zscore", 5))
    return rounded(s.drop("shift_sentiment_zscore"), ["symbol", "as_of"]).join(s.select("symbol", "as_of", z.alias("shift_sentiment_zscore")), ["symbol", "as_of"])


NOVELTY = f"""tm AS (SELECT symbol, published, UNNEST(regexp_extract_all(lower(trim(title || chr(10) || chr(10) || text)), '[a-z][a-z\\-'']{{2,}}')) AS term FROM docs),
tc AS (SELECT symbol, as_of, ds, term, COUNT(*) AS n FROM (SELECT symbol, published, term FROM tm WHERE NOT list_contains({sql_list(fixed.NOVELTY_STOP_WORDS)}, term)) JOIN ws ON published >= st AND published < en WHERE ds <> 'macro' GROUP BY ALL),
tt AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, as_of, ds ORDER BY n DESC, term) AS k FROM tc) WHERE k <= 100),
nv AS (SELECT symbol, as_of, COUNT(*) AS n_recent, COUNT(*) FILTER (NOT EXISTS (SELECT 1 FROM tt b WHERE b.symbol = r.symbol AND b.as_of = r.as_of AND b.ds = 'news_baseline' AND b.term = r.term)) AS n_new
  FROM tt r WHERE ds = 'news_recent' AND EXISTS (SELECT 1 FROM tt b WHERE b.symbol = r.symbol AND b.as_of = r.as_of AND b.ds = 'news_baseline') GROUP BY symbol, as_of)"""


@query("vocab_novelty", with_(DOCS, GRID28, WIN, NOVELTY) + "SELECT symbol, as_of, n_recent, n_new, ROUND(n_new / n_recent, 6) AS vocab_novelty FROM nv")
def _(spark, sf):
    return rounded(doc.vocab_novelty(views.docs(spark, sf), MONTHLY), ["symbol", "as_of"])


@query("window_corpus", with_(DOCS, GRID28, WIN) + """SELECT symbol, as_of, ds, COUNT(*) AS n_docs, md5(string_agg(trim(title || chr(10) || chr(10) || text), chr(10) || chr(10) ORDER BY published, doc_id)) AS corpus_md5
FROM docs JOIN ws ON published >= st AND published < en WHERE ds = 'news_recent' GROUP BY symbol, as_of, ds""")
def _(spark, sf):
    c = doc.window_corpus(views.docs(spark, sf), MONTHLY, ["news_recent"])
    return c.select("symbol", "as_of", "ds", "n_docs", F.md5("corpus").alias("corpus_md5"))


@query("url_dedup", with_(DOCS) + "SELECT doc_id, symbol, published, url FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY COALESCE(url, title) ORDER BY published, doc_id) AS k FROM docs) WHERE k = 1")
def _(spark, sf):
    return doc.url_dedup(views.docs(spark, sf).select("doc_id", "symbol", "published", "url", "title")).drop("title")


@query("name_variants", with_(DOCS, """n AS (SELECT symbol, GREATEST(3, COUNT(*) // 10) AS mn FROM docs GROUP BY symbol),
r AS (SELECT DISTINCT doc_id, symbol, UNNEST(regexp_extract_all(title, '\\b[A-Z][A-Za-z&.''-]{2,}(?:\\s+[A-Z][A-Za-z&.''-]{2,})*')) AS run FROM docs),
c AS (SELECT symbol, run FROM r JOIN n USING (symbol) GROUP BY symbol, run, mn HAVING COUNT(*) >= mn)""") + """
SELECT DISTINCT symbol, variant FROM (SELECT symbol, run AS variant FROM c UNION ALL SELECT symbol, p FROM (SELECT symbol, UNNEST(regexp_split_to_array(run, '\\s+')) AS p FROM c) WHERE length(p) > 3
  UNION ALL SELECT symbol, UNNEST([upper(symbol), lower(symbol), upper(substr(symbol, 1, 1)) || lower(substr(symbol, 2))]) FROM n) WHERE length(variant) > 1""")
def _(spark, sf):
    return doc.name_variants(views.docs(spark, sf))


@query("redact_text")
def _(spark, sf):
    d = views.docs(spark, sf)
    return doc.redact(d, doc.name_variants(d))


def _scrub_sql() -> str:
    text = f"regexp_replace({sql_text('text')}, '[\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g')"
    steps, prev, fired = [f"s0 AS (SELECT conv_id, turn, text AS raw, regexp_replace({text}, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS t FROM conversations)"], "s0", []
    for i, (name, p) in enumerate(fixed.INSTRUCTION_PATTERNS, 1):
        flags = "" if name == "fence-escape" else "i"
        p = p.replace("'", "''")
        marked, back = (p.replace("(?:^|\\n)", "(^|\\n)", 1), "\\1") if name == "role-marker" else (p, "")
        hit = f"regexp_matches(t, '{p}', '{flags}') OR regexp_matches(raw, '{p}', '{flags}')"
        carried = "".join(f", f{k}" for k in range(1, i))
        steps.append(f"s{i} AS (SELECT conv_id, turn, raw, regexp_replace(t, '{marked}', '{back}{fixed.REDACTION}', 'g{flags}') AS t{carried}, CASE WHEN {hit} THEN '{name}' END AS f{i} FROM {prev})")
        prev = f"s{i}"
        fired.append(f"f{i}")
    return with_(*steps) + f"SELECT conv_id, turn, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS scrubbed, concat_ws(',', {', '.join(fired)}) AS triggered FROM {prev}"


@query("instruction_scrub", _scrub_sql())
def _(spark, sf):
    c = text_table(spark, sf, "conversations").select("conv_id", "turn", tok.scrub(F.col("text")).alias("s"))
    return c.select("conv_id", "turn", F.col("s.text").alias("scrubbed"), F.array_join("s.triggered", ",").alias("triggered"))


def stem_sql(t: str) -> str:
    d = lambda n: f"left({t}, CAST(length({t}) - {n} AS INT))"
    sfx = " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) - {len(s)} >= 4 THEN {d(len(s))}" for s in ("ingly", "ing", "edly", "ed", "es"))
    cut = f"""(CASE WHEN length({t}) > 4 AND ends_with({t}, 'ies') THEN {d(3)} || 'y' WHEN length({t}) > 4 AND ends_with({t}, 'sses') THEN {d(2)}
 WHEN length({t}) > 5 AND regexp_matches({t}, '(?:[sxz]|ch|sh)es$') THEN {d(2)} {sfx} WHEN ends_with({t}, 'ss') THEN {t} WHEN ends_with({t}, 's') AND length({t}) - 1 >= 4 THEN {d(1)} ELSE {t} END)"""
    return f"CASE WHEN length({t}) <= 4 OR regexp_matches({t}, '[0-9./+#]') THEN {t} ELSE regexp_replace({cut}, '^(.{{4,}})e$', '\\1') END"


def tokens_sql(c: str) -> str:
    stop = sql_list(fixed.CLAIM_STOP_WORDS)
    raw = f"list_filter(list_transform(string_split(regexp_replace(lower({c}), '[^a-z0-9+#./-]+', ' ', 'g'), ' '), lambda t: regexp_replace(t, '^[-./]+|[-./]+$', '', 'g')), lambda t: length(t) > 1 AND NOT list_contains({stop}, t))"
    parts = f"list_transform(list_filter(string_split(t, '-'), lambda q: length(q) > 1 AND NOT list_contains({stop}, q)), lambda q: {stem_sql('q')})"
    return f"flatten(list_transform({raw}, lambda t: CASE WHEN contains(t, '-') THEN list_concat([{stem_sql('t')}], {parts}) ELSE [{stem_sql('t')}] END))"


@query("tokenize_stem", f"SELECT doc_id, md5(array_to_string(tk, ' ')) AS tokens_md5, CAST(len(tk) AS INT) AS n_tokens FROM (SELECT doc_id, {tokens_sql('text')} AS tk FROM documents)")
def _(spark, sf):
    t = text_table(spark, sf, "documents").select("doc_id", tok.claim_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5(F.array_join("t", " ")).alias("tokens_md5"), F.size("t").alias("n_tokens"))


CLAIMS = f"""ln AS (SELECT doc_id, i AS line, regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g') AS l FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls, UNNEST(generate_series(1, len(regexp_split_to_array(text, '\\r?\\n')))) AS i FROM documents)),
st AS (SELECT *, CASE WHEN l <> '' AND (regexp_matches(l, '^(?:[-*+]\\s|\\d+[.)]\\s|#{{1,6}}\\s|>\\s)') OR l[1] = '|' OR COALESCE(LAG(l) OVER (PARTITION BY doc_id ORDER BY line), '') = '') THEN 1 ELSE 0 END AS new FROM ln),
bk AS (SELECT doc_id, b, MIN(line) AS line, string_agg(l, ' ' ORDER BY line) AS body FROM (SELECT *, SUM(new) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS b FROM st) WHERE l <> '' GROUP BY doc_id, b),
sn AS (SELECT doc_id, line, string_split(regexp_replace(regexp_replace(regexp_replace(body, '^(?:[-*+]|\\d+[.)])\\s+', ''), '^#{{1,6}}\\s+', ''), '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ss FROM bk),
cl0 AS (SELECT doc_id, line, j, regexp_replace(ss[j], '^\\s+|\\s+$', '', 'g') AS claim FROM (SELECT doc_id, line, ss, UNNEST(generate_series(1, len(ss))) AS j FROM sn)),
cl1 AS (SELECT doc_id, line, claim, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY line, j) - 1 AS INT) AS claim_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(claim, '^[\\s>*+-]*', ''), '^#+\\s*', ''), '[*_`]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS bare FROM cl0 WHERE claim <> ''),
cl AS (SELECT * FROM cl1 WHERE length(bare) >= 25 AND NOT regexp_matches(bare, '^-{{3,}}$|^={{3,}}$|^\\|') AND len({tokens_sql('bare')}) >= 4)"""


@query("split_claims", with_(CLAIMS) + "SELECT doc_id, claim_no, line, claim FROM cl")
def _(spark, sf):
    return doc.split_claims(text_table(spark, sf, "documents"))


@query("claim_support", with_(CLAIMS, f"""bt AS (SELECT {tokens_sql('text')} AS tk FROM benchmark),
bu AS (SELECT DISTINCT UNNEST(tk) AS term FROM bt), bb AS (SELECT DISTINCT tk[i] || ' ' || tk[i + 1] AS term FROM (SELECT tk, UNNEST(generate_series(1, len(tk) - 1)) AS i FROM bt)),
ct AS (SELECT doc_id, claim_no, {tokens_sql('claim')} AS tk FROM cl),
u AS (SELECT doc_id, claim_no, AVG(CASE WHEN term IN (SELECT term FROM bu) THEN 1.0 ELSE 0 END) AS unigram FROM (SELECT doc_id, claim_no, UNNEST(tk) AS term FROM ct) GROUP BY ALL),
b AS (SELECT doc_id, claim_no, AVG(CASE WHEN term IN (SELECT term FROM bb) THEN 1.0 ELSE 0 END) AS bigram FROM (SELECT DISTINCT doc_id, claim_no, tk[i] || ' ' || tk[i + 1] AS term FROM (SELECT *, UNNEST(generate_series(1, len(tk) - 1)) AS i FROM ct)) GROUP BY ALL),
z AS (SELECT doc_id, claim_no, unigram, COALESCE(bigram, 0) AS bigram, LEAST(1.0, unigram * 0.75 + COALESCE(bigram, 0) * 0.25 + CASE WHEN unigram >= 0.95 THEN 0.05 ELSE 0 END) AS sc FROM u LEFT JOIN b USING (doc_id, claim_no))""") + """
SELECT doc_id, claim_no, ROUND(unigram, 6) AS unigram, ROUND(bigram, 6) AS bigram, ROUND(sc, 6) AS score FROM z""")
def _(spark, sf):
    c = doc.split_claims(text_table(spark, sf, "documents"))
    s = doc.claim_support(c, table(spark, sf, "benchmark"), ["doc_id", "claim_no"])
    exact = F.least(F.lit(1.0), F.col("unigram") * 0.75 + F.col("bigram") * 0.25 + F.when(F.col("unigram") >= 0.95, 0.05).otherwise(0.0))
    return s.select("doc_id", "claim_no", F.round("unigram", 6).alias("unigram"), F.round("bigram", 6).alias("bigram"), F.round(exact, 6).alias("score"))


def nums_sql(c: str) -> str:
    norm = f"list_transform(regexp_extract_all(lower({c}), '\\d[\\d,.]*\\s*(?:%|k\\+?|m\\+?|b\\+?|x)?'), lambda m: regexp_replace(regexp_replace(m, '[\\s,]', '', 'g'), '\\.$', ''))"
    return f"list_distinct(list_filter(list_concat({norm}, list_transform({norm}, lambda m: regexp_replace(m, '[^0-9.]', '', 'g'))), lambda m: m <> ''))"


@query("unsupported_numbers", with_(CLAIMS, f"k AS (SELECT DISTINCT UNNEST({nums_sql('text')}) AS n FROM benchmark)", f"c AS (SELECT doc_id, claim_no, UNNEST({nums_sql('claim')}) AS number FROM cl)") + """
SELECT doc_id, claim_no, number FROM c WHERE NOT regexp_matches(number, '^(19|20)\\d{2}$') AND number NOT IN (SELECT n FROM k) AND regexp_replace(number, '[^0-9.]', '', 'g') NOT IN (SELECT n FROM k)""")
def _(spark, sf):
    c = doc.split_claims(text_table(spark, sf, "documents"))
    return doc.unsupported_numbers(c, table(spark, sf, "benchmark"), ["doc_id", "claim_no"])


SKILLS = (tok.Skill("Python", ("python",)), tok.Skill("Spark", ("pyspark", "apache spark"), (r"(?<![A-Za-z0-9])Spark(?![A-Za-z0-9])",)),
          tok.Skill("SQL", ("sql",)), tok.Skill("Kafka", ("kafka",)))
PROFILE = ("Python", "SQL")
ASKED = """f AS (SELECT id, title || chr(10) || description AS t FROM postings),
a AS (SELECT id, list_filter([CASE WHEN regexp_matches(t, '(^|[^A-Za-z0-9])python([^A-Za-z0-9]|$)', 'i') THEN 'Python' END,
  CASE WHEN regexp_matches(t, '(^|[^A-Za-z0-9])(pyspark|apache[\\s-]+spark)([^A-Za-z0-9]|$)', 'i') OR regexp_matches(t, '(^|[^A-Za-z0-9])Spark([^A-Za-z0-9]|$)') THEN 'Spark' END,
  CASE WHEN regexp_matches(t, '(^|[^A-Za-z0-9])sql([^A-Za-z0-9]|$)', 'i') THEN 'SQL' END, CASE WHEN regexp_matches(t, '(^|[^A-Za-z0-9])kafka([^A-Za-z0-9]|$)', 'i') THEN 'Kafka' END], lambda x: x IS NOT NULL) AS k FROM f)"""


@query("find_skills", with_(POSTINGS, ASKED) + "SELECT id, array_to_string(k, ',') AS skills FROM a")
def _(spark, sf):
    p = views.postings(spark, sf)
    return p.select("id", F.array_join(tok.find_skills(F.concat_ws("\n", "title", "description"), SKILLS), ",").alias("skills"))


@query("skill_fit", with_(POSTINGS, ASKED, "h AS (SELECT id, k, list_filter(k, lambda x: list_contains(['Python', 'SQL'], x)) AS h, list_filter(k, lambda x: NOT list_contains(['Python', 'SQL'], x)) AS m FROM a)") + """
SELECT id, CASE WHEN len(k) > 0 THEN ROUND(0.5 * (len(h) + 1) / (len(k) + 2) + 0.5 * (1 - EXP(-len(h) / 4.0)), 4) END AS score, array_to_string(h, ',') AS have, array_to_string(m, ',') AS missing FROM h""")
def _(spark, sf):
    p = views.postings(spark, sf).select("id", tok.find_skills(F.concat_ws("\n", "title", "description"), SKILLS).alias("k"))
    f = p.select("id", tok.skill_fit(F.col("k"), PROFILE).alias("f"))
    return f.select("id", "f.score", F.array_join("f.have", ",").alias("have"), F.array_join("f.missing", ",").alias("missing"))
