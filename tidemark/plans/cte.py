"""SQL fragments for the twins: the raw tables in the shapes the library works on."""

PRICES = """prices AS (
  SELECT p_type AS symbol, CAST(l_shipdate AS DATE) AS date,
         SUM(l_extendedprice) / SUM(l_quantity) AS adj_close, SUM(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type, CAST(l_shipdate AS DATE))"""

INDICES = """indices AS (
  SELECT 'gspc' AS index_key, CAST(l_shipdate AS DATE) AS date, SUM(l_extendedprice) / SUM(l_quantity) AS adj_close
  FROM lineitem GROUP BY CAST(l_shipdate AS DATE)
  UNION ALL
  SELECT CASE l_returnflag WHEN 'A' THEN 'rut' WHEN 'R' THEN 'iwd' ELSE 'iwf' END, CAST(l_shipdate AS DATE),
         SUM(l_extendedprice) / SUM(l_quantity)
  FROM lineitem GROUP BY l_returnflag, CAST(l_shipdate AS DATE)),
market AS (SELECT date, adj_close FROM indices WHERE index_key = 'gspc')"""

RISK_FREE = """risk_free AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, AVG(l_discount) AS rate
  FROM lineitem GROUP BY CAST(date_trunc('month', l_shipdate) AS DATE))"""

MACRO = """macro_series AS (
  SELECT l_returnflag AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         CASE WHEN EXTRACT(MONTH FROM MIN(l_shipdate)) = 5 THEN '.'
              ELSE CAST(ROUND(AVG(l_tax) * 100, 4) AS VARCHAR) END AS value
  FROM lineitem GROUP BY l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE))"""

DOCS = """docs AS (
  SELECT doc_id,
         CASE doc_id % 6 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'LARGE' WHEN 2 THEN 'MEDIUM'
                         WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' ELSE 'STANDARD' END AS symbol,
         DATE '1999-01-01' + CAST((doc_id * 37) % 970 AS INT) AS published,
         substring(text, 1, 80) AS title, text, source, lang,
         CASE WHEN doc_id % 4 = 0 THEN 'community' ELSE 'news' END AS kind,
         CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat('https://', source, '/', CAST(doc_id % 700 AS VARCHAR), '?utm=', lang) END AS url,
         CAST(n_chars % 21 AS DOUBLE) - 10 AS score
  FROM documents)"""

APP_LOG = """app_log AS (
  SELECT o_orderkey AS id, concat('Role ', CAST(o_orderkey % 50 AS VARCHAR)) AS title, c_name AS company,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS platform,
         o_orderdate AS ts,
         CASE o_orderstatus WHEN 'F' THEN 'offer' WHEN 'P' THEN 'interview' ELSE 'applied' END AS status,
         concat('https://jobs.example/', CAST(o_orderkey AS VARCHAR)) AS url
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

POSTINGS = """postings AS (
  SELECT p_partkey AS id, lower(p_brand) AS source, concat(p_type, ' Corp') AS company,
         CASE p_partkey % 7 WHEN 0 THEN 'Senior Software Engineer' WHEN 1 THEN 'Software Engineer, New Grad'
              WHEN 2 THEN 'ML Research Engineer' WHEN 3 THEN 'Customer Support Associate'
              WHEN 4 THEN 'Data Engineer (Jan 2027)' WHEN 5 THEN 'New Graduate Rotational Program'
              ELSE 'Backend Developer' END AS title,
         CASE p_partkey % 8 WHEN 0 THEN 'Calgary, AB' WHEN 1 THEN 'Remote' WHEN 2 THEN 'Seattle, WA' WHEN 3 THEN 'Vancouver, WA'
              WHEN 4 THEN 'Vancouver, BC' WHEN 5 THEN NULL WHEN 6 THEN 'Toronto, ON' ELSE 'Calgary, AB / Remote' END AS location,
         CASE p_partkey % 6 WHEN 0 THEN 'Requires 3+ years of experience with Python and Spark.'
              WHEN 1 THEN 'This is a hybrid role, 3 days per week in the office.'
              WHEN 2 THEN 'Fully remote within Canada. 1-2 years experience.'
              WHEN 3 THEN 'Must be located in the US. No sponsorship mentioned? We offer visa sponsorship.'
              WHEN 4 THEN 'US only. Ten years in business.' ELSE 'Entry level, SQL and Kafka.' END AS description,
         concat('https://boards.example/', CAST(p_partkey % 150 AS VARCHAR), '?gh_src=', CAST(p_size AS VARCHAR)) AS apply_url,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE DATE '2001-08-01' - CAST(p_size AS INT) END AS posted_date,
         DATE '2001-08-01' - CAST(p_partkey % 90 AS INT) AS first_seen_at
  FROM part)"""

PARTICIPANTS = """participants AS (
  SELECT match_id, seat, CASE WHEN seat % 2 = 1 THEN 100 ELSE 200 END AS team_id,
         CAST(FLOOR((seat - 1) / 2) AS INT) AS role, champion, item_id, gold, start_ts,
         CASE WHEN (match_id % 3 = 0) = (seat % 2 = 1) THEN 1 ELSE 0 END AS win
  FROM (SELECT l_orderkey AS match_id, p_brand AS champion, l_suppkey AS item_id, l_extendedprice AS gold, o_orderdate AS start_ts,
               ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seat
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey) t)"""

SCORED = """scored AS (
  SELECT doc_id, quality AS y, CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS p FROM labels)"""

PREDICTIONS = """predictions AS (
  SELECT event_id, CAST(event_id % 5 AS INT) AS fold, value - 100 AS y,
         CAST((event_id * 31) % 201 AS DOUBLE) - 100 AS p FROM events)"""

STATUS_EVENTS = """status_events AS (
  SELECT event_id, user_id AS id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'generating'
         WHEN 'click' THEN 'tailored' WHEN 'purchase' THEN 'applied' ELSE 'rejected' END AS to_status
  FROM events)"""

GRID = """grid AS (
  SELECT CAST(DATE '1999-01-04' + CAST(7 * i AS INT) AS DATE) AS as_of FROM generate_series(0, 135) t(i))"""

RETURNS = """rets AS (
  SELECT symbol, date, adj_close, volume,
         adj_close / LAG(adj_close) OVER w - 1 AS sr, LN(adj_close / LAG(adj_close) OVER w) AS lr,
         ROW_NUMBER() OVER w AS rn, LEAD(date) OVER w AS next_date
  FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
