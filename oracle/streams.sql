-- name: S01_stream_ingest
SELECT site_id, CASE WHEN n % 11 = 0 THEN 'custom' WHEN n % 7 = 0 THEN 'pageview' ELSE type END AS type, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS event_date,
  COUNT(*) AS events, COUNT(CASE WHEN n % 10 = 0 OR n % 4 = 1 THEN 1 END) AS redacted
FROM raw_ev WHERE n % 13 <> 0 AND n % 17 <> 0 GROUP BY 1, 2, 3
-- name: S02_stream_dedupe
SELECT id, site_id, type FROM web_events
-- name: S03_stream_sessions
WITH g AS (
  SELECT *, CASE WHEN LAG(timestamp) OVER w IS NULL OR timestamp - LAG(timestamp) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS o
  FROM web_events WINDOW w AS (PARTITION BY site_id, user_id ORDER BY timestamp, id)
), k AS (SELECT *, SUM(o) OVER (PARTITION BY site_id, user_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS n FROM g),
v AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, user_id, n, type = 'pageview' ORDER BY timestamp, id) AS f,
    ROW_NUMBER() OVER (PARTITION BY site_id, user_id, n, type = 'pageview' ORDER BY timestamp DESC, id DESC) AS l FROM k
)
SELECT site_id, user_id, CAST(MIN(timestamp) AS VARCHAR) AS started_at, CAST(MAX(timestamp) AS VARCHAR) AS ended_at, DATE_SUB('second', MIN(timestamp), MAX(timestamp)) AS duration,
  COUNT(*) AS events, COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews, MAX(CASE WHEN type = 'pageview' AND f = 1 THEN path END) AS entry_page,
  MAX(CASE WHEN type = 'pageview' AND l = 1 THEN path END) AS exit_page, COUNT(CASE WHEN type = 'pageview' THEN 1 END) <= 1 AS is_bounce
FROM v GROUP BY site_id, user_id, n HAVING MAX(timestamp) + INTERVAL 7 HOUR <= (SELECT MAX(timestamp) FROM web_events)
-- name: S05_stream_event_tail
WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY timestamp DESC, id DESC) AS rn FROM web_events)
SELECT site_id, id, type, path, CAST(timestamp AS VARCHAR) AS timestamp FROM r WHERE rn <= 50
-- name: S06_stream_rollup
WITH e AS (SELECT site_id, CAST(timestamp AS DATE) AS date, COUNT(DISTINCT user_id) AS visitors, COUNT(DISTINCT session_id) AS sessions, COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews FROM web_events GROUP BY 1, 2),
s AS (SELECT site_id, CAST(started_at AS DATE) AS date, COUNT(CASE WHEN is_bounce THEN 1 END) AS bounces, AVG(duration) AS avg_duration FROM web_sessions GROUP BY 1, 2)
SELECT e.site_id, CAST(e.date AS VARCHAR) AS date, visitors, sessions, pageviews, COALESCE(bounces, 0) AS bounces, COALESCE(avg_duration, 0) AS avg_duration FROM e LEFT JOIN s ON s.site_id = e.site_id AND s.date = e.date
-- name: S08_stream_alerts
WITH d AS (SELECT site_id, CAST(timestamp AS DATE) AS date, COUNT(DISTINCT user_id) AS v FROM web_events GROUP BY 1, 2),
w AS (
  SELECT *, AVG(v) OVER t AS m, STDDEV_POP(v) OVER t AS sd, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY date) AS n FROM d
  WINDOW t AS (PARTITION BY site_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
), k AS (SELECT *, CASE WHEN v > m + 2 * sd THEN 'spike' WHEN v < m - 2 * sd THEN 'drop' END AS type FROM w WHERE n > 3 AND sd > 0)
SELECT site_id, CAST(date AS VARCHAR) AS date, type, CASE type WHEN 'spike' THEN 'warning' ELSE 'error' END AS severity,
  'Traffic ' || type || ': ' || CAST(v AS VARCHAR) || ' visitors (avg: ' || CAST(CAST(FLOOR(m + 0.5) AS BIGINT) AS VARCHAR) || ')' AS message,
  v AS value, CAST(FLOOR(m + 0.5) AS BIGINT) AS average, CAST(FLOOR((v - m) / m * 100 + 0.5) AS BIGINT) AS change
FROM k WHERE type IS NOT NULL
-- name: S09_time_buckets
SELECT CAST(DATE_TRUNC('hour', timestamp) AS VARCHAR) AS bucket, site_id, COUNT(*) AS events, COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews FROM web_events GROUP BY 1, 2
-- name: S07_stream_rage_clicks
WITH RECURSIVE c AS (
  SELECT CASE WHEN user_id % 10 < 7 THEN 'site_a' WHEN user_id % 10 < 9 THEN 'site_b' ELSE 'site_c' END AS site_id, 'u_' || CAST(user_id AS VARCHAR) AS user_id,
    's_' || CAST(user_id AS VARCHAR) AS session_id, '/' AS path, 'a.r' || CAST(event_id % 2 AS VARCHAR) AS selector,
    (EPOCH_US(ts) + i * CASE WHEN event_id % 3 = 0 THEN 300000 ELSE 700000 END) // 1000 AS ms
  FROM events, UNNEST(RANGE(0, event_id % 5 + 1)) AS r(i) WHERE event_type = 'click'
), m AS (SELECT site_id, user_id, session_id, path, selector, ms, COUNT(*) AS k FROM c GROUP BY ALL),
q AS (SELECT *, SUM(k) OVER (PARTITION BY user_id, selector ORDER BY ms RANGE BETWEEN 999 PRECEDING AND CURRENT ROW) AS cnt FROM m),
z AS (SELECT * FROM q WHERE cnt >= 3),
f AS (
  SELECT user_id, selector, MIN(ms) AS ms FROM z GROUP BY 1, 2
  UNION ALL
  SELECT f.user_id, f.selector, MIN(z.ms) FROM f JOIN z ON z.user_id = f.user_id AND z.selector = f.selector AND z.ms >= f.ms + 5000 GROUP BY f.user_id, f.selector, f.ms
)
SELECT z.site_id, z.user_id, z.session_id, z.path, z.selector, CAST(MAKE_TIMESTAMP(z.ms * 1000) AS VARCHAR) AS timestamp, CAST(GREATEST(3, cnt - k + 1) AS BIGINT) AS count
FROM f JOIN z ON z.user_id = f.user_id AND z.selector = f.selector AND z.ms = f.ms
-- name: A50_detect_rage_clicks
WITH RECURSIVE c AS (
  SELECT CASE WHEN user_id % 10 < 7 THEN 'site_a' WHEN user_id % 10 < 9 THEN 'site_b' ELSE 'site_c' END AS site_id, 'u_' || CAST(user_id AS VARCHAR) AS user_id,
    's_' || CAST(user_id AS VARCHAR) AS session_id, '/' AS path, 'a.r' || CAST(event_id % 2 AS VARCHAR) AS selector,
    (EPOCH_US(ts) + i * CASE WHEN event_id % 3 = 0 THEN 300000 ELSE 700000 END) // 1000 AS ms
  FROM events, UNNEST(RANGE(0, event_id % 5 + 1)) AS r(i) WHERE event_type = 'click'
), m AS (SELECT site_id, user_id, session_id, path, selector, ms, COUNT(*) AS k FROM c GROUP BY ALL),
q AS (SELECT *, SUM(k) OVER (PARTITION BY user_id, selector ORDER BY ms RANGE BETWEEN 999 PRECEDING AND CURRENT ROW) AS cnt FROM m),
z AS (SELECT * FROM q WHERE cnt >= 3),
f AS (
  SELECT user_id, selector, MIN(ms) AS ms FROM z GROUP BY 1, 2
  UNION ALL
  SELECT f.user_id, f.selector, MIN(z.ms) FROM f JOIN z ON z.user_id = f.user_id AND z.selector = f.selector AND z.ms >= f.ms + 5000 GROUP BY f.user_id, f.selector, f.ms
)
SELECT z.site_id, z.user_id, z.session_id, z.path, z.selector, CAST(MAKE_TIMESTAMP(z.ms * 1000) AS VARCHAR) AS timestamp, CAST(GREATEST(3, cnt - k + 1) AS BIGINT) AS count
FROM f JOIN z ON z.user_id = f.user_id AND z.selector = f.selector AND z.ms = f.ms
-- name: S04_stream_active_visitors
WITH x AS (
  SELECT site_id, user_id, timestamp, UNNEST([
    {'dimension': 'total', 'label': 'active'}, {'dimension': 'page', 'label': CASE WHEN type = 'pageview' THEN path END},
    {'dimension': 'device', 'label': CASE WHEN COALESCE(device, '') = '' THEN 'Desktop' ELSE device END},
    {'dimension': 'country', 'label': CASE WHEN COALESCE(country, '') = '' THEN 'Unknown' ELSE country END}]) AS c FROM web_events
), m AS (
  SELECT DATE_TRUNC('minute', timestamp) - TO_MINUTES(CAST(i AS INTEGER)) AS window_start, site_id, c.dimension AS dimension, c.label AS label, user_id
  FROM x, UNNEST(RANGE(0, 5)) AS r(i) WHERE c.label IS NOT NULL
)
SELECT CAST(window_start AS VARCHAR) AS window_start, site_id, dimension, label, COUNT(DISTINCT user_id) AS visitors, COUNT(*) AS events
FROM m WHERE window_start + INTERVAL 15 MINUTE <= (SELECT MAX(timestamp) FROM web_events) GROUP BY 1, 2, 3, 4
-- name: S06b_rollup_long_sessions
WITH l AS (SELECT *, user_id || '_' || CAST(CAST(DATE_TRUNC('week', timestamp) AS DATE) AS VARCHAR) AS sid FROM web_events),
s AS (SELECT site_id, sid, user_id, MIN(timestamp) AS a, MAX(timestamp) AS b, COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS views FROM l GROUP BY 1, 2, 3),
e AS (SELECT site_id, CAST(timestamp AS DATE) AS date, COUNT(DISTINCT user_id) AS visitors, COUNT(DISTINCT sid) AS sessions, COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews FROM l GROUP BY 1, 2),
t AS (SELECT site_id, CAST(a AS DATE) AS date, COUNT(CASE WHEN views <= 1 THEN 1 END) AS bounces, AVG(DATE_SUB('second', a, b)) AS avg_duration FROM s GROUP BY 1, 2)
SELECT e.site_id, CAST(e.date AS VARCHAR) AS date, visitors, sessions, pageviews, COALESCE(bounces, 0) AS bounces, COALESCE(avg_duration, 0) AS avg_duration FROM e LEFT JOIN t ON t.site_id = e.site_id AND t.date = e.date
-- name: S10_stored_sessions
WITH l AS (SELECT *, user_id || '_' || CAST(CAST(DATE_TRUNC('week', timestamp) AS DATE) AS VARCHAR) AS sid FROM web_events)
SELECT site_id, sid AS id, user_id, CAST(CAST(MIN(timestamp) AS DATE) AS VARCHAR) AS session_date, CAST(MIN(timestamp) AS VARCHAR) AS started_at, CAST(MAX(timestamp) AS VARCHAR) AS ended_at,
  DATE_SUB('second', MIN(timestamp), MAX(timestamp)) AS duration, COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews, COUNT(CASE WHEN type = 'pageview' THEN 1 END) <= 1 AS is_bounce
FROM l GROUP BY site_id, sid, user_id
-- name: S11_late_events
SELECT CASE WHEN n % 10 = 0 THEN 'late' ELSE 'main' END AS part, site_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, COUNT(*) AS events FROM raw_ev GROUP BY 1, 2, 3
-- name: S12_first_sessions
SELECT site_id, user_id, CAST(MIN(started_at) AS VARCHAR) AS first_at, ARG_MIN(id, started_at) AS session_id FROM web_sessions GROUP BY 1, 2
-- name: S13_live_ingest_packed
SELECT site_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, COUNT(*) AS events, COUNT(DISTINCT id) AS ids FROM web_events GROUP BY 1, 2
