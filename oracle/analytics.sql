-- name: A01_traffic_over_time
SELECT site_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, COUNT(DISTINCT user_id) AS visitors,
  COUNT(DISTINCT session_id) AS sessions, COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews
FROM e30 GROUP BY 1, 2
-- name: A01r_traffic_from_rollup
SELECT site_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, COUNT(DISTINCT user_id) AS visitors,
  COUNT(DISTINCT session_id) AS sessions, COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews
FROM web_events WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-21' GROUP BY 1, 2
-- name: A02_bounce_rate_trend
SELECT site_id, CAST(CAST(started_at AS DATE) AS VARCHAR) AS date,
  FLOOR(SUM(CASE WHEN is_bounce THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) * 1000 + 0.5) / 10 AS bounce_rate
FROM s30 GROUP BY 1, 2
-- name: A03_avg_session_trend
SELECT site_id, CAST(CAST(started_at AS DATE) AS VARCHAR) AS date, CAST(FLOOR(AVG(duration) + 0.5) AS BIGINT) AS avg_duration
FROM s30 GROUP BY 1, 2
-- name: A04_pageviews_over_time
SELECT site_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, COUNT(*) AS pageviews
FROM e30 WHERE type = 'pageview' GROUP BY 1, 2
-- name: A05_top_pages
WITH p AS (
  SELECT site_id, path, COUNT(*) AS views, COUNT(DISTINCT user_id) AS unique_visitors FROM e30 WHERE type = 'pageview' GROUP BY 1, 2
), r AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY views DESC, path) AS rn, SUM(views) OVER (PARTITION BY site_id) AS total FROM p
)
SELECT site_id, path, views, unique_visitors, FLOOR(views / CAST(total AS DOUBLE) * 1000 + 0.5) / 10 AS share FROM r WHERE rn <= 5
-- name: A06_page_traffic_trend
SELECT site_id, path, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, COUNT(*) AS views, COUNT(DISTINCT user_id) AS visitors
FROM e30 WHERE type = 'pageview' GROUP BY 1, 2, 3
-- name: A07_page_search_terms
WITH t AS (
  SELECT site_id, path, utm_term AS keyword, COUNT(DISTINCT user_id) AS visitors FROM e30 WHERE utm_term <> '' GROUP BY 1, 2, 3
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY visitors DESC, keyword) AS rn FROM t)
SELECT site_id, path, keyword, visitors FROM r WHERE rn <= 5
-- name: A08_page_wow
WITH p AS (
  SELECT site_id, path,
    COUNT(*) FILTER (WHERE timestamp > TIMESTAMP '2024-01-24') AS current_views,
    COUNT(*) FILTER (WHERE timestamp <= TIMESTAMP '2024-01-24' AND timestamp > TIMESTAMP '2024-01-17') AS previous_views
  FROM e30 WHERE type = 'pageview' GROUP BY 1, 2
), r AS (
  SELECT *, current_views - previous_views AS change_abs,
    ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY ABS(current_views - previous_views) DESC, path) AS rn
  FROM p WHERE current_views > 0 OR previous_views > 0
)
SELECT site_id, path, current_views, previous_views, change_abs,
  CASE WHEN previous_views = 0 THEN CASE WHEN current_views > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END
    ELSE FLOOR(CAST(change_abs AS DOUBLE) / previous_views * 100 * 10 + 0.5) / 10 END AS change_pct,
  CASE WHEN change_abs < 0 THEN 'drop' WHEN change_abs > 0 THEN 'spike' ELSE 'flat' END AS direction
FROM r WHERE rn <= 20
-- name: A09_traffic_sources
WITH c AS (
  SELECT site_id, user_id, CASE WHEN referrer IS NULL OR referrer = '' THEN 'Direct'
    WHEN referrer ILIKE '%google%' OR referrer ILIKE '%bing%' OR referrer ILIKE '%yahoo%' OR referrer ILIKE '%duckduckgo%'
      OR referrer ILIKE '%baidu%' OR referrer ILIKE '%yandex%' THEN 'Search'
    WHEN referrer ILIKE '%facebook%' OR referrer ILIKE '%twitter%' OR referrer ILIKE '%linkedin%' OR referrer ILIKE '%instagram%'
      OR referrer ILIKE '%youtube%' OR referrer ILIKE '%reddit%' OR referrer ILIKE '%pinterest%' OR referrer ILIKE '%tiktok%' THEN 'Social'
    WHEN referrer ILIKE '%mail%' OR referrer ILIKE '%outlook%' THEN 'Email' ELSE 'Referral' END AS source
  FROM e30
), g AS (SELECT site_id, source, COUNT(DISTINCT user_id) AS visitors FROM c GROUP BY 1, 2)
SELECT site_id, source, visitors,
  CAST(FLOOR(visitors / CAST(SUM(visitors) OVER (PARTITION BY site_id) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage FROM g
-- name: A10_devices
WITH c AS (SELECT site_id, user_id, COALESCE(NULLIF(device, ''), 'Desktop') AS device FROM e30),
g AS (SELECT site_id, device, COUNT(DISTINCT user_id) AS visitors FROM c GROUP BY 1, 2)
SELECT site_id, device, visitors,
  CAST(FLOOR(visitors / CAST(SUM(visitors) OVER (PARTITION BY site_id) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage FROM g
-- name: A10b_browsers
WITH c AS (SELECT site_id, user_id, COALESCE(NULLIF(browser, ''), 'Unknown') AS browser FROM e30),
g AS (SELECT site_id, browser, COUNT(DISTINCT user_id) AS visitors FROM c GROUP BY 1, 2)
SELECT site_id, browser, visitors,
  CAST(FLOOR(visitors / CAST(SUM(visitors) OVER (PARTITION BY site_id) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage FROM g
-- name: A10c_operating_systems
WITH c AS (SELECT site_id, user_id, COALESCE(NULLIF(os, ''), 'Unknown') AS os FROM e30),
g AS (SELECT site_id, os, COUNT(DISTINCT user_id) AS visitors FROM c GROUP BY 1, 2)
SELECT site_id, os, visitors,
  CAST(FLOOR(visitors / CAST(SUM(visitors) OVER (PARTITION BY site_id) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage FROM g
-- name: A11_countries
WITH c AS (
  SELECT site_id, user_id, CASE COALESCE(NULLIF(country, ''), 'Unknown') WHEN 'US' THEN 'United States' WHEN 'IN' THEN 'India'
    ELSE COALESCE(NULLIF(country, ''), 'Unknown') END AS country FROM e30
), g AS (SELECT site_id, country, COUNT(DISTINCT user_id) AS visitors FROM c GROUP BY 1, 2),
r AS (SELECT *, SUM(visitors) OVER (PARTITION BY site_id) AS total, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY visitors DESC, country) AS rn FROM g)
SELECT site_id, country, CASE country WHEN 'United States' THEN 'US' WHEN 'India' THEN 'IN' WHEN 'Germany' THEN 'DE' ELSE 'OTHER' END AS code,
  visitors, CAST(FLOOR(visitors / CAST(total AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage FROM r WHERE rn <= 10
-- name: A11b_countries_additive
WITH v AS (SELECT site_id, COALESCE(NULLIF(country, ''), 'Unknown') AS raw, COUNT(DISTINCT user_id) AS visitors FROM
    (SELECT site_id, user_id, COALESCE(NULLIF(country, ''), 'Unknown') AS country FROM e30) GROUP BY 1, 2),
g AS (
  SELECT site_id, CASE raw WHEN 'US' THEN 'United States' WHEN 'IN' THEN 'India' ELSE raw END AS country, CAST(SUM(visitors) AS BIGINT) AS visitors
  FROM v GROUP BY 1, 2
),
r AS (SELECT *, SUM(visitors) OVER (PARTITION BY site_id) AS total, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY visitors DESC, country) AS rn FROM g)
SELECT site_id, country, CASE country WHEN 'United States' THEN 'US' WHEN 'India' THEN 'IN' WHEN 'Germany' THEN 'DE' ELSE 'OTHER' END AS code,
  visitors, CAST(FLOOR(visitors / CAST(total AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage FROM r WHERE rn <= 10
-- name: A12_cities
WITH c AS (SELECT *, COALESCE(NULLIF(city, ''), 'Unknown') AS ci, COALESCE(NULLIF(country, ''), 'Unknown') AS co FROM e30),
g AS (
  SELECT site_id, ci, co, COUNT(DISTINCT user_id) AS visitors, COUNT(DISTINCT session_id) AS sessions,
    COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews, COUNT(*) AS n FROM c GROUP BY 1, 2, 3
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY visitors DESC, ci, co) AS rn FROM g)
SELECT site_id, ci AS city, co AS country, visitors, sessions, pageviews,
  FLOOR(pageviews / CAST(n AS DOUBLE) * 1000 + 0.5) / 10 AS engagement_rate,
  CAST(FLOOR(visitors / CAST(SUM(visitors) OVER (PARTITION BY site_id) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage
FROM r WHERE rn <= 10
-- name: A12b_geo_map
SELECT site_id, city, country, COUNT(DISTINCT user_id) AS visitors, COUNT(DISTINCT session_id) AS sessions
FROM e30 WHERE city <> '' GROUP BY 1, 2, 3
-- name: A13_sessions_by_city
WITH c AS (SELECT *, COALESCE(NULLIF(city, ''), 'Unknown') AS ci, COALESCE(NULLIF(country, ''), 'Unknown') AS co FROM s30),
g AS (
  SELECT site_id, ci AS city, co AS country, COUNT(*) AS sessions, CAST(FLOOR(AVG(duration) + 0.5) AS BIGINT) AS avg_duration,
    FLOOR(SUM(CASE WHEN is_bounce THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE) * 1000 + 0.5) / 10 AS bounce_rate,
    FLOOR(CAST(SUM(pageviews) AS DOUBLE) / COUNT(*) * 10 + 0.5) / 10 AS avg_pageviews
  FROM c GROUP BY 1, 2, 3
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY sessions DESC, city, country) AS rn FROM g)
SELECT site_id, city, country, sessions, avg_duration, bounce_rate, avg_pageviews FROM r WHERE rn <= 10
-- name: A14_session_duration_buckets
WITH b AS (
  SELECT site_id, CASE WHEN duration < 10 THEN 1 WHEN duration < 30 THEN 2 WHEN duration < 60 THEN 3 WHEN duration < 180 THEN 4
    WHEN duration < 600 THEN 5 ELSE 6 END AS bucket_order FROM s30
), g AS (SELECT site_id, bucket_order, COUNT(*) AS sessions FROM b GROUP BY 1, 2)
SELECT site_id, bucket_order, CASE bucket_order WHEN 1 THEN '0-10s' WHEN 2 THEN '10-30s' WHEN 3 THEN '30s-1m' WHEN 4 THEN '1-3m'
    WHEN 5 THEN '3-10m' ELSE '10m+' END AS bucket, sessions,
  CAST(FLOOR(sessions / CAST(SUM(sessions) OVER (PARTITION BY site_id) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage FROM g
-- name: A14b_session_buckets_short_label
WITH b AS (
  SELECT site_id, CASE WHEN duration < 10 THEN 1 WHEN duration < 30 THEN 2 WHEN duration < 60 THEN 3 WHEN duration < 180 THEN 4
    WHEN duration < 600 THEN 5 ELSE 6 END AS bucket_order FROM s30
), g AS (SELECT site_id, bucket_order, COUNT(*) AS sessions FROM b GROUP BY 1, 2)
SELECT site_id, bucket_order, CASE bucket_order WHEN 1 THEN '0-10s' WHEN 2 THEN '10-30s' WHEN 3 THEN '30-60s' WHEN 4 THEN '1-3m'
    WHEN 5 THEN '3-10m' ELSE '10m+' END AS bucket, sessions,
  CAST(FLOOR(sessions / CAST(SUM(sessions) OVER (PARTITION BY site_id) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage FROM g
-- name: A15_kpi_summary
WITH ev AS (
  SELECT site_id, COUNT(DISTINCT CASE WHEN timestamp >= TIMESTAMP '2024-01-24' THEN user_id END) AS v1,
    COUNT(DISTINCT CASE WHEN timestamp < TIMESTAMP '2024-01-24' THEN user_id END) AS v0,
    COUNT(CASE WHEN timestamp >= TIMESTAMP '2024-01-24' AND type = 'pageview' THEN 1 END) AS p1,
    COUNT(CASE WHEN timestamp < TIMESTAMP '2024-01-24' AND type = 'pageview' THEN 1 END) AS p0
  FROM web_events WHERE timestamp >= TIMESTAMP '2024-01-17' AND timestamp <= TIMESTAMP '2024-01-31' GROUP BY 1
), se AS (
  SELECT site_id, COUNT(CASE WHEN started_at >= TIMESTAMP '2024-01-24' THEN 1 END) AS s1,
    COUNT(CASE WHEN started_at < TIMESTAMP '2024-01-24' THEN 1 END) AS s0,
    COUNT(CASE WHEN started_at >= TIMESTAMP '2024-01-24' AND is_bounce THEN 1 END) AS b1,
    COUNT(CASE WHEN started_at < TIMESTAMP '2024-01-24' AND is_bounce THEN 1 END) AS b0,
    AVG(CASE WHEN started_at >= TIMESTAMP '2024-01-24' THEN duration END) AS d1,
    AVG(CASE WHEN started_at < TIMESTAMP '2024-01-24' THEN duration END) AS d0
  FROM web_sessions WHERE started_at >= TIMESTAMP '2024-01-17' AND started_at <= TIMESTAMP '2024-01-31' GROUP BY 1
), j AS (
  SELECT ev.*, s1, s0, COALESCE(d1, 0) AS d1, COALESCE(d0, 0) AS d0,
    CASE WHEN s1 > 0 THEN b1 / CAST(s1 AS DOUBLE) * 100 ELSE 0.0 END AS r1,
    CASE WHEN s0 > 0 THEN b0 / CAST(s0 AS DOUBLE) * 100 ELSE 0.0 END AS r0
  FROM ev JOIN se USING (site_id)
)
SELECT site_id, v1 AS total_visitors, p1 AS total_pageviews, s1 AS total_sessions, FLOOR(r1 * 10 + 0.5) / 10 AS bounce_rate,
  CAST(CAST(FLOOR(d1 / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(FLOOR(d1 - 60 * FLOOR(d1 / 60) + 0.5) AS BIGINT) AS VARCHAR) || 's' AS avg_session_duration,
  PRINTF('%.2f', p1 / CAST(s1 AS DOUBLE)) AS pages_per_session,
  CASE WHEN v0 = 0 THEN CASE WHEN v1 > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE FLOOR((v1 - v0) / CAST(v0 AS DOUBLE) * 1000 + 0.5) / 10 END AS visitors_trend,
  CASE WHEN p0 = 0 THEN CASE WHEN p1 > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE FLOOR((p1 - p0) / CAST(p0 AS DOUBLE) * 1000 + 0.5) / 10 END AS pageviews_trend,
  CASE WHEN r0 = 0 THEN CASE WHEN r1 > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE FLOOR((r1 - r0) / r0 * 1000 + 0.5) / 10 END AS bounce_rate_trend,
  CASE WHEN d0 = 0 THEN CASE WHEN d1 > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE FLOOR((d1 - d0) / d0 * 1000 + 0.5) / 10 END AS session_trend
FROM j
-- name: A15r_kpi_from_rollup
WITH d AS (
  SELECT site_id, CAST(timestamp AS DATE) AS date, COUNT(DISTINCT user_id) AS v, COUNT(DISTINCT session_id) AS s,
    COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS p FROM web_events GROUP BY 1, 2
), b AS (SELECT site_id, CAST(started_at AS DATE) AS date, COUNT(CASE WHEN is_bounce THEN 1 END) AS b, AVG(duration) AS a FROM web_sessions GROUP BY 1, 2),
x AS (
  SELECT d.site_id, date >= DATE '2024-01-11' AS cur, v, s, p, COALESCE(b, 0) AS b, COALESCE(a, 0) * s AS q
  FROM d LEFT JOIN b USING (site_id, date) WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20'
), t AS (
  SELECT site_id, CAST(COALESCE(SUM(CASE WHEN cur THEN v END), 0) AS BIGINT) AS v1, CAST(COALESCE(SUM(CASE WHEN cur THEN p END), 0) AS BIGINT) AS p1, CAST(COALESCE(SUM(CASE WHEN cur THEN s END), 0) AS BIGINT) AS s1,
    COALESCE(SUM(CASE WHEN cur THEN b END), 0) AS b1, COALESCE(SUM(CASE WHEN cur THEN q END), 0) AS q1,
    CAST(COALESCE(SUM(CASE WHEN NOT cur THEN v END), 0) AS BIGINT) AS v0, CAST(COALESCE(SUM(CASE WHEN NOT cur THEN p END), 0) AS BIGINT) AS p0, CAST(COALESCE(SUM(CASE WHEN NOT cur THEN s END), 0) AS BIGINT) AS s0,
    COALESCE(SUM(CASE WHEN NOT cur THEN b END), 0) AS b0, COALESCE(SUM(CASE WHEN NOT cur THEN q END), 0) AS q0
  FROM x GROUP BY 1
), u AS (
  SELECT *, COALESCE(CAST(b1 AS DOUBLE) / NULLIF(s1, 0), 0) * 100 AS r1, COALESCE(CAST(b0 AS DOUBLE) / NULLIF(s0, 0), 0) * 100 AS r0,
    COALESCE(CAST(q1 AS DOUBLE) / NULLIF(s1, 0), 0) AS d1, COALESCE(CAST(q0 AS DOUBLE) / NULLIF(s0, 0), 0) AS d0 FROM t WHERE v1 > 0
)
SELECT site_id, v1 AS total_visitors, p1 AS total_pageviews, s1 AS total_sessions, FLOOR(b1 / CAST(s1 AS DOUBLE) * 1000 + 0.5) / 10 AS bounce_rate,
  CASE WHEN v0 = 0 THEN 100.0::DOUBLE ELSE FLOOR((v1 - v0) / CAST(v0 AS DOUBLE) * 1000 + 0.5) / 10 END AS visitors_trend,
  CASE WHEN p0 = 0 THEN CASE WHEN p1 > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE FLOOR((p1 - p0) / CAST(p0 AS DOUBLE) * 1000 + 0.5) / 10 END AS pageviews_trend,
  CAST(CAST(FLOOR(d1 / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(FLOOR(d1 - 60 * FLOOR(d1 / 60) + 0.5) AS BIGINT) AS VARCHAR) || 's' AS avg_session_duration,
  PRINTF('%.2f', p1 / CAST(s1 AS DOUBLE)) AS pages_per_session,
  CASE WHEN r0 = 0 THEN CASE WHEN r1 > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE FLOOR((r1 - r0) / r0 * 1000 + 0.5) / 10 END AS bounce_rate_trend,
  CASE WHEN d0 = 0 THEN CASE WHEN d1 > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE FLOOR((d1 - d0) / d0 * 1000 + 0.5) / 10 END AS session_trend
FROM u
-- name: A16_funnel_event_types
SELECT site_id, type, COUNT(*) AS count FROM e30 WHERE type <> '' GROUP BY 1, 2
-- name: A16b_funnel_paths
WITH g AS (SELECT site_id, path, COUNT(*) AS count FROM e30 WHERE type = 'pageview' AND path <> '' GROUP BY 1, 2),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY count DESC, path) AS rn FROM g)
SELECT site_id, path, count FROM r WHERE rn <= 30
-- name: A17_funnel
WITH st(step_no, step, kind, p) AS (VALUES (0, 'Visit Homepage', 'pageview', '/'), (1, 'View Product', 'pageview', '/products'),
  (2, 'Add to Cart', 'add_to_cart', NULL), (3, 'Checkout', 'checkout', NULL), (4, 'Purchase', 'purchase', NULL)),
t AS (SELECT site_id, COUNT(DISTINCT user_id) AS n FROM e30 GROUP BY 1),
h AS (
  SELECT t.site_id, t.n, st.step_no, st.step, COUNT(DISTINCT e30.user_id) AS visitors
  FROM t CROSS JOIN st LEFT JOIN e30 ON e30.site_id = t.site_id AND e30.type = st.kind AND (st.p IS NULL OR e30.path = st.p)
  GROUP BY 1, 2, 3, 4
), l AS (SELECT *, LAG(visitors) OVER (PARTITION BY site_id ORDER BY step_no) AS b FROM h)
SELECT site_id, step_no, step, visitors, FLOOR(visitors / CAST(n AS DOUBLE) * 1000 + 0.5) / 10 AS percentage,
  GREATEST(CASE WHEN b > 0 THEN FLOOR((b - visitors) / CAST(b AS DOUBLE) * 1000 + 0.5) / 10 ELSE 0.0::DOUBLE END, 0.0::DOUBLE) AS drop_off
FROM l
-- name: A17o_funnel_ordered
WITH t AS (SELECT site_id, COUNT(DISTINCT user_id) AS n FROM e30 GROUP BY 1),
a0 AS (SELECT site_id, user_id, MIN(timestamp) AS m FROM e30 WHERE type = 'pageview' AND path = '/' GROUP BY 1, 2),
a1 AS (SELECT e.site_id, e.user_id, MIN(e.timestamp) AS m FROM e30 e JOIN a0 USING (site_id, user_id) WHERE e.timestamp > a0.m AND type = 'pageview' AND path = '/products' GROUP BY 1, 2),
a2 AS (SELECT e.site_id, e.user_id, MIN(e.timestamp) AS m FROM e30 e JOIN a1 USING (site_id, user_id) WHERE e.timestamp > a1.m AND type = 'add_to_cart' GROUP BY 1, 2),
a3 AS (SELECT e.site_id, e.user_id, MIN(e.timestamp) AS m FROM e30 e JOIN a2 USING (site_id, user_id) WHERE e.timestamp > a2.m AND type = 'checkout' GROUP BY 1, 2),
a4 AS (SELECT e.site_id, e.user_id, MIN(e.timestamp) AS m FROM e30 e JOIN a3 USING (site_id, user_id) WHERE e.timestamp > a3.m AND type = 'purchase' GROUP BY 1, 2),
x AS (SELECT 0 AS step_no, site_id FROM a0 UNION ALL SELECT 1, site_id FROM a1 UNION ALL SELECT 2, site_id FROM a2 UNION ALL SELECT 3, site_id FROM a3 UNION ALL SELECT 4, site_id FROM a4),
st(step_no, step) AS (VALUES (0, 'Visit Homepage'), (1, 'View Product'), (2, 'Add to Cart'), (3, 'Checkout'), (4, 'Purchase')),
h AS (SELECT t.site_id, t.n, st.step_no, st.step, COUNT(x.step_no) AS visitors FROM t CROSS JOIN st LEFT JOIN x ON x.site_id = t.site_id AND x.step_no = st.step_no GROUP BY 1, 2, 3, 4),
l AS (SELECT *, LAG(visitors) OVER (PARTITION BY site_id ORDER BY step_no) AS b FROM h)
SELECT site_id, step_no, step, visitors, FLOOR(visitors / CAST(n AS DOUBLE) * 1000 + 0.5) / 10 AS percentage,
  GREATEST(CASE WHEN b > 0 THEN FLOOR((b - visitors) / CAST(b AS DOUBLE) * 1000 + 0.5) / 10 ELSE 0.0::DOUBLE END, 0.0::DOUBLE) AS drop_off
FROM l
-- name: A18_realtime_summary
WITH w AS (SELECT * FROM web_events WHERE timestamp >= TIMESTAMP '2024-01-20 11:00:00' AND timestamp <= TIMESTAMP '2024-01-20 12:00:00'),
x AS (
  SELECT site_id, user_id, 'total' AS dimension, 'active' AS label FROM w UNION ALL
  SELECT site_id, user_id, 'page', path FROM w WHERE type = 'pageview' UNION ALL
  SELECT site_id, user_id, 'device', COALESCE(NULLIF(device, ''), 'Desktop') FROM w UNION ALL
  SELECT site_id, user_id, 'country', COALESCE(NULLIF(country, ''), 'Unknown') FROM w
), g AS (SELECT site_id, dimension, label, COUNT(DISTINCT user_id) AS visitors FROM x GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, dimension ORDER BY visitors DESC, label) AS rn FROM g)
SELECT site_id, dimension, label, visitors FROM r WHERE rn <= 10 OR dimension IN ('total', 'device')
-- name: A19_event_stream_tail
WITH r AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY timestamp DESC, id DESC) AS rn FROM web_events
  WHERE timestamp >= TIMESTAMP '2024-01-20 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 12:00:00'
)
SELECT site_id, id, type, path, url, user_id, session_id, CAST(timestamp AS VARCHAR) AS timestamp, COALESCE(NULLIF(device, ''), 'Desktop') AS device,
  COALESCE(NULLIF(browser, ''), 'Unknown') AS browser, COALESCE(NULLIF(os, ''), 'Unknown') AS os, COALESCE(NULLIF(country, ''), 'Unknown') AS country,
  NULLIF(referrer, '') AS referrer, NULLIF(city, '') AS city, NULLIF(utm_source, '') AS utm_source, NULLIF(utm_medium, '') AS utm_medium, NULLIF(utm_campaign, '') AS utm_campaign
FROM r WHERE rn <= 50
-- name: A20_utm_campaigns
WITH g AS (
  SELECT site_id, COALESCE(NULLIF(utm_source, ''), '(none)') AS source, COALESCE(NULLIF(utm_medium, ''), '(none)') AS medium,
    COALESCE(NULLIF(utm_campaign, ''), '(none)') AS campaign, COUNT(DISTINCT user_id) AS visitors, COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews
  FROM e30 WHERE utm_source <> '' OR utm_medium <> '' OR utm_campaign <> '' GROUP BY 1, 2, 3, 4
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY visitors DESC, source, medium, campaign) AS rn FROM g)
SELECT site_id, source, medium, campaign, visitors, pageviews,
  CAST(FLOOR(visitors / CAST(SUM(visitors) OVER (PARTITION BY site_id) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage FROM r WHERE rn <= 20
-- name: A21_comparison
WITH c AS (
  SELECT site_id, CAST(timestamp AS DATE) AS date, COUNT(DISTINCT user_id) AS visitors, COUNT(DISTINCT session_id) AS sessions,
    COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY CAST(timestamp AS DATE)) AS n
  FROM web_events WHERE timestamp >= TIMESTAMP '2024-01-24' AND timestamp <= TIMESTAMP '2024-01-31' GROUP BY 1, 2
), p AS (
  SELECT site_id, CAST(timestamp AS DATE) AS date, COUNT(DISTINCT user_id) AS visitors, COUNT(DISTINCT session_id) AS sessions,
    COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY CAST(timestamp AS DATE)) AS n
  FROM web_events WHERE timestamp >= TIMESTAMP '2024-01-17' AND timestamp < TIMESTAMP '2024-01-24' GROUP BY 1, 2
)
SELECT c.site_id, CAST(c.date AS VARCHAR) AS date, c.visitors, c.sessions, c.pageviews, CAST(p.date AS VARCHAR) AS prev_date,
  COALESCE(p.visitors, 0) AS prev_visitors, COALESCE(p.sessions, 0) AS prev_sessions, COALESCE(p.pageviews, 0) AS prev_pageviews
FROM c LEFT JOIN p ON p.site_id = c.site_id AND p.n = c.n
-- name: A22_user_flow
WITH o AS (
  SELECT site_id, path AS from_page, LEAD(path) OVER (PARTITION BY site_id, session_id ORDER BY timestamp, id) AS to_page FROM e30 WHERE type = 'pageview'
), g AS (SELECT site_id, from_page, to_page, COUNT(*) AS transitions FROM o WHERE to_page IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY transitions DESC, from_page, to_page) AS rn FROM g)
SELECT site_id, from_page, to_page, transitions FROM r WHERE rn <= 20
-- name: A22b_flow_ends
WITH x AS (SELECT site_id, 'entry' AS side, entry_page AS page FROM s30 UNION ALL SELECT site_id, 'exit', exit_page FROM s30),
g AS (SELECT site_id, side, page, COUNT(*) AS count FROM x WHERE page IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, side ORDER BY count DESC, page) AS rn FROM g)
SELECT site_id, side, page, count FROM r WHERE rn <= 10
-- name: A23_traffic_alerts
WITH d AS (SELECT site_id, CAST(timestamp AS DATE) AS date, COUNT(DISTINCT user_id) AS v FROM e30 GROUP BY 1, 2),
w AS (
  SELECT *, AVG(v) OVER t AS m, STDDEV_POP(v) OVER t AS sd, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY date) AS n FROM d
  WINDOW t AS (PARTITION BY site_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
), k AS (SELECT *, CASE WHEN v > m + 2 * sd THEN 'spike' WHEN v < m - 2 * sd THEN 'drop' END AS type FROM w WHERE n > 3 AND sd > 0)
SELECT site_id, CAST(date AS VARCHAR) AS date, type, CASE type WHEN 'spike' THEN 'warning' ELSE 'error' END AS severity,
  'Traffic ' || type || ': ' || CAST(v AS VARCHAR) || ' visitors (avg: ' || CAST(CAST(FLOOR(m + 0.5) AS BIGINT) AS VARCHAR) || ')' AS message,
  v AS value, CAST(FLOOR(m + 0.5) AS BIGINT) AS average, CAST(FLOOR((v - m) / m * 100 + 0.5) AS BIGINT) AS change
FROM k WHERE type IS NOT NULL
-- name: A24_error_alerts
WITH d AS (SELECT site_id, CAST(timestamp AS DATE) AS date, COUNT(*) AS v FROM e30 WHERE type = 'js_error' GROUP BY 1, 2),
w AS (
  SELECT *, AVG(v) OVER t AS m, STDDEV_POP(v) OVER t AS sd, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY date) AS n FROM d
  WINDOW t AS (PARTITION BY site_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
)
SELECT site_id, CAST(date AS VARCHAR) AS date, 'error_spike' AS type, 'error' AS severity,
  'Error spike: ' || CAST(v AS VARCHAR) || ' events (avg: ' || CAST(CAST(FLOOR(m + 0.5) AS BIGINT) AS VARCHAR) || ')' AS message,
  v AS value, CAST(FLOOR(m + 0.5) AS BIGINT) AS average, CAST(FLOOR((v - m) / m * 100 + 0.5) AS BIGINT) AS change
FROM w WHERE n > 3 AND sd > 0 AND m > 0 AND v > m + 2 * sd
-- name: A25_daily_active_users
SELECT site_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, COUNT(DISTINCT user_id) AS unique_users FROM e30 GROUP BY 1, 2
-- name: A26_hourly_pattern
SELECT site_id, CAST(EXTRACT(HOUR FROM timestamp) AS INTEGER) AS hour, COUNT(DISTINCT user_id) AS visitors, COUNT(*) AS pageviews
FROM web_events WHERE type = 'pageview' AND timestamp >= TIMESTAMP '2024-01-24' AND timestamp <= TIMESTAMP '2024-01-31' GROUP BY 1, 2
-- name: A27_bounce_by_entry_page
WITH g AS (
  SELECT site_id, entry_page AS page, COUNT(*) AS total_sessions, COUNT(CASE WHEN is_bounce THEN 1 END) AS bounced_sessions
  FROM s30 WHERE entry_page IS NOT NULL GROUP BY 1, 2
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY total_sessions DESC, page) AS rn FROM g)
SELECT site_id, page, total_sessions, bounced_sessions, FLOOR(bounced_sessions / CAST(total_sessions AS DOUBLE) * 1000 + 0.5) / 10 AS bounce_rate FROM r WHERE rn <= 10
-- name: A28_retention_daily
WITH f AS (
  SELECT site_id, user_id, CAST(MIN(timestamp) AS DATE) AS cohort_date FROM web_events
  WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20' GROUP BY 1, 2
), z AS (SELECT site_id, cohort_date, COUNT(*) AS cohort_size FROM f GROUP BY 1, 2),
a AS (SELECT e.site_id, f.cohort_date, CAST(e.timestamp AS DATE) - f.cohort_date AS day_offset, e.user_id FROM web_events e JOIN f USING (site_id, user_id)),
g AS (SELECT site_id, cohort_date, day_offset, COUNT(DISTINCT user_id) AS u FROM a WHERE day_offset BETWEEN 0 AND 7 GROUP BY 1, 2, 3)
SELECT g.site_id, CAST(g.cohort_date AS VARCHAR) AS cohort_date, CAST(day_offset AS INTEGER) AS day_offset, u AS returning_users, cohort_size,
  FLOOR(u / CAST(cohort_size AS DOUBLE) * 1000 + 0.5) / 10 AS retention_pct
FROM g JOIN z USING (site_id, cohort_date)
-- name: A29_cohorts
WITH f AS (SELECT site_id, user_id, CAST(MIN(timestamp) AS DATE) AS cohort_date FROM e30 GROUP BY 1, 2),
z AS (SELECT site_id, cohort_date, COUNT(*) AS cohort_size FROM f GROUP BY 1, 2),
a AS (SELECT e.site_id, f.cohort_date, CAST(e.timestamp AS DATE) - f.cohort_date AS day_offset, e.user_id FROM e30 e JOIN f USING (site_id, user_id)),
g AS (SELECT site_id, cohort_date, day_offset, COUNT(DISTINCT user_id) AS users FROM a WHERE day_offset IN (0, 1, 3, 7, 14, 30) GROUP BY 1, 2, 3)
SELECT g.site_id, CAST(g.cohort_date AS VARCHAR) AS cohort_date, CAST(day_offset AS INTEGER) AS day_offset, users, cohort_size,
  FLOOR(users / CAST(cohort_size AS DOUBLE) * 1000 + 0.5) / 10 AS rate
FROM g JOIN z USING (site_id, cohort_date)
-- name: A29b_cohort_matrix
WITH f AS (SELECT site_id, user_id, CAST(MIN(timestamp) AS DATE) AS cohort_date FROM e30 GROUP BY 1, 2),
z AS (SELECT site_id, cohort_date, COUNT(*) AS cohort_size FROM f GROUP BY 1, 2),
a AS (SELECT DISTINCT e.site_id, f.cohort_date, CAST(e.timestamp AS DATE) - f.cohort_date AS d, e.user_id FROM e30 e JOIN f USING (site_id, user_id)),
g AS (SELECT site_id, cohort_date, d, FLOOR(COUNT(*) / CAST(MAX(cohort_size) AS DOUBLE) * 1000 + 0.5) / 10 AS rate FROM a JOIN z USING (site_id, cohort_date) GROUP BY 1, 2, 3)
SELECT g.site_id, CAST(g.cohort_date AS VARCHAR) AS cohort_date, MAX(cohort_size) AS cohort_size,
  MAX(CASE WHEN d = 0 THEN rate END) AS day0, MAX(CASE WHEN d = 1 THEN rate END) AS day1, MAX(CASE WHEN d = 3 THEN rate END) AS day3,
  MAX(CASE WHEN d = 7 THEN rate END) AS day7, MAX(CASE WHEN d = 14 THEN rate END) AS day14, MAX(CASE WHEN d = 30 THEN rate END) AS day30
FROM g JOIN z USING (site_id, cohort_date) GROUP BY 1, 2
-- name: A30_goal_conversions
WITH goals(id, site_id, name, type, kind, key) AS (VALUES
  ('g1', 'site_a', 'Pricing', 'page_visit', 'path', '/pricing'), ('g2', 'site_a', 'Bought', 'event', 'type', 'purchase'),
  ('g3', 'site_b', 'Button', 'click', 'selector', 'button.b2'), ('g4', 'site_c', 'Home', 'page_visit', 'path', '/'),
  ('g5', 'site_b', 'Odd', 'other', NULL, NULL), ('g6', 'site_c', 'Custom', 'event', 'type', 'custom')),
x AS (
  SELECT site_id, user_id, 'path' AS kind, path AS key FROM e30 WHERE type = 'pageview' UNION ALL
  SELECT site_id, user_id, 'type', type FROM e30 UNION ALL
  SELECT site_id, user_id, 'selector', json_extract_string(properties, '$.selector') FROM e30 WHERE type IN ('click', 'button_click', 'heatmap_click')
), t AS (SELECT site_id, COUNT(DISTINCT user_id) AS n FROM e30 GROUP BY 1),
h AS (SELECT g.id, COUNT(DISTINCT x.user_id) AS conversions, COUNT(x.user_id) AS total_events
  FROM goals g LEFT JOIN x ON x.site_id = g.site_id AND x.kind = g.kind AND x.key = g.key GROUP BY 1)
SELECT g.site_id, g.id AS goal_id, g.name AS goal_name, g.type, conversions, total_events, FLOOR(conversions / CAST(n AS DOUBLE) * 1000 + 0.5) / 10 AS conversion_rate
FROM goals g JOIN h ON h.id = g.id JOIN t ON t.site_id = g.site_id
-- name: A31_goal_conversions_daily
WITH goals(id, site_id, kind, key) AS (VALUES
  ('g1', 'site_a', 'path', '/pricing'), ('g2', 'site_a', 'type', 'purchase'), ('g3', 'site_b', 'selector', 'button.b2'),
  ('g4', 'site_c', 'path', '/'), ('g5', 'site_b', 'selector', 'button.b1'), ('g6', 'site_c', 'type', 'custom')),
x AS (
  SELECT site_id, user_id, timestamp, 'path' AS kind, path AS key FROM e30 WHERE type = 'pageview' UNION ALL
  SELECT site_id, user_id, timestamp, 'type', type FROM e30 UNION ALL
  SELECT site_id, user_id, timestamp, 'selector', json_extract_string(properties, '$.selector') FROM e30 WHERE type IN ('click', 'button_click', 'heatmap_click')
)
SELECT g.site_id, g.id AS goal_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, COUNT(DISTINCT user_id) AS conversions
FROM goals g JOIN x ON x.site_id = g.site_id AND x.kind = g.kind AND x.key = g.key GROUP BY 1, 2, 3
-- name: A32_ab_test_results
WITH v(site_id, test_id, test_name, status, goal_id, variant_no, path, variant, ge) AS (VALUES
  ('site_a', 't1', 'Landing', 'active', 'g2', 0, '/', 'home', 'purchase'), ('site_a', 't1', 'Landing', 'active', 'g2', 1, '/products', 'products', 'purchase'),
  ('site_a', 't1', 'Landing', 'active', 'g2', 2, '/nowhere', 'ghost', 'purchase'),
  ('site_b', 't2', 'Docs', 'paused', 'g3', 0, '/docs', 'docs', NULL), ('site_b', 't2', 'Docs', 'paused', 'g3', 1, '/blog', 'blog', NULL)),
seen AS (SELECT v.test_id, v.variant_no, e.user_id, COUNT(CASE WHEN e.type = 'pageview' THEN 1 END) AS pv FROM v JOIN e30 e ON e.site_id = v.site_id AND e.path = v.path GROUP BY 1, 2, 3),
won AS (SELECT DISTINCT v.test_id, v.variant_no, e.user_id FROM v JOIN e30 e ON e.site_id = v.site_id AND e.type = v.ge),
m AS (
  SELECT v.*, COUNT(s.user_id) AS visitors, CAST(COALESCE(SUM(s.pv), 0) AS BIGINT) AS pageviews, COUNT(w.user_id) AS conversions
  FROM v LEFT JOIN seen s ON s.test_id = v.test_id AND s.variant_no = v.variant_no
  LEFT JOIN won w ON w.test_id = s.test_id AND w.variant_no = s.variant_no AND w.user_id = s.user_id
  GROUP BY ALL
), r AS (SELECT *, CASE WHEN visitors > 0 THEN FLOOR(conversions / CAST(visitors AS DOUBLE) * 1000 + 0.5) / 10 ELSE 0.0::DOUBLE END AS conversion_rate FROM m),
k AS (
  SELECT r.*, variant_no = 0 AS is_control, FIRST_VALUE(conversions) OVER o AS c0, FIRST_VALUE(visitors) OVER o AS n0, MAX(conversion_rate) OVER (PARTITION BY test_id) AS best
  FROM r WINDOW o AS (PARTITION BY test_id ORDER BY variant_no)
), z1 AS (
  SELECT *, CASE WHEN n0 > 0 AND visitors > 0 AND NOT is_control THEN c0 / CAST(n0 AS DOUBLE) END AS p1,
    CASE WHEN n0 > 0 AND visitors > 0 AND NOT is_control THEN conversions / CAST(visitors AS DOUBLE) END AS p2,
    CASE WHEN n0 > 0 AND visitors > 0 AND NOT is_control THEN (c0 + conversions) / CAST(n0 + visitors AS DOUBLE) END AS pp FROM k
), z2 AS (SELECT *, SQRT(pp * (1 - pp) * (1.0::DOUBLE / n0 + 1.0::DOUBLE / NULLIF(visitors, 0))) AS se FROM z1),
z3 AS (SELECT *, (p2 - p1) / NULLIF(se, 0) AS z, ABS((p2 - p1) / NULLIF(se, 0)) / SQRT(2.0::DOUBLE) AS x FROM z2),
z4 AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * x) AS t FROM z3),
z5 AS (SELECT *, 2 * (1 - 0.5::DOUBLE * (1 + (1 - ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * EXP(-x * x)))) AS p FROM z4),
z6 AS (SELECT *, COALESCE(z IS NOT NULL AND n0 * pp >= 5 AND n0 * (1 - pp) >= 5 AND visitors * pp >= 5 AND visitors * (1 - pp) >= 5, FALSE) AS reliable FROM z5)
SELECT site_id, test_id, test_name, status, goal_id, variant_no, path, variant, visitors, pageviews, conversions, conversion_rate, is_control,
  FLOOR(z * 1000 + 0.5) / 1000 AS z_score, FLOOR(p * 10000 + 0.5) / 10000 AS p_value, FLOOR((1 - p) * 1000 + 0.5) / 10 AS confidence,
  COALESCE(reliable AND p < 0.05, FALSE) AS significant, FLOOR((p2 - p1) / NULLIF(p1, 0) * 1000 + 0.5) / 10 AS uplift, reliable,
  conversion_rate = best AND best > 0 AS is_leader
FROM z6
-- name: A33_ab_significance
WITH u AS (SELECT site_id, user_id, CAST(SUBSTR(user_id, 3) AS BIGINT) % 2 AS arm, MAX(CASE WHEN type = 'purchase' THEN 1 ELSE 0 END) AS hit FROM e30 GROUP BY 1, 2, 3),
m AS (SELECT site_id, CAST(arm AS BIGINT) AS arm, COUNT(*) AS visitors, CAST(SUM(hit) AS BIGINT) AS conversions FROM u GROUP BY 1, 2),
r AS (SELECT *, FLOOR(conversions / CAST(visitors AS DOUBLE) * 1000 + 0.5) / 10 AS conversion_rate FROM m),
k AS (
  SELECT r.*, FIRST_VALUE(arm) OVER o = arm AS is_control, FIRST_VALUE(conversions) OVER o AS c0, FIRST_VALUE(visitors) OVER o AS n0, MAX(conversion_rate) OVER (PARTITION BY site_id) AS best
  FROM r WINDOW o AS (PARTITION BY site_id ORDER BY arm)
), z1 AS (
  SELECT *, CASE WHEN NOT is_control THEN c0 / CAST(n0 AS DOUBLE) END AS p1, CASE WHEN NOT is_control THEN conversions / CAST(visitors AS DOUBLE) END AS p2,
    CASE WHEN NOT is_control THEN (c0 + conversions) / CAST(n0 + visitors AS DOUBLE) END AS pp FROM k
), z2 AS (SELECT *, SQRT(pp * (1 - pp) * (1.0::DOUBLE / n0 + 1.0::DOUBLE / visitors)) AS se FROM z1),
z3 AS (SELECT *, (p2 - p1) / NULLIF(se, 0) AS z, ABS((p2 - p1) / NULLIF(se, 0)) / SQRT(2.0::DOUBLE) AS x FROM z2),
z4 AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * x) AS t FROM z3),
z5 AS (SELECT *, 2 * (1 - 0.5::DOUBLE * (1 + (1 - ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * EXP(-x * x)))) AS p FROM z4),
z6 AS (SELECT *, COALESCE(z IS NOT NULL AND n0 * pp >= 5 AND n0 * (1 - pp) >= 5 AND visitors * pp >= 5 AND visitors * (1 - pp) >= 5, FALSE) AS reliable FROM z5)
SELECT site_id, arm, visitors, conversions, conversion_rate, is_control,
  FLOOR(z * 1000 + 0.5) / 1000 AS z_score, FLOOR(p * 10000 + 0.5) / 10000 AS p_value, FLOOR((1 - p) * 1000 + 0.5) / 10 AS confidence,
  COALESCE(reliable AND p < 0.05, FALSE) AS significant, FLOOR((p2 - p1) / NULLIF(p1, 0) * 1000 + 0.5) / 10 AS uplift, reliable,
  conversion_rate = best AND best > 0 AS is_leader
FROM z6
-- name: A34_new_vs_returning
SELECT site_id, CAST(CAST(started_at AS DATE) AS VARCHAR) AS date, COUNT(CASE WHEN NOT is_returning THEN 1 END) AS new_visitors,
  COUNT(CASE WHEN is_returning THEN 1 END) AS returning_visitors, COUNT(*) AS total_sessions FROM s30 GROUP BY 1, 2
-- name: A34b_new_vs_returning_totals
SELECT site_id, COUNT(CASE WHEN NOT is_returning THEN 1 END) AS new_visitors, COUNT(CASE WHEN is_returning THEN 1 END) AS returning_visitors,
  COUNT(*) AS total_sessions, CAST(FLOOR(COUNT(CASE WHEN NOT is_returning THEN 1 END) / CAST(COUNT(*) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS new_percentage,
  CAST(FLOOR(COUNT(CASE WHEN is_returning THEN 1 END) / CAST(COUNT(*) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS returning_percentage FROM s30 GROUP BY 1
-- name: A35_visitor_segments
WITH w AS (SELECT * FROM e30 WHERE browser = 'Chrome'),
x AS (
  SELECT site_id, user_id, type, 'all' AS dimension, 'all' AS label FROM w UNION ALL
  SELECT site_id, user_id, type, 'device', COALESCE(NULLIF(device, ''), 'Desktop') FROM w UNION ALL
  SELECT site_id, user_id, type, 'country', COALESCE(NULLIF(country, ''), 'Unknown') FROM w UNION ALL
  SELECT site_id, user_id, type, 'browser', COALESCE(NULLIF(browser, ''), 'Unknown') FROM w UNION ALL
  SELECT site_id, user_id, type, 'source', COALESCE(NULLIF(utm_source, ''), 'Direct') FROM w
), g AS (SELECT site_id, dimension, label, COUNT(DISTINCT user_id) AS visitors, COUNT(*) AS events, COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews FROM x GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, dimension ORDER BY visitors DESC, label) AS rn FROM g)
SELECT site_id, dimension, label, visitors, events, pageviews FROM r WHERE rn <= 10 OR dimension NOT IN ('country', 'source')
-- name: A36_revenue_summary
SELECT site_id, COUNT(*) AS total_purchases, COUNT(DISTINCT user_id) AS unique_buyers,
  FLOOR(CAST(SUM(CAST(v AS DECIMAL(28, 6))) AS DOUBLE) * 100 + 0.5) / 100 AS total_revenue,
  FLOOR(CAST(SUM(CAST(v AS DECIMAL(28, 6))) AS DOUBLE) / COUNT(v) * 100 + 0.5) / 100 AS avg_order_value
FROM (SELECT *, CAST(json_extract_string(properties, '$.value') AS DOUBLE) AS v FROM e30 WHERE type = 'purchase') GROUP BY 1
-- name: A36b_revenue_daily
SELECT site_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, COUNT(*) AS purchases,
  FLOOR(CAST(SUM(CAST(v AS DECIMAL(28, 6))) AS DOUBLE) * 100 + 0.5) / 100 AS revenue
FROM (SELECT *, CAST(json_extract_string(properties, '$.value') AS DOUBLE) AS v FROM e30 WHERE type = 'purchase') GROUP BY 1, 2
-- name: A36c_revenue_by_source
SELECT site_id, COALESCE(NULLIF(utm_source, ''), 'Direct') AS source, COUNT(*) AS purchases,
  FLOOR(CAST(SUM(CAST(v AS DECIMAL(28, 6))) AS DOUBLE) * 100 + 0.5) / 100 AS revenue,
  FLOOR(CAST(SUM(CAST(v AS DECIMAL(28, 6))) AS DOUBLE) / COUNT(v) * 100 + 0.5) / 100 AS avg_value
FROM (SELECT *, CAST(json_extract_string(properties, '$.value') AS DOUBLE) AS v FROM e30 WHERE type = 'purchase') GROUP BY 1, 2
-- name: A37_exit_pages
WITH g AS (
  SELECT site_id, exit_page AS page, COUNT(*) AS exits, COUNT(DISTINCT user_id) AS unique_users, CAST(FLOOR(AVG(duration) + 0.5) AS BIGINT) AS avg_session_duration
  FROM s30 WHERE exit_page <> '' GROUP BY 1, 2
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY exits DESC, page) AS rn FROM g)
SELECT site_id, page, exits, unique_users, avg_session_duration,
  FLOOR(exits / CAST(SUM(exits) OVER (PARTITION BY site_id) AS DOUBLE) * 1000 + 0.5) / 10 AS percentage FROM r WHERE rn <= 5
-- name: A38_entry_pages
WITH g AS (
  SELECT site_id, entry_page AS page, COUNT(*) AS entries, COUNT(DISTINCT user_id) AS unique_users,
    FLOOR(COUNT(CASE WHEN is_bounce THEN 1 END) / CAST(COUNT(*) AS DOUBLE) * 1000 + 0.5) / 10 AS bounce_rate,
    CAST(FLOOR(AVG(duration) + 0.5) AS BIGINT) AS avg_session_duration
  FROM s30 WHERE entry_page <> '' GROUP BY 1, 2
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY entries DESC, page) AS rn FROM g)
SELECT site_id, page, entries, unique_users, bounce_rate, avg_session_duration,
  FLOOR(entries / CAST(SUM(entries) OVER (PARTITION BY site_id) AS DOUBLE) * 1000 + 0.5) / 10 AS percentage FROM r WHERE rn <= 5
-- name: A39_site_search_terms
WITH g AS (
  SELECT site_id, json_extract_string(properties, '$.query') AS query, path AS page, COUNT(*) AS searches, COUNT(DISTINCT user_id) AS unique_users
  FROM e30 WHERE type = 'site_search' GROUP BY 1, 2, 3
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY searches DESC, query, page) AS rn FROM g)
SELECT site_id, query, page, searches, unique_users FROM r WHERE rn <= 30
-- name: A40_campaign_dashboard
WITH g AS (
  SELECT site_id, COALESCE(NULLIF(utm_source, ''), '(none)') AS source, COALESCE(NULLIF(utm_medium, ''), '(none)') AS medium,
    COALESCE(NULLIF(utm_campaign, ''), '(none)') AS campaign, COUNT(DISTINCT user_id) AS visitors, COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews,
    COUNT(CASE WHEN type = 'purchase' THEN 1 END) AS purchases,
    FLOOR(COALESCE(CAST(SUM(CASE WHEN type = 'purchase' THEN CAST(CAST(json_extract_string(properties, '$.value') AS DOUBLE) AS DECIMAL(28, 6)) END) AS DOUBLE), 0) * 100 + 0.5) / 100 AS revenue
  FROM e30 WHERE utm_source <> '' OR utm_medium <> '' OR utm_campaign <> '' GROUP BY 1, 2, 3, 4
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY visitors DESC, source, medium, campaign) AS rn FROM g)
SELECT site_id, source, medium, campaign, visitors, pageviews, purchases, revenue,
  CAST(FLOOR(visitors / CAST(SUM(visitors) OVER (PARTITION BY site_id) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage FROM r WHERE rn <= 30
-- name: A41_social_traffic
WITH c AS (
  SELECT *, CASE WHEN referrer ILIKE '%facebook%' OR referrer ILIKE '%fb.com%' THEN 'Facebook'
    WHEN referrer ILIKE '%twitter%' OR referrer ILIKE '%t.co%' OR referrer ILIKE '%x.com%' THEN 'Twitter/X' WHEN referrer ILIKE '%linkedin%' THEN 'LinkedIn'
    WHEN referrer ILIKE '%instagram%' THEN 'Instagram' WHEN referrer ILIKE '%youtube%' THEN 'YouTube' WHEN referrer ILIKE '%reddit%' THEN 'Reddit'
    WHEN referrer ILIKE '%pinterest%' THEN 'Pinterest' WHEN referrer ILIKE '%tiktok%' THEN 'TikTok' WHEN referrer ILIKE '%github%' THEN 'GitHub'
    WHEN referrer ILIKE '%discord%' THEN 'Discord' WHEN referrer ILIKE '%slack%' THEN 'Slack' END AS platform FROM e30
), g AS (
  SELECT site_id, platform, COUNT(DISTINCT user_id) AS visitors, COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews, COUNT(DISTINCT session_id) AS sessions
  FROM c WHERE platform IS NOT NULL GROUP BY 1, 2
)
SELECT site_id, platform, visitors, pageviews, sessions,
  CAST(FLOOR(visitors / CAST(SUM(visitors) OVER (PARTITION BY site_id) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage FROM g
-- name: A41h_social_traffic_by_host
WITH c AS (
  SELECT *, CASE WHEN regexp_matches(referrer, '^https?://(.+\.)?(facebook\.com|fb\.com)(/|$)') THEN 'Facebook'
    WHEN regexp_matches(referrer, '^https?://(.+\.)?(twitter\.com|t\.co|x\.com)(/|$)') THEN 'Twitter/X' END AS platform FROM e30
), g AS (
  SELECT site_id, platform, COUNT(DISTINCT user_id) AS visitors, COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews, COUNT(DISTINCT session_id) AS sessions
  FROM c WHERE platform IS NOT NULL GROUP BY 1, 2
)
SELECT site_id, platform, visitors, pageviews, sessions,
  CAST(FLOOR(visitors / CAST(SUM(visitors) OVER (PARTITION BY site_id) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS percentage FROM g
-- name: A42_search_keywords
WITH g AS (
  SELECT site_id, utm_term AS keyword, COALESCE(NULLIF(utm_source, ''), '(direct)') AS source, COUNT(DISTINCT user_id) AS visitors,
    COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews FROM e30 WHERE utm_term <> '' GROUP BY 1, 2, 3
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY visitors DESC, keyword, source) AS rn FROM g)
SELECT site_id, keyword, source, visitors, pageviews FROM r WHERE rn <= 20
-- name: A43_utm_link_stats
WITH l(id, site_id, s, m, c) AS (VALUES ('l1', 'site_a', 'google', 'cpc', 'launch'), ('l2', 'site_a', 'newsletter', '', ''),
  ('l3', 'site_b', '', 'email', ''), ('l4', 'site_c', '', '', ''), ('l5', 'site_c', 'nobody', '', ''))
SELECT l.id AS link_id, l.site_id, COUNT(DISTINCT e.user_id) AS visitors, COUNT(CASE WHEN e.type = 'pageview' THEN 1 END) AS pageviews,
  CAST(MIN(e.timestamp) AS VARCHAR) AS first_seen, CAST(MAX(e.timestamp) AS VARCHAR) AS last_seen
FROM l LEFT JOIN web_events e ON e.site_id = l.site_id AND (l.s = '' OR e.utm_source = l.s) AND (l.m = '' OR e.utm_medium = l.m) AND (l.c = '' OR e.utm_campaign = l.c)
GROUP BY 1, 2
-- name: A44_scroll_depth
WITH d AS (
  SELECT site_id, path, CAST(json_extract_string(properties, '$.depth') AS DOUBLE) AS d FROM e30 WHERE type = 'scroll_depth' AND json_extract_string(properties, '$.milestone') = 'true'
), g AS (
  SELECT site_id, path, COUNT(CASE WHEN d >= 25 THEN 1 END) AS reached_25, COUNT(CASE WHEN d >= 50 THEN 1 END) AS reached_50, COUNT(CASE WHEN d >= 75 THEN 1 END) AS reached_75,
    COUNT(CASE WHEN d >= 100 THEN 1 END) AS reached_100, COUNT(*) AS total_events, FLOOR(AVG(d) * 10 + 0.5) / 10 AS avg_depth FROM d GROUP BY 1, 2
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY total_events DESC, path) AS rn FROM g)
SELECT site_id, path, reached_25, reached_50, reached_75, reached_100, total_events, avg_depth FROM r WHERE rn <= 20
-- name: A45_heatmap_points
WITH g AS (
  SELECT site_id, path, CAST(json_extract_string(properties, '$.relX') AS DOUBLE) AS rel_x, CAST(json_extract_string(properties, '$.relY') AS DOUBLE) AS rel_y,
    CAST(json_extract_string(properties, '$.x') AS BIGINT) AS abs_x, CAST(json_extract_string(properties, '$.y') AS BIGINT) AS abs_y,
    json_extract_string(properties, '$.selector') AS selector, COUNT(*) AS clicks
  FROM e30 WHERE type = 'heatmap_click' GROUP BY 1, 2, 3, 4, 5, 6, 7
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY clicks DESC, rel_x, rel_y, abs_x, abs_y, selector) AS rn FROM g)
SELECT site_id, path, rel_x, rel_y, abs_x, abs_y, selector, clicks FROM r WHERE rn <= 500
-- name: A46_heatmap_summary
WITH g AS (SELECT site_id, path, json_extract_string(properties, '$.selector') AS selector, COUNT(*) AS clicks FROM e30 WHERE type = 'heatmap_click' GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY clicks DESC, path, selector) AS rn FROM g)
SELECT site_id, path, selector, clicks FROM r WHERE rn <= 50
-- name: A47_page_actions
WITH g AS (
  SELECT site_id, path, json_extract_string(properties, '$.text') AS text, json_extract_string(properties, '$.selector') AS selector, json_extract_string(properties, '$.tag') AS tag,
    COUNT(*) AS clicks, COUNT(DISTINCT user_id) AS unique_users FROM e30 WHERE type = 'heatmap_click' GROUP BY 1, 2, 3, 4, 5
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY clicks DESC, text, selector, tag) AS rn FROM g)
SELECT site_id, path, text, selector, tag, clicks, unique_users FROM r WHERE rn <= 30
-- name: A48_heatmap_clusters
WITH RECURSIVE g AS (
  SELECT site_id, path, CAST(json_extract_string(properties, '$.relX') AS DOUBLE) AS x, CAST(json_extract_string(properties, '$.relY') AS DOUBLE) AS y,
    CAST(json_extract_string(properties, '$.x') AS BIGINT) AS ax, CAST(json_extract_string(properties, '$.y') AS BIGINT) AS ay,
    json_extract_string(properties, '$.selector') AS s, COUNT(*) AS k
  FROM e30 WHERE type = 'heatmap_click' GROUP BY 1, 2, 3, 4, 5, 6, 7
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY k DESC, x, y, ax, ay, s) AS rn FROM g),
c AS (
  SELECT site_id, path, 0.0::DOUBLE AS rel_x, 0.0::DOUBLE AS rel_y, '' AS selector, CAST(0 AS BIGINT) AS clicks, CAST(0 AS BIGINT) AS members,
    LIST({'x': x, 'y': y, 's': s, 'k': k} ORDER BY rn) AS free FROM r WHERE rn <= 500 GROUP BY 1, 2
  UNION ALL
  SELECT site_id, path, free[1].x, free[1].y, free[1].s,
    CAST(LIST_SUM([p.k FOR p IN free IF SQRT((p.x - free[1].x) ** 2 + (p.y - free[1].y) ** 2) <= 3]) AS BIGINT),
    CAST(LEN([p.k FOR p IN free IF SQRT((p.x - free[1].x) ** 2 + (p.y - free[1].y) ** 2) <= 3]) AS BIGINT),
    [p FOR p IN free IF SQRT((p.x - free[1].x) ** 2 + (p.y - free[1].y) ** 2) > 3]
  FROM c WHERE LEN(free) > 0
)
SELECT site_id, path, rel_x, rel_y, selector, clicks, members FROM c WHERE members > 0
-- name: A48b_heatmap_grid
SELECT site_id, path, CAST(FLOOR(CAST(json_extract_string(properties, '$.relX') AS DOUBLE) / 3) AS BIGINT) AS cell_x,
  CAST(FLOOR(CAST(json_extract_string(properties, '$.relY') AS DOUBLE) / 3) AS BIGINT) AS cell_y, COUNT(*) AS clicks
FROM e30 WHERE type = 'heatmap_click' GROUP BY 1, 2, 3, 4
-- name: A49_rage_clicks
WITH g AS (
  SELECT site_id, path, json_extract_string(properties, '$.selector') AS selector, COUNT(*) AS incidents,
    CAST(SUM(CAST(json_extract_string(properties, '$.count') AS BIGINT)) AS BIGINT) AS total_clicks, MIN(timestamp) AS a, MAX(timestamp) AS z
  FROM e30 WHERE type = 'rage_click' GROUP BY 1, 2, 3
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY incidents DESC, path, selector) AS rn FROM g)
SELECT site_id, path, selector, incidents, total_clicks, CAST(a AS VARCHAR) AS first_seen, CAST(z AS VARCHAR) AS last_seen FROM r WHERE rn <= 30
-- name: A51_time_on_page
WITH d AS (SELECT site_id, path, CAST(json_extract_string(properties, '$.seconds') AS DOUBLE) AS v FROM e30 WHERE type = 'time_on_page'),
g AS (
  SELECT site_id, path, FLOOR(AVG(v) * 10 + 0.5) / 10 AS avg_time, FLOOR(ROUND(QUANTILE_CONT(v, 0.5) * 10, 6) + 0.5) / 10 AS median_time,
    CAST(MIN(v) AS BIGINT) AS min_time, CAST(MAX(v) AS BIGINT) AS max_time, COUNT(*) AS samples FROM d WHERE v > 0 AND v < 3600 GROUP BY 1, 2
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY samples DESC, path) AS rn FROM g)
SELECT site_id, path, avg_time, median_time, min_time, max_time, samples FROM r WHERE rn <= 20
-- name: A52_engagement_summary
WITH d AS (
  SELECT site_id, type, CASE WHEN type = 'scroll_depth' THEN CAST(json_extract_string(properties, '$.depth') AS DOUBLE) END AS depth,
    CASE WHEN type = 'time_on_page' THEN CAST(json_extract_string(properties, '$.seconds') AS DOUBLE) END AS s FROM e30
  WHERE type IN ('scroll_depth', 'time_on_page', 'rage_click', 'heatmap_click')
)
SELECT site_id, COALESCE(FLOOR(AVG(depth) * 10 + 0.5) / 10, 0.0::DOUBLE) AS avg_scroll_depth,
  COALESCE(FLOOR(AVG(CASE WHEN s > 0 AND s < 3600 THEN s END) * 10 + 0.5) / 10, 0.0::DOUBLE) AS avg_time_on_page,
  COUNT(CASE WHEN type = 'rage_click' THEN 1 END) AS total_rage_clicks, COUNT(CASE WHEN type = 'heatmap_click' THEN 1 END) AS total_clicks FROM d GROUP BY 1
-- name: A53_web_vitals_by_page
WITH d AS (
  SELECT site_id, path, json_extract_string(properties, '$.name') AS metric, CAST(json_extract_string(properties, '$.value') AS DOUBLE) AS v FROM e30 WHERE type = 'web_vital'
), g AS (
  SELECT site_id, path, metric, FLOOR(CAST(SUM(CAST(v AS DECIMAL(28, 6))) AS DOUBLE) / COUNT(v) * 100 + 0.5) / 100 AS avg_value,
    FLOOR(ROUND(QUANTILE_CONT(v, 0.75) * 100, 6) + 0.5) / 100 AS p75_value, COUNT(*) AS samples FROM d GROUP BY 1, 2, 3
), t AS (SELECT site_id, path, CAST(SUM(samples) AS BIGINT) AS page_samples, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY SUM(samples) DESC, path) AS rn FROM g GROUP BY 1, 2)
SELECT g.site_id, g.path, metric, avg_value, p75_value, samples, page_samples FROM g JOIN t USING (site_id, path) WHERE rn <= 5
-- name: A54k_vitals_from_sketches
WITH d AS (
  SELECT site_id, path, json_extract_string(properties, '$.name') AS metric, CAST(json_extract_string(properties, '$.value') AS DOUBLE) AS v
  FROM web_events WHERE type = 'web_vital' AND CAST(timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'),
x AS (SELECT * FROM d UNION ALL SELECT site_id, '(all)', metric, v FROM d)
SELECT site_id, path, metric, COUNT(*) AS samples, QUANTILE_DISC(v, 0.75) AS p75_value, TRUE AS is_close FROM x WHERE v IS NOT NULL GROUP BY 1, 2, 3
-- name: A54_web_vitals_overview
WITH d AS (
  SELECT site_id, json_extract_string(properties, '$.name') AS metric, CAST(json_extract_string(properties, '$.value') AS DOUBLE) AS v FROM e30 WHERE type = 'web_vital'
), g AS (
  SELECT site_id, metric, FLOOR(CAST(SUM(CAST(v AS DECIMAL(28, 6))) AS DOUBLE) / COUNT(v) * 100 + 0.5) / 100 AS avg_value,
    FLOOR(ROUND(QUANTILE_CONT(v, 0.75) * 100, 6) + 0.5) / 100 AS p75_value, COUNT(*) AS samples FROM d GROUP BY 1, 2
), k(metric, good, poor) AS (VALUES ('LCP', 2500.0, 4000.0), ('FID', 100.0, 300.0), ('CLS', 0.1, 0.25), ('INP', 200.0, 500.0), ('TTFB', 800.0, 1800.0))
SELECT site_id, metric, avg_value, p75_value, samples, CASE WHEN p75_value <= good THEN 'good' WHEN p75_value <= poor THEN 'needs-improvement' ELSE 'poor' END AS rating
FROM g JOIN k USING (metric)
-- name: A55_js_errors
WITH g AS (
  SELECT site_id, json_extract_string(properties, '$.message') AS message, json_extract_string(properties, '$.source') AS source_file, path AS page,
    COUNT(*) AS occurrences, COUNT(DISTINCT user_id) AS affected_users, MIN(timestamp) AS a, MAX(timestamp) AS z FROM e30 WHERE type = 'js_error' GROUP BY 1, 2, 3, 4
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY occurrences DESC, message, source_file, page) AS rn FROM g)
SELECT site_id, message, source_file, page, occurrences, affected_users, CAST(a AS VARCHAR) AS first_seen, CAST(z AS VARCHAR) AS last_seen FROM r WHERE rn <= 30
-- name: A55b_js_errors_daily
SELECT site_id, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, COUNT(*) AS errors, COUNT(DISTINCT user_id) AS affected_users FROM e30 WHERE type = 'js_error' GROUP BY 1, 2
-- name: A57_annotations_in_range
WITH a(id, site_id, date, title) AS (VALUES ('n1', 'site_a', DATE '2024-01-10', 'Launch'), ('n2', 'site_b', DATE '2024-01-12', 'Sale')),
d AS (SELECT site_id, CAST(timestamp AS DATE) AS date, COUNT(DISTINCT user_id) AS visitors FROM e30 GROUP BY 1, 2)
SELECT d.site_id, CAST(d.date AS VARCHAR) AS date, d.visitors, a.id, a.title, CASE WHEN a.id IS NOT NULL THEN '' END AS description, CASE WHEN a.id IS NOT NULL THEN 'general' END AS category
FROM d LEFT JOIN a ON a.site_id = d.site_id AND a.date = d.date
-- name: A58_site_sql
SELECT country, COUNT(*) AS events FROM web_events WHERE site_id = 'site_b' AND type = 'pageview' GROUP BY country
-- name: A58b_site_sql_parts
WITH te AS (SELECT * FROM web_events WHERE site_id = 'site_a'), ts AS (SELECT * FROM web_sessions WHERE site_id = 'site_a'),
busy AS (SELECT path, COUNT(*) AS views FROM te WHERE type = 'pageview' GROUP BY path),
ranked AS (SELECT path, views, RANK() OVER (ORDER BY views DESC, path) AS place, NTILE(3) OVER (ORDER BY views DESC, path) AS third,
  CAST(SUM(views) OVER (ORDER BY views RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS BIGINT) AS near FROM busy)
SELECT 'page' AS part, path AS label, views AS n, place, third, near FROM ranked
UNION ALL SELECT 'entry', r.path, COUNT(*), r.place, MIN(r.third), CAST(SUM(s.pageviews) AS BIGINT)
FROM ts s JOIN ranked r ON s.entry_page = r.path GROUP BY r.path, r.place
UNION ALL SELECT 'device', device, 0, 0, 0, 0 FROM (SELECT DISTINCT device FROM te WHERE device <> 'Tablet' AND device IN (SELECT device FROM ts WHERE is_bounce))
-- name: A60_report_sources
WITH g AS (SELECT site_id, COALESCE(NULLIF(os, ''), 'Unknown') AS label, COUNT(DISTINCT user_id) AS v FROM e30 GROUP BY 1, 2),
b AS (SELECT site_id, COALESCE(NULLIF(browser, ''), 'Unknown') AS label, COUNT(DISTINCT user_id) AS v FROM e30 GROUP BY 1, 2)
SELECT site_id, 'os' AS data_source, label, v AS visitors FROM g UNION ALL SELECT site_id, 'browsers', label, v FROM b
-- name: A61_ab_assignment_audit
WITH RECURSIVE u AS (SELECT DISTINCT site_id, user_id FROM e30),
h AS (
  SELECT site_id, user_id, user_id || ':copy' AS s, 0 AS i, CAST(2166136261 AS BIGINT) AS x FROM u
  UNION ALL
  SELECT site_id, user_id, s, i + 1, CAST((CAST(XOR(x, CAST(ASCII(SUBSTR(s, i + 1, 1)) AS BIGINT)) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT) FROM h WHERE i < LENGTH(s)
), f AS (SELECT site_id, user_id, CASE x % 2 WHEN 0 THEN 'a' ELSE 'b' END AS variant FROM h WHERE i = LENGTH(s)),
g AS (SELECT site_id, variant, COUNT(*) AS visitors FROM f GROUP BY 1, 2)
SELECT site_id, variant, visitors, CAST(0 AS BIGINT) AS logged, CAST(0 AS BIGINT) AS mismatches,
  FLOOR(visitors / CAST(SUM(visitors) OVER (PARTITION BY site_id) AS DOUBLE) * 1000 + 0.5) / 10 AS share FROM g
-- name: Q01_total_events
SELECT COUNT(*) AS total FROM web_events
-- name: Q02_unique_visitors
SELECT COUNT(DISTINCT user_id) AS visitors FROM web_events
-- name: Q03_sessions
SELECT COUNT(DISTINCT session_id) AS sessions FROM web_events
-- name: Q04_daily_events
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, COUNT(*) AS events FROM web_events GROUP BY 1
-- name: Q05_daily_unique_visitors
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, COUNT(DISTINCT user_id) AS visitors FROM web_events GROUP BY 1
-- name: Q06_top_pages
SELECT path, COUNT(*) AS views, COUNT(DISTINCT user_id) AS visitors FROM web_events WHERE type = 'pageview' GROUP BY path ORDER BY views DESC, path LIMIT 20
-- name: Q07_referrer_sources
SELECT COALESCE(NULLIF(referrer, ''), 'direct') AS source, COUNT(*) AS hits, COUNT(DISTINCT session_id) AS sessions FROM web_events GROUP BY COALESCE(NULLIF(referrer, ''), 'direct')
-- name: Q08_date_range_filter
SELECT COUNT(*) AS events, COUNT(DISTINCT user_id) AS visitors FROM web_events
WHERE site_id = 'site_a' AND timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-31'
-- name: Q09_multi_dim_groupby
SELECT country, device, browser, os, COUNT(*) AS events FROM web_events GROUP BY 1, 2, 3, 4
ORDER BY events DESC, country NULLS LAST, device NULLS LAST, browser NULLS LAST, os NULLS LAST LIMIT 50
-- name: Q10_dashboard_kpi
SELECT COUNT(*) AS total_events, COUNT(DISTINCT user_id) AS visitors, COUNT(DISTINCT session_id) AS sessions,
  COUNT(CASE WHEN type = 'pageview' THEN 1 END) AS pageviews, COUNT(DISTINCT path) AS distinct_paths FROM web_events
WHERE site_id = 'site_a' AND timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-31'
-- name: Q11_utm_campaign_breakdown
SELECT utm_source, utm_medium, utm_campaign, COUNT(*) AS events, COUNT(DISTINCT user_id) AS visitors FROM web_events
WHERE timestamp >= TIMESTAMP '2024-01-01' AND timestamp < TIMESTAMP '2024-01-31' AND utm_source <> '' GROUP BY 1, 2, 3
-- name: Q12_hourly_pattern
SELECT CAST(EXTRACT(HOUR FROM timestamp) AS INTEGER) AS hour, COUNT(*) AS events FROM web_events GROUP BY 1
-- name: B01_timing_summary
SELECT event_type, COUNT(*) AS n, FLOOR(MIN(value) * 1000 + 0.5) / 1000 AS min, FLOOR(MAX(value) * 1000 + 0.5) / 1000 AS max,
  FLOOR(CAST(SUM(CAST(value AS DECIMAL(28, 6))) AS DOUBLE) / COUNT(*) * 1000 + 0.5) / 1000 AS mean, FLOOR(QUANTILE_DISC(value, 0.5) * 1000 + 0.5) / 1000 AS median,
  FLOOR(QUANTILE_DISC(value, 0.95) * 1000 + 0.5) / 1000 AS p95, FLOOR(QUANTILE_DISC(value, 0.99) * 1000 + 0.5) / 1000 AS p99, ROUND(STDDEV_SAMP(value), 3) AS stddev
FROM events GROUP BY 1
-- name: A17s_saved_funnels
WITH st(site_id, funnel_id, funnel, step_no, step, kind, p) AS (VALUES
  ('site_a', 'f1', 'Shop', 0, 'Home', 'pageview', '/'), ('site_a', 'f1', 'Shop', 1, 'Cart', 'add_to_cart', NULL), ('site_a', 'f1', 'Shop', 2, 'Paid', 'purchase', NULL),
  ('site_b', 'f2', 'Read', 0, 'Docs', 'pageview', '/docs'), ('site_b', 'f2', 'Read', 1, 'Any page', 'pageview', NULL), ('site_b', 'f2', 'Read', 2, 'Never', 'lead', NULL),
  ('site_a', 'f3', 'Read', 0, 'Docs', 'pageview', '/docs'), ('site_a', 'f3', 'Read', 1, 'Any page', 'pageview', NULL), ('site_a', 'f3', 'Read', 2, 'Never', 'lead', NULL)),
t AS (SELECT site_id, COUNT(DISTINCT user_id) AS n FROM e30 GROUP BY 1),
h AS (SELECT st.*, COUNT(DISTINCT e30.user_id) AS visitors FROM st LEFT JOIN e30 ON e30.site_id = st.site_id AND e30.type = st.kind AND (st.p IS NULL OR e30.path = st.p) GROUP BY ALL),
l AS (SELECT h.*, n, LAG(visitors) OVER (PARTITION BY funnel_id ORDER BY step_no) AS b FROM h JOIN t ON t.site_id = h.site_id)
SELECT site_id, funnel_id, funnel, step_no, step, visitors, FLOOR(visitors / CAST(n AS DOUBLE) * 1000 + 0.5) / 10 AS percentage,
  GREATEST(CASE WHEN b > 0 THEN FLOOR((b - visitors) / CAST(b AS DOUBLE) * 1000 + 0.5) / 10 ELSE 0.0::DOUBLE END, 0.0::DOUBLE) AS drop_off FROM l
