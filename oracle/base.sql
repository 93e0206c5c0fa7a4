typed AS (
  SELECT *,
    CASE
      WHEN event_type = 'view' THEN 'pageview'
      WHEN event_type = 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'purchase' WHEN 1 THEN 'checkout' WHEN 2 THEN 'add_to_cart' ELSE 'pageview' END
      WHEN event_type = 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'signup' WHEN 1 THEN 'site_search' WHEN 2 THEN 'time_on_page' ELSE 'web_vital' END
      WHEN event_type = 'click' THEN CASE event_id % 4 WHEN 2 THEN 'scroll_depth' WHEN 3 THEN 'rage_click' ELSE 'heatmap_click' END
      ELSE CASE event_id % 2 WHEN 0 THEN 'js_error' ELSE 'pageview' END
    END AS type,
    CASE WHEN user_id % 10 < 7 THEN 'site_a' WHEN user_id % 10 < 9 THEN 'site_b' ELSE 'site_c' END AS site_id,
    CASE (event_id + user_id) % 8 WHEN 0 THEN '/' WHEN 1 THEN '/products' WHEN 2 THEN '/pricing' WHEN 3 THEN '/docs'
      WHEN 4 THEN '/blog' WHEN 5 THEN '/about' WHEN 6 THEN '/signup' ELSE '/guides/email-templates' END AS path
  FROM events
), web_events AS (
  SELECT
    CAST(event_id AS STRING) AS id, site_id,
    'u_' || CAST(user_id AS STRING) AS user_id,
    'u_' || CAST(user_id AS STRING) || '_' || CAST(CAST(ts AS DATE) AS STRING) AS session_id,
    type,
    'https://' || site_id || '.example.com' || path || CASE WHEN event_id % 10 = 0 THEN '?token=abc&q=x#frag' ELSE '' END AS url,
    path,
    CASE user_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'https://www.google.com/search' WHEN 3 THEN 'https://facebook.com/post'
      WHEN 4 THEN 'https://t.co/x' WHEN 5 THEN 'https://mail.example.com' ELSE 'https://news.example.org' END AS referrer,
    CASE user_id % 4 WHEN 0 THEN 'Desktop' WHEN 1 THEN 'Mobile' WHEN 2 THEN 'Tablet' ELSE '' END AS device,
    CASE user_id % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' ELSE 'Firefox' END AS browser,
    CASE user_id % 5 WHEN 0 THEN 'macOS' WHEN 1 THEN 'Windows' WHEN 2 THEN 'iOS' WHEN 3 THEN 'Android' ELSE 'Linux' END AS os,
    CASE user_id % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'United States' WHEN 2 THEN 'IN' WHEN 3 THEN 'Germany' WHEN 4 THEN '' ELSE NULL END AS country,
    CASE user_id % 5 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'London' WHEN 2 THEN 'Mumbai' WHEN 3 THEN '' ELSE NULL END AS city,
    ts AS timestamp,
    CASE type
      WHEN 'scroll_depth' THEN '{"depth":' || CASE WHEN event_id % 16 < 4 THEN '25' WHEN event_id % 16 < 8 THEN '50' WHEN event_id % 16 < 12 THEN '75' ELSE '100' END || ',"milestone":"true"}'
      WHEN 'heatmap_click' THEN '{"selector":"button.b' || CAST(event_id % 5 AS STRING) || '","text":"t' || CAST(event_id % 3 AS STRING) || '","tag":"button","relX":' || CAST(event_id % 100 AS STRING) || ',"relY":' || CAST(user_id % 100 AS STRING) || ',"x":' || CAST(event_id % 1280 AS STRING) || ',"y":' || CAST(user_id % 720 AS STRING) || '}'
      WHEN 'rage_click' THEN '{"selector":"a.r' || CAST(event_id % 5 AS STRING) || '","count":' || CAST(3 + event_id % 4 AS STRING) || '}'
      WHEN 'time_on_page' THEN '{"seconds":' || CAST(event_id % 4000 AS STRING) || '}'
      WHEN 'web_vital' THEN '{"name":"' || CASE event_id % 5 WHEN 0 THEN 'LCP' WHEN 1 THEN 'FID' WHEN 2 THEN 'CLS' WHEN 3 THEN 'INP' ELSE 'TTFB' END || '","value":' || CAST(value AS STRING) || '}'
      WHEN 'js_error' THEN '{"message":"E' || CAST(event_id % 6 AS STRING) || '","source":"app' || CAST(user_id % 2 AS STRING) || '.js"}'
      WHEN 'site_search' THEN '{"query":"q' || CAST(event_id % 9 AS STRING) || '","param":"q"}'
      WHEN 'purchase' THEN '{"value":' || CAST(value AS STRING) || '}'
      ELSE '{}' END AS properties,
    CASE user_id % 6 WHEN 3 THEN 'google' WHEN 4 THEN 'newsletter' WHEN 5 THEN NULL ELSE '' END AS utm_source,
    CASE user_id % 6 WHEN 3 THEN 'cpc' WHEN 4 THEN 'email' ELSE '' END AS utm_medium,
    CASE user_id % 6 WHEN 3 THEN 'launch' ELSE '' END AS utm_campaign,
    CASE user_id % 8 WHEN 3 THEN 'free templates' WHEN 5 THEN 'email tools' ELSE '' END AS utm_term,
    '' AS utm_content
  FROM typed
), e30 AS (
  SELECT * FROM web_events WHERE timestamp >= TIMESTAMP '2024-01-01' AND timestamp <= TIMESTAMP '2024-01-31'
), ranked_events AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, session_id, user_id ORDER BY timestamp, id) AS n_first
  FROM web_events
), ranked_views AS (
  SELECT site_id, session_id, user_id, path,
    ROW_NUMBER() OVER (PARTITION BY site_id, session_id, user_id ORDER BY timestamp, id) AS n_first,
    ROW_NUMBER() OVER (PARTITION BY site_id, session_id, user_id ORDER BY timestamp DESC, id DESC) AS n_last
  FROM web_events WHERE type = 'pageview'
), session_sums AS (
  SELECT site_id, session_id, user_id, MIN(timestamp) AS started_at, MAX(timestamp) AS ended_at,
    SUM(CASE WHEN type = 'pageview' THEN 1 ELSE 0 END) AS pageviews
  FROM web_events GROUP BY site_id, session_id, user_id
), web_sessions AS (
  SELECT s.site_id, s.session_id AS id, s.user_id, s.started_at, s.ended_at,
    DATE_SUB('second', s.started_at, s.ended_at) AS duration, CAST(s.pageviews AS BIGINT) AS pageviews,
    en.path AS entry_page, ex.path AS exit_page,
    f.referrer, f.device, f.browser, f.os, f.country, f.city, f.utm_source, f.utm_medium, f.utm_campaign,
    s.pageviews <= 1 AS is_bounce,
    ROW_NUMBER() OVER (PARTITION BY s.site_id, s.user_id ORDER BY s.started_at, s.session_id) > 1 AS is_returning
  FROM session_sums s
  JOIN ranked_events f ON f.site_id = s.site_id AND f.session_id = s.session_id AND f.user_id = s.user_id AND f.n_first = 1
  LEFT JOIN ranked_views en ON en.site_id = s.site_id AND en.session_id = s.session_id AND en.user_id = s.user_id AND en.n_first = 1
  LEFT JOIN ranked_views ex ON ex.site_id = s.site_id AND ex.session_id = s.session_id AND ex.user_id = s.user_id AND ex.n_last = 1
), s30 AS (
  SELECT * FROM web_sessions WHERE started_at >= TIMESTAMP '2024-01-01' AND started_at <= TIMESTAMP '2024-01-31'
), obs AS (
  SELECT CASE WHEN l_suppkey % 10 < 7 THEN 'site_a' WHEN l_suppkey % 10 < 9 THEN 'site_b' ELSE 'site_c' END AS site_id,
         'kw_' || CAST(l_partkey % 20 AS STRING) AS keyword,
         'United States' AS location, 'desktop' AS device,
         CAST(l_shipdate AS DATE) AS checked_at,
         MIN(CASE WHEN l_quantity > 45 THEN NULL ELSE CAST(l_quantity AS INT) END) AS position,
         MAX(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) = 1 AS ai_overview,
         MAX(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 AS is_cited
  FROM lineitem GROUP BY 1, 2, 5
), raw_ev AS (
  SELECT *, CAST(id AS BIGINT) AS n FROM web_events
), reqs AS (
  SELECT event_id AS n, user_id AS u, CAST(event_id AS VARCHAR) AS id,
    '10.' || CAST(event_id % 4 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) AS ip,
    10 * 16777216 + (event_id % 4) * 65536 + (user_id % 256) * 256 + event_id % 256 AS ipn
  FROM events
), issue_src AS (
  SELECT o_orderkey AS k, CASE WHEN o_custkey % 10 < 7 THEN 'site_a' WHEN o_custkey % 10 < 9 THEN 'site_b' ELSE 'site_c' END AS site_id,
    SUBSTR(o_orderpriority, 1, 1) AS project_slug, o_orderpriority, o_orderstatus, CAST(FLOOR(o_totalprice) AS BIGINT) AS cnt,
    o_orderdate AS first_seen, o_orderdate + INTERVAL 5 DAY AS last_seen
  FROM orders
), issue_rows AS (
  SELECT k, site_id || ':' || CAST(k AS VARCHAR) AS issue_id, site_id, CAST(k AS VARCHAR) AS sentry_id, 'S-' || CAST(k AS VARCHAR) AS short_id,
    CASE WHEN k % 3 <> 0 THEN 'Error in ' || o_orderpriority WHEN k % 6 = 0 THEN 'Meta value' ELSE 'MetaType' END AS title,
    CASE k % 4 WHEN 0 THEN 'fatal' WHEN 2 THEN 'warning' ELSE 'error' END AS level,
    CASE o_orderstatus WHEN 'F' THEN 'resolved' ELSE 'unresolved' END AS status, cnt AS count, k % 50 AS user_count, project_slug,
    k % 10 = 0 AS is_regression, '1.' || CAST(k % 4 AS VARCHAR) AS last_release, first_seen, last_seen
  FROM issue_src
), slots AS (
  SELECT CASE l_partkey % 20 WHEN 0 THEN 'email templates' WHEN 1 THEN 'products' WHEN 2 THEN 'pricing' ELSE 'kw_' || CAST(l_partkey % 20 AS VARCHAR) END AS keyword,
    CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS month, l_orderkey % 10 + 1 AS slot,
    MIN(l_suppkey + l_partkey) % 8 AS host, MAX(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS is_open,
    MAX(CASE WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 1 ELSE 0 END) AS quoted
  FROM lineitem GROUP BY 1, 2, 3
), snaps AS (
  SELECT keyword, month, CAST(EXTRACT(MONTH FROM month) AS INTEGER) AS m, LAG(month) OVER (PARTITION BY keyword ORDER BY month) AS prev_month,
    COALESCE(MAX(CASE WHEN slot <= 3 THEN is_open END) = 1 AND EXTRACT(MONTH FROM month) % 3 <> 0, FALSE) AS has_ai
  FROM slots GROUP BY keyword, month
), cites AS (
  SELECT s.keyword, s.month, s.slot, s.host FROM slots s JOIN snaps n ON n.keyword = s.keyword AND n.month = s.month WHERE n.has_ai AND s.quoted = 1 AND s.slot <= 4
), page_kw AS (
  SELECT s.site_id, s.host AS own, p.path, k.keyword, k.is_primary
  FROM (VALUES ('site_a', 1), ('site_b', 2), ('site_c', 3)) s(site_id, host)
  CROSS JOIN (VALUES (0, '/products', 'products'), (1, '/pricing', 'pricing'), (2, '/docs', 'kw_3'), (3, '/blog', 'kw_4'), (4, '/signup', 'kw_5'), (5, '/guides/email-templates', 'email templates'), (6, '/', 'kw_7')) p(i, path, name)
  CROSS JOIN LATERAL (SELECT p.name AS keyword, TRUE AS is_primary UNION ALL SELECT 'kw_' || CAST(p.i + 8 AS VARCHAR), FALSE) k
), ranks AS (
  SELECT t.site_id, t.own, n.keyword, n.month, n.m, n.prev_month, n.has_ai,
    (SELECT MIN(s.slot) FROM slots s WHERE s.keyword = n.keyword AND s.month = n.month AND s.host = t.own) AS position,
    EXISTS (SELECT 1 FROM cites c WHERE c.keyword = n.keyword AND c.month = n.month AND c.host = t.own) AS is_cited
  FROM snaps n JOIN (SELECT DISTINCT site_id, own, keyword FROM page_kw) t ON t.keyword = n.keyword
), changes AS (
  SELECT r.*, p.position AS prev_position, p.has_ai AS prev_ai, p.is_cited AS prev_cited, p.m AS pm, p.month IS NOT NULL AS has_previous,
    CASE WHEN p.month IS NULL THEN 'unknown' WHEN NOT p.has_ai AND r.has_ai THEN 'new_overview' WHEN p.is_cited AND NOT r.is_cited THEN 'lost'
      WHEN NOT p.is_cited AND r.is_cited THEN 'gained' ELSE 'unchanged' END AS citation_change
  FROM ranks r LEFT JOIN ranks p ON p.site_id = r.site_id AND p.keyword = r.keyword AND p.month = r.prev_month
), first_slots AS (
  SELECT keyword, month, host, MIN(slot) AS slot FROM slots GROUP BY 1, 2, 3
), over_rows AS (
  SELECT c.site_id, c.keyword, c.month, f.host, f.slot, b.slot AS was,
    ROW_NUMBER() OVER (PARTITION BY c.site_id, c.keyword, c.month ORDER BY f.slot) AS rn
  FROM changes c JOIN first_slots f ON f.keyword = c.keyword AND f.month = c.month AND f.host <> c.own AND (c.position IS NULL OR f.slot < c.position)
  LEFT JOIN first_slots b ON b.keyword = c.keyword AND b.month = c.prev_month AND b.host = f.host
  WHERE c.prev_position IS NOT NULL AND (b.slot IS NULL OR b.slot > c.prev_position)
), overs AS (
  SELECT site_id, keyword, month, STRING_AGG('s' || CAST(host AS VARCHAR) || '.example.com:' || COALESCE(CAST(was AS VARCHAR), '-') || '>' || CAST(slot AS VARCHAR), ',' ORDER BY slot) AS overtaken,
    STRING_AGG(CASE WHEN rn <= 2 THEN 's' || CAST(host AS VARCHAR) || '.example.com' END, ', ' ORDER BY slot) AS names, COUNT(*) AS n_over
  FROM over_rows WHERE rn <= 3 GROUP BY 1, 2, 3
), diffs AS (
  SELECT c.*, COALESCE(o.overtaken, '') AS overtaken, o.names, COALESCE(o.n_over, 0) AS n_over,
    has_previous AND m % 5 = 0 AND pm % 5 <> 0 AS add_snippet, has_previous AND m % 2 = 0 AND pm % 2 <> 0 AS add_paa, has_previous AND m % 4 = 0 AND pm % 4 <> 0 AS add_video,
    has_previous AND m % 5 <> 0 AND pm % 5 = 0 AS del_snippet, has_previous AND m % 2 <> 0 AND pm % 2 = 0 AS del_paa, has_previous AND m % 4 <> 0 AND pm % 4 = 0 AS del_video
  FROM changes c LEFT JOIN overs o ON o.site_id = c.site_id AND o.keyword = c.keyword AND o.month = c.month
)
