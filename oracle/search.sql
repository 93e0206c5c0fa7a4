-- name: R07b_rank_as_of
WITH v AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 < 7 THEN 'site_a' WHEN o_custkey % 10 < 9 THEN 'site_b' ELSE 'site_c' END AS site_id,
  'kw_' || CAST(o_orderkey % 23 AS VARCHAR) AS keyword, CAST(o_orderdate AS DATE) AS at FROM orders)
SELECT v.o_orderkey, v.site_id, v.keyword, o.position, CAST(o.checked_at AS VARCHAR) AS observed_at
FROM v ASOF LEFT JOIN obs o ON v.site_id = o.site_id AND v.keyword = o.keyword AND v.at >= o.checked_at
-- name: R07c_rank_as_of_fresh
WITH v AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 < 7 THEN 'site_a' WHEN o_custkey % 10 < 9 THEN 'site_b' ELSE 'site_c' END AS site_id,
  'kw_' || CAST(o_orderkey % 23 AS VARCHAR) AS keyword, CAST(o_orderdate AS DATE) AS at FROM orders)
SELECT v.o_orderkey, v.site_id, v.keyword, CASE WHEN v.at - o.checked_at <= 2 THEN o.position END AS position,
  CASE WHEN v.at - o.checked_at <= 2 THEN CAST(o.checked_at AS VARCHAR) END AS observed_at
FROM v ASOF LEFT JOIN obs o ON v.site_id = o.site_id AND v.keyword = o.keyword AND v.at >= o.checked_at
-- name: R01_locate_domain
SELECT keyword, CAST(month AS VARCHAR) AS month, MIN(CASE WHEN host = 1 THEN slot END) AS position FROM slots GROUP BY 1, 2
-- name: R02_rank_observations
SELECT site_id, keyword, CAST(CAST(month AS TIMESTAMP) AS VARCHAR) AS checked_at, position, has_ai AS ai_overview, is_cited,
  'https://www.s' || CAST(own AS VARCHAR) || '.example.com/p' || CAST(position AS VARCHAR) AS url FROM ranks
-- name: R03_rank_change
WITH l AS (
  SELECT *, LAG(position) OVER w AS pp, LAG(ai_overview) OVER w AS pa, LAG(is_cited) OVER w AS pc, LAG(checked_at) OVER w AS pt FROM obs
  WINDOW w AS (PARTITION BY site_id, keyword ORDER BY checked_at)
)
SELECT site_id, keyword, CAST(checked_at AS VARCHAR) AS checked_at, position, pp AS previous_position, pp - position AS position_change,
  CASE WHEN pt IS NULL THEN 'unknown' WHEN NOT pa AND ai_overview THEN 'new_overview' WHEN pc AND NOT is_cited THEN 'lost' WHEN NOT pc AND is_cited THEN 'gained' ELSE 'unchanged' END AS citation_change FROM l
-- name: R04_serp_diff
SELECT site_id, keyword, CAST(CAST(month AS TIMESTAMP) AS VARCHAR) AS checked_at,
  CONCAT_WS(',', CASE WHEN add_snippet THEN 'featured_snippet' END, CASE WHEN add_paa THEN 'people_also_ask' END, CASE WHEN add_video THEN 'videos' END) AS features_added,
  CONCAT_WS(',', CASE WHEN del_snippet THEN 'featured_snippet' END, CASE WHEN del_paa THEN 'people_also_ask' END, CASE WHEN del_video THEN 'videos' END) AS features_removed, overtaken FROM diffs
-- name: R05_search_alerts
WITH l AS (
  SELECT *, LAG(position) OVER w AS was, LAG(ai_overview) OVER w AS pa, LAG(is_cited) OVER w AS pc, LAG(checked_at) OVER w AS pt, position AS now, '“' || keyword || '”' AS q FROM obs
  WINDOW w AS (PARTITION BY site_id, keyword ORDER BY checked_at)
), x AS (
  SELECT *, COALESCE('#' || CAST(was AS VARCHAR), 'not ranking') AS pw, COALESCE('#' || CAST(now AS VARCHAR), 'not ranking') AS pn,
    CASE WHEN was <= 10 AND (now IS NULL OR now > 10) THEN 'page_one_exit' WHEN was IS NOT NULL AND now IS NULL THEN 'ranking_lost' WHEN now - was >= 3 THEN 'rank_drop'
      WHEN (was IS NULL OR was > 10) AND now <= 10 THEN 'page_one_entry' WHEN was IS NULL AND now IS NOT NULL THEN 'ranking_found' WHEN was - now >= 3 THEN 'rank_gain' END AS t1,
    CASE WHEN pc AND NOT is_cited THEN 'ai_citation_lost' WHEN NOT pc AND is_cited THEN 'ai_citation_gained' WHEN NOT pa AND ai_overview AND NOT is_cited THEN 'ai_overview_appeared' END AS t2
  FROM l WHERE pt IS NOT NULL
)
SELECT site_id, keyword, CAST(checked_at AS VARCHAR) AS checked_at, was AS previous_position, now AS position, t1 AS type,
  CASE t1 WHEN 'page_one_exit' THEN 'critical' WHEN 'ranking_lost' THEN 'critical' WHEN 'rank_drop' THEN 'warning' ELSE 'positive' END AS severity,
  CASE t1 WHEN 'page_one_exit' THEN q || ' fell off page one: ' || pw || ' → ' || pn || '.' WHEN 'ranking_lost' THEN q || ' no longer ranks (was ' || pw || ').'
    WHEN 'rank_drop' THEN q || ' dropped ' || CAST(now - was AS VARCHAR) || ' places: ' || pw || ' → ' || pn || '.' WHEN 'page_one_entry' THEN q || ' reached page one: ' || pw || ' → ' || pn || '.'
    WHEN 'ranking_found' THEN q || ' now ranks at ' || pn || '.' ELSE q || ' climbed ' || CAST(was - now AS VARCHAR) || ' places: ' || pw || ' → ' || pn || '.' END AS message
FROM x WHERE t1 IS NOT NULL
UNION ALL
SELECT site_id, keyword, CAST(checked_at AS VARCHAR), was, now, t2, CASE t2 WHEN 'ai_citation_gained' THEN 'positive' ELSE 'warning' END,
  CASE t2 WHEN 'ai_citation_lost' THEN 'Google''s AI answer for ' || q || ' no longer quotes you.' WHEN 'ai_citation_gained' THEN 'Google''s AI answer for ' || q || ' now quotes you.'
    ELSE 'Google now shows an AI answer for ' || q || ', and it doesn''t quote you.' END
FROM x WHERE t2 IS NOT NULL
-- name: R05b_serp_alerts
WITH x AS (
  SELECT *, prev_position AS was, position AS now, '“' || keyword || '”' AS q, COALESCE('#' || CAST(prev_position AS VARCHAR), 'not ranking') AS pw, COALESCE('#' || CAST(position AS VARCHAR), 'not ranking') AS pn,
    CASE WHEN n_over > 0 THEN ' Now above you: ' || names || '.' ELSE '' END AS above, CONCAT_WS(' and ', CASE WHEN add_snippet THEN 'a featured snippet' END, CASE WHEN add_paa THEN 'a ''People also ask'' box' END, CASE WHEN add_video THEN 'a video carousel' END) AS feats,
    CASE WHEN prev_position <= 10 AND (position IS NULL OR position > 10) THEN 'page_one_exit' WHEN prev_position IS NOT NULL AND position IS NULL THEN 'ranking_lost' WHEN position - prev_position >= 3 THEN 'rank_drop'
      WHEN (prev_position IS NULL OR prev_position > 10) AND position <= 10 THEN 'page_one_entry' WHEN prev_position IS NULL AND position IS NOT NULL THEN 'ranking_found' WHEN prev_position - position >= 3 THEN 'rank_gain' END AS t1,
    CASE WHEN prev_cited AND NOT is_cited THEN 'ai_citation_lost' WHEN NOT prev_cited AND is_cited THEN 'ai_citation_gained' WHEN NOT prev_ai AND has_ai AND NOT is_cited THEN 'ai_overview_appeared' END AS t2
  FROM diffs WHERE has_previous
), a AS (
  SELECT site_id, keyword, month, t1 AS type, CASE t1 WHEN 'page_one_exit' THEN q || ' fell off page one: ' || pw || ' → ' || pn || '.' || above WHEN 'ranking_lost' THEN q || ' no longer ranks (was ' || pw || ').' || above
    WHEN 'rank_drop' THEN q || ' dropped ' || CAST(now - was AS VARCHAR) || ' places: ' || pw || ' → ' || pn || '.' || above WHEN 'page_one_entry' THEN q || ' reached page one: ' || pw || ' → ' || pn || '.'
    WHEN 'ranking_found' THEN q || ' now ranks at ' || pn || '.' ELSE q || ' climbed ' || CAST(was - now AS VARCHAR) || ' places: ' || pw || ' → ' || pn || '.' END AS message FROM x WHERE t1 IS NOT NULL
  UNION ALL SELECT site_id, keyword, month, t2, CASE t2 WHEN 'ai_citation_lost' THEN 'Google''s AI answer for ' || q || ' no longer quotes you.' WHEN 'ai_citation_gained' THEN 'Google''s AI answer for ' || q || ' now quotes you.'
    ELSE 'Google now shows an AI answer for ' || q || ', and it doesn''t quote you.' END FROM x WHERE t2 IS NOT NULL
  UNION ALL SELECT site_id, keyword, month, 'serp_feature_added', 'Google added ' || feats || ' to the results for ' || q || ' — expect fewer clicks at the same rank.' FROM x WHERE now <= 10 AND feats <> ''
)
SELECT site_id, keyword, CAST(CAST(month AS TIMESTAMP) AS VARCHAR) AS checked_at, type, message FROM a
-- name: R06_alert_feed
WITH l AS (
  SELECT *, LAG(position) OVER w AS was, LAG(ai_overview) OVER w AS pa, LAG(is_cited) OVER w AS pc, LAG(checked_at) OVER w AS pt, position AS now FROM obs
  WINDOW w AS (PARTITION BY site_id, keyword ORDER BY checked_at)
), x AS (
  SELECT *, CASE WHEN was <= 10 AND (now IS NULL OR now > 10) THEN 'page_one_exit' WHEN was IS NOT NULL AND now IS NULL THEN 'ranking_lost' WHEN now - was >= 3 THEN 'rank_drop'
      WHEN (was IS NULL OR was > 10) AND now <= 10 THEN 'page_one_entry' WHEN was IS NULL AND now IS NOT NULL THEN 'ranking_found' WHEN was - now >= 3 THEN 'rank_gain' END AS t1,
    CASE WHEN pc AND NOT is_cited THEN 'ai_citation_lost' WHEN NOT pc AND is_cited THEN 'ai_citation_gained' WHEN NOT pa AND ai_overview AND NOT is_cited THEN 'ai_overview_appeared' END AS t2
  FROM l WHERE pt IS NOT NULL
), a AS (SELECT site_id, keyword, checked_at, t1 AS type FROM x WHERE t1 IS NOT NULL UNION ALL SELECT site_id, keyword, checked_at, t2 FROM x WHERE t2 IS NOT NULL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY checked_at DESC, keyword, type) AS rn FROM a)
SELECT site_id, keyword, CAST(checked_at AS VARCHAR) AS created_at, type, '/p' || SUBSTR(keyword, 4) AS paths FROM r WHERE rn <= 50
-- name: R07_rank_history_series
WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, keyword ORDER BY checked_at DESC) AS rn FROM obs)
SELECT site_id, keyword, CAST(checked_at AS VARCHAR) AS checked_at, position, ai_overview, is_cited, CAST(ROW_NUMBER() OVER (PARTITION BY site_id, keyword ORDER BY checked_at) AS INTEGER) AS n FROM r WHERE rn <= 90
-- name: R08_keywords_due
WITH t AS (SELECT site_id, keyword, MAX(CASE WHEN checked_at < DATE '2001-08-01' THEN checked_at END) AS last_checked FROM obs GROUP BY 1, 2),
d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY last_checked NULLS FIRST, keyword) AS turn FROM t
  WHERE last_checked IS NULL OR CAST(last_checked AS TIMESTAMP) < CASE site_id WHEN 'site_a' THEN TIMESTAMP '2001-07-31 12:00:00' - INTERVAL 240 HOUR ELSE TIMESTAMP '2001-07-31 12:00:00' - INTERVAL 1 HOUR END)
SELECT site_id, keyword, '/p' || SUBSTR(keyword, 4) AS path, CASE site_id WHEN 'site_a' THEN 's1.example.com' ELSE 's3.example.com' END AS domain, CAST(last_checked AS VARCHAR) AS last_checked, CAST(turn AS INTEGER) AS turn
FROM d WHERE (site_id = 'site_a' AND turn <= 3) OR (site_id = 'site_c' AND turn <= 100)
-- name: R08b_rank_budget
SELECT site_id, COUNT(DISTINCT keyword) AS keywords, CASE site_id WHEN 'site_a' THEN 240 WHEN 'site_b' THEN 24 ELSE 1 END AS min_hours, CASE site_id WHEN 'site_a' THEN 3 WHEN 'site_b' THEN 10 ELSE 100 END AS max_per_run,
  CAST(FLOOR(COUNT(DISTINCT keyword) * (24.0::DOUBLE / CASE site_id WHEN 'site_a' THEN 240 WHEN 'site_b' THEN 24 ELSE 1 END) * 30 + 0.5) AS BIGINT) AS checks_per_month FROM obs GROUP BY 1
-- name: R09_weekly_change
WITH w AS (SELECT site_id, path, DATE_TRUNC('week', timestamp) AS week, COUNT(*) AS views FROM e30 WHERE type = 'pageview' GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY week DESC) - CASE WHEN COUNT(*) OVER (PARTITION BY site_id, path) > 2 THEN 1 ELSE 0 END AS age FROM w),
p AS (SELECT site_id, path, COALESCE(MAX(CASE WHEN age = 1 THEN views END), 0) AS c, MAX(CASE WHEN age = 2 THEN views END) AS b FROM r GROUP BY 1, 2),
x AS (SELECT *, c - b AS ch, CASE WHEN b = 0 THEN CASE WHEN c > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE (c - b) / CAST(b AS DOUBLE) * 100 END AS pct FROM p)
SELECT site_id, path, c AS current_week, b AS previous_week, ch AS change_abs, FLOOR(pct * 10 + 0.5) / 10 AS change_pct,
  CASE WHEN b IS NULL THEN 'unknown' WHEN ch < 0 THEN 'drop' WHEN ch > 0 THEN 'spike' ELSE 'flat' END AS direction, COALESCE(ABS(pct) >= 15 AND ABS(ch) >= 20, FALSE) AS significant,
  CASE WHEN b IS NULL THEN 'Not enough weekly history to compare.' WHEN NOT (ABS(pct) >= 15 AND ABS(ch) >= 20) THEN
    'Change of ' || CAST(CAST(FLOOR(pct + 0.5) AS BIGINT) AS VARCHAR) || '% (' || CAST(ch AS VARCHAR) || ' views) is below the 15% / 20-view significance floor.' END AS reason FROM x
-- name: R10_attribute_causes
WITH d AS (
  SELECT *, CASE WHEN m % 2 = 0 THEN 'drop' ELSE 'spike' END AS way, COALESCE('#' || CAST(prev_position AS VARCHAR), 'unranked') AS pw, COALESCE('#' || CAST(position AS VARCHAR), 'unranked') AS pn,
    CASE WHEN n_over > 0 THEN ', with ' || REPLACE(names, ', ', ' and ') || ' moving above you' ELSE '' END AS passed,
    LIST_FILTER([CASE WHEN add_snippet THEN 'a featured snippet' END, CASE WHEN add_paa THEN 'a ''People also ask'' box' END, CASE WHEN add_video THEN 'a video carousel' END], lambda v: v IS NOT NULL) AS fa,
    LIST_FILTER([CASE WHEN del_snippet THEN 'a featured snippet' END, CASE WHEN del_paa THEN 'a ''People also ask'' box' END, CASE WHEN del_video THEN 'a video carousel' END], lambda v: v IS NOT NULL) AS fr
  FROM diffs
), q AS (
  SELECT site_id, keyword, month, STRING_AGG('s' || CAST(host AS VARCHAR) || '.example.com', ' and ' ORDER BY slot) AS quoted FROM (
    SELECT r.site_id, c.keyword, c.month, c.host, c.slot, ROW_NUMBER() OVER (PARTITION BY r.site_id, c.keyword, c.month ORDER BY c.slot) AS rn
    FROM cites c JOIN ranks r ON r.keyword = c.keyword AND r.month = c.month AND r.own <> c.host) WHERE rn <= 2 GROUP BY 1, 2, 3
), t AS (
  SELECT d.*, q.quoted, CASE WHEN LEN(fa) <= 2 THEN ARRAY_TO_STRING(fa, ' and ') ELSE fa[1] || ', ' || fa[2] || ', and ' || fa[3] END AS fat,
    CASE WHEN LEN(fr) <= 2 THEN ARRAY_TO_STRING(fr, ' and ') ELSE fr[1] || ', ' || fr[2] || ', and ' || fr[3] END AS frt
  FROM d LEFT JOIN q ON q.site_id = d.site_id AND q.keyword = d.keyword AND q.month = d.month
), c AS (
  SELECT site_id, keyword, month, 1 AS o, 'rank_drop' AS code, 'rank slipped ' || pw || ' → ' || pn || ' on ''' || keyword || '''' || passed AS phrase FROM t WHERE position - prev_position >= 3
  UNION ALL SELECT site_id, keyword, month, 2, 'page_one_exit', 'you dropped off page one for ''' || keyword || '''' || CASE WHEN position - prev_position >= 3 THEN '' ELSE passed END FROM t WHERE prev_position <= 10 AND (position IS NULL OR position > 10)
  UNION ALL SELECT site_id, keyword, month, 3, 'ai_overview_displacement', CASE WHEN quoted IS NOT NULL THEN 'Google''s new AI answer box now quotes ' || quoted || ' instead of you' ELSE 'Google now shows an AI answer box for ''' || keyword || ''' and it does not quote you' END
    FROM t WHERE citation_change = 'new_overview' AND NOT is_cited
  UNION ALL SELECT site_id, keyword, month, 4, 'ai_citation_lost', 'you were dropped from Google''s AI answer box for ''' || keyword || '''' FROM t WHERE citation_change = 'lost'
  UNION ALL SELECT site_id, keyword, month, 5, 'serp_feature_added', 'Google added ' || fat || ' to the results for ''' || keyword || ''', pushing organic listings down' FROM t WHERE way = 'drop' AND position <= 10 AND LEN(fa) > 0
  UNION ALL SELECT site_id, keyword, month, 6, 'serp_feature_removed', 'Google removed ' || frt || ' from the results for ''' || keyword || ''', lifting organic listings' FROM t WHERE way = 'spike' AND position <= 10 AND LEN(fr) > 0
  UNION ALL SELECT site_id, keyword, month, 7, 'rank_gain', 'rank improved ' || pw || ' → ' || pn || ' on ''' || keyword || '''' FROM t WHERE way = 'spike' AND prev_position - position >= 3
  UNION ALL SELECT site_id, keyword, month, 8, 'ai_citation_gained', 'Google''s AI answer box for ''' || keyword || ''' now quotes you' FROM t WHERE way = 'spike' AND citation_change = 'gained'
)
SELECT site_id, keyword, CAST(CAST(month AS TIMESTAMP) AS VARCHAR) AS checked_at, CAST(ROW_NUMBER() OVER (PARTITION BY site_id, keyword, month ORDER BY o) - 1 AS INTEGER) AS cause_no, code, phrase FROM c
-- name: R11_pick_rival
WITH x AS (
  SELECT d.site_id, d.keyword, d.month, s.host, s.slot, EXISTS (SELECT 1 FROM cites c WHERE c.keyword = d.keyword AND c.month = d.month AND c.host = s.host AND s.host <> d.own) AS cited,
    EXISTS (SELECT 1 FROM over_rows o WHERE o.site_id = d.site_id AND o.keyword = d.keyword AND o.month = d.month AND o.host = s.host AND o.rn <= 3) AS passed
  FROM diffs d JOIN slots s ON s.keyword = d.keyword AND s.month = d.month AND (d.position IS NULL OR s.slot < d.position)
), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, keyword, month ORDER BY CASE WHEN cited AND passed THEN 1 WHEN passed THEN 2 WHEN cited THEN 3 ELSE 4 END, slot) AS rn FROM x)
SELECT site_id, keyword, CAST(CAST(month AS TIMESTAMP) AS VARCHAR) AS checked_at, 's' || CAST(host AS VARCHAR) || '.example.com' AS domain, slot AS position, cited AS also_cited, passed AS overtook FROM r WHERE rn = 1
-- name: R14_steady_page_score
WITH latest AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, keyword ORDER BY month DESC) AS rn FROM diffs),
sc AS (SELECT site_id, keyword, CASE WHEN NOT has_ai OR is_cited THEN 0 WHEN citation_change = 'lost' THEN 4 ELSE 3 END + CASE WHEN prev_position - position < 0 THEN 2 ELSE 0 END + CASE WHEN n_over > 0 THEN 1 ELSE 0 END AS score FROM latest WHERE rn = 1),
k AS (SELECT p.site_id, p.path, p.keyword, score, ROW_NUMBER() OVER (PARTITION BY p.site_id, p.path ORDER BY score DESC, is_primary DESC, p.keyword) AS rn, COUNT(*) OVER (PARTITION BY p.site_id, p.path) AS n FROM page_kw p JOIN sc ON sc.site_id = p.site_id AND sc.keyword = p.keyword),
w AS (SELECT site_id, path, DATE_TRUNC('week', timestamp) AS week, COUNT(*) AS views FROM e30 WHERE type = 'pageview' GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY week DESC) - CASE WHEN COUNT(*) OVER (PARTITION BY site_id, path) > 2 THEN 1 ELSE 0 END AS age FROM w),
t AS (SELECT site_id, path, COALESCE(MAX(CASE WHEN age = 1 THEN views END), 0) AS c, MAX(CASE WHEN age = 2 THEN views END) AS b FROM r GROUP BY 1, 2)
SELECT t.site_id, t.path, c AS current_week, k.keyword AS lead_keyword, CAST(COALESCE(score, 0) AS INTEGER) AS score, GREATEST(COALESCE(n, 0) - 1, 0) AS other_keywords
FROM t LEFT JOIN k ON k.site_id = t.site_id AND k.path = t.path AND k.rn = 1
WHERE NOT COALESCE(ABS(CASE WHEN b = 0 THEN CASE WHEN c > 0 THEN 100 ELSE 0 END ELSE (c - b) / CAST(b AS DOUBLE) * 100 END) >= 15 AND ABS(c - b) >= 20, FALSE)
-- name: R15_path_to_phrase
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN LOWER(p_name) WHEN 1 THEN LOWER(p_name) WHEN 2 THEN NULL WHEN 3 THEN LOWER(SPLIT_PART(p_name, ' ', 2)) WHEN 4 THEN NULL ELSE LOWER(p_name) || ' 7th' END AS phrase FROM part
-- name: R16_keyword_suggestions
WITH t AS (SELECT site_id, path, utm_term AS keyword, COUNT(DISTINCT user_id) AS v FROM e30 WHERE utm_term <> '' GROUP BY 1, 2, 3),
tr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY v DESC, keyword) AS rn FROM t),
ph(path, phrase) AS (VALUES ('/products', 'products'), ('/pricing', 'pricing'), ('/guides/email-templates', 'email templates')),
pg AS (SELECT DISTINCT e.site_id, e.path, phrase FROM e30 e JOIN ph USING (path)),
last_snap AS (SELECT keyword, MAX(month) AS month FROM snaps GROUP BY 1),
x AS (
  SELECT site_id, path, 1 AS st, rn AS pos, keyword, 'traffic' AS source, 'high' AS confidence, CAST(v AS VARCHAR) || ' visitor' || CASE WHEN v = 1 THEN '' ELSE 's' END || ' arrived on this search term' AS reason FROM tr WHERE rn <= 5
  UNION ALL SELECT site_id, path, 2, 1, phrase, 'path', 'medium', 'Derived from the page URL' FROM pg
  UNION ALL SELECT site_id, path, 3, 0, phrase || ' tips', 'serp', 'medium', 'A related search Google shows for this topic' FROM pg JOIN last_snap ON keyword = phrase
  UNION ALL SELECT site_id, path, 3, 1, 'best ' || phrase, 'serp', 'medium', 'A related search Google shows for this topic' FROM pg JOIN last_snap ON keyword = phrase
  UNION ALL SELECT site_id, path, 4, 0, 'What is ' || phrase || '?', 'serp', 'low', 'A question people also ask about this topic' FROM pg JOIN last_snap ON keyword = phrase WHERE EXTRACT(MONTH FROM month) % 2 = 0
), f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path, LOWER(keyword) ORDER BY st, pos) AS d FROM x WHERE NOT (site_id = 'site_a' AND path = '/blog' AND LOWER(keyword) = 'free templates')),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY st, pos) AS rk FROM f WHERE d = 1)
SELECT site_id, path, keyword, source, confidence, reason, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 8
-- name: R17_site_suggestions
WITH v AS (SELECT site_id, path, COUNT(*) AS views FROM e30 WHERE type = 'pageview' GROUP BY 1, 2),
t AS (SELECT site_id, path, utm_term AS keyword, COUNT(DISTINCT user_id) AS n FROM e30 WHERE utm_term <> '' GROUP BY 1, 2, 3),
tr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY n DESC, keyword) AS rn FROM t),
ph(path, phrase) AS (VALUES ('/products', 'products'), ('/pricing', 'pricing'), ('/guides/email-templates', 'email templates')),
x AS (SELECT site_id, path, 1 AS st, rn AS pos, keyword FROM tr WHERE rn <= 5 UNION ALL SELECT DISTINCT e.site_id, path, 2, 1, phrase FROM web_events e JOIN ph USING (path)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY st, pos) AS rk FROM x),
o AS (SELECT v.*, ROW_NUMBER() OVER (PARTITION BY site_id ORDER BY views DESC, path) AS rn FROM v WHERE path <> '/' AND NOT (site_id = 'site_a' AND path = '/blog') AND EXISTS (SELECT 1 FROM r WHERE r.site_id = v.site_id AND r.path = v.path))
SELECT o.site_id, o.path, o.views, r.keyword, CAST(r.rk AS INTEGER) AS rank FROM o JOIN r ON r.site_id = o.site_id AND r.path = o.path WHERE o.rn <= 5
-- name: R13_explain_traffic
WITH w AS (SELECT site_id, path, DATE_TRUNC('week', timestamp) AS week, COUNT(*) AS views FROM e30 WHERE type = 'pageview' GROUP BY 1, 2, 3),
wr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY week DESC) - CASE WHEN COUNT(*) OVER (PARTITION BY site_id, path) > 2 THEN 1 ELSE 0 END AS age FROM w),
wp AS (SELECT site_id, path, COALESCE(MAX(CASE WHEN age = 1 THEN views END), 0) AS c, MAX(CASE WHEN age = 2 THEN views END) AS b FROM wr GROUP BY 1, 2),
wx AS (SELECT *, CASE WHEN b = 0 THEN CASE WHEN c > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE (c - b) / CAST(b AS DOUBLE) * 100 END AS pct FROM wp),
tr AS (SELECT *, FLOOR(pct * 10 + 0.5) / 10 AS change_pct, COALESCE(ABS(pct) >= 5 AND ABS(c - b) >= 2, FALSE) AS sig,
  CASE WHEN b IS NULL THEN 'unknown' WHEN c - b < 0 THEN 'drop' WHEN c - b > 0 THEN 'spike' ELSE 'flat' END AS way FROM wx),
nw AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, keyword ORDER BY month DESC) AS rn FROM diffs),
d AS (
  SELECT nw.*, p.path, ROW_NUMBER() OVER (PARTITION BY p.site_id, p.path ORDER BY p.is_primary DESC, p.keyword) AS turn, tr.way, tr.sig,
    COALESCE('#' || CAST(prev_position AS VARCHAR), 'unranked') AS pw, COALESCE('#' || CAST(position AS VARCHAR), 'unranked') AS pn,
    CASE WHEN n_over > 0 THEN ', with ' || REPLACE(names, ', ', ' and ') || ' moving above you' ELSE '' END AS passed,
    LIST_FILTER([CASE WHEN add_snippet THEN 'a featured snippet' END, CASE WHEN add_paa THEN 'a ''People also ask'' box' END, CASE WHEN add_video THEN 'a video carousel' END], lambda v: v IS NOT NULL) AS fa,
    LIST_FILTER([CASE WHEN del_snippet THEN 'a featured snippet' END, CASE WHEN del_paa THEN 'a ''People also ask'' box' END, CASE WHEN del_video THEN 'a video carousel' END], lambda v: v IS NOT NULL) AS fr
  FROM nw JOIN page_kw p ON p.site_id = nw.site_id AND p.keyword = nw.keyword JOIN tr ON tr.site_id = p.site_id AND tr.path = p.path WHERE nw.rn = 1
), q AS (
  SELECT site_id, keyword, month, STRING_AGG('s' || CAST(host AS VARCHAR) || '.example.com', ' and ' ORDER BY slot) AS quoted FROM (
    SELECT r.site_id, c.keyword, c.month, c.host, c.slot, ROW_NUMBER() OVER (PARTITION BY r.site_id, c.keyword, c.month ORDER BY c.slot) AS rn
    FROM cites c JOIN ranks r ON r.keyword = c.keyword AND r.month = c.month AND r.own <> c.host) WHERE rn <= 2 GROUP BY 1, 2, 3
), t AS (
  SELECT d.*, q.quoted, CASE WHEN LEN(fa) <= 2 THEN ARRAY_TO_STRING(fa, ' and ') ELSE fa[1] || ', ' || fa[2] || ', and ' || fa[3] END AS fat,
    CASE WHEN LEN(fr) <= 2 THEN ARRAY_TO_STRING(fr, ' and ') ELSE fr[1] || ', ' || fr[2] || ', and ' || fr[3] END AS frt
  FROM d LEFT JOIN q ON q.site_id = d.site_id AND q.keyword = d.keyword AND q.month = d.month
), cs AS (
  SELECT site_id, path, turn, 1 AS o, 'rank_drop' AS code, 'rank slipped ' || pw || ' → ' || pn || ' on ''' || keyword || '''' || passed AS phrase FROM t WHERE position - prev_position >= 3
  UNION ALL SELECT site_id, path, turn, 2, 'page_one_exit', 'you dropped off page one for ''' || keyword || '''' || CASE WHEN position - prev_position >= 3 THEN '' ELSE passed END FROM t WHERE prev_position <= 10 AND (position IS NULL OR position > 10)
  UNION ALL SELECT site_id, path, turn, 3, 'ai_overview_displacement', CASE WHEN quoted IS NOT NULL THEN 'Google''s new AI answer box now quotes ' || quoted || ' instead of you' ELSE 'Google now shows an AI answer box for ''' || keyword || ''' and it does not quote you' END
    FROM t WHERE citation_change = 'new_overview' AND NOT is_cited
  UNION ALL SELECT site_id, path, turn, 4, 'ai_citation_lost', 'you were dropped from Google''s AI answer box for ''' || keyword || '''' FROM t WHERE citation_change = 'lost'
  UNION ALL SELECT site_id, path, turn, 5, 'serp_feature_added', 'Google added ' || fat || ' to the results for ''' || keyword || ''', pushing organic listings down' FROM t WHERE way = 'drop' AND position <= 10 AND LEN(fa) > 0
  UNION ALL SELECT site_id, path, turn, 6, 'serp_feature_removed', 'Google removed ' || frt || ' from the results for ''' || keyword || ''', lifting organic listings' FROM t WHERE way = 'spike' AND position <= 10 AND LEN(fr) > 0
  UNION ALL SELECT site_id, path, turn, 7, 'rank_gain', 'rank improved ' || pw || ' → ' || pn || ' on ''' || keyword || '''' FROM t WHERE way = 'spike' AND prev_position - position >= 3
  UNION ALL SELECT site_id, path, turn, 8, 'ai_citation_gained', 'Google''s AI answer box for ''' || keyword || ''' now quotes you' FROM t WHERE way = 'spike' AND citation_change = 'gained'
), pc AS (SELECT site_id, path, LIST(code ORDER BY turn, o) AS codes, LIST(phrase ORDER BY turn, o) AS ph FROM cs GROUP BY 1, 2),
pf AS (SELECT site_id, path, COUNT(*) AS n, BOOL_OR(prev_month >= DATE '2001-10-22') AS fresh,
  STRING_AGG(CASE WHEN prev_position IS NULL AND position IS NOT NULL THEN 'This is the first rank snapshot for ''' || keyword || ''', so there is no prior week to compare against.' END, ' ' ORDER BY turn) AS firsts FROM d GROUP BY 1, 2),
x AS (
  SELECT tr.*, COALESCE(pf.n, 0) AS n, COALESCE(pf.fresh, FALSE) AS fresh, firsts, CASE WHEN sig THEN COALESCE(codes, []) ELSE [] END AS codes, COALESCE(ph, []) AS ph,
    CAST(b AS VARCHAR) || ' → ' || CAST(c AS VARCHAR) AS vw, REGEXP_REPLACE(CAST(ABS(change_pct) AS VARCHAR), '\.0$', '') AS ap, REGEXP_REPLACE(CAST(change_pct AS VARCHAR), '\.0$', '') AS cp
  FROM tr LEFT JOIN pf ON pf.site_id = tr.site_id AND pf.path = tr.path LEFT JOIN pc ON pc.site_id = tr.site_id AND pc.path = tr.path
), y AS (
  SELECT *, 'Traffic to ' || path || CASE WHEN way = 'drop' THEN ' dropped ' ELSE ' rose ' END || ap || '% this week (' || vw || ' views).' AS head,
    CASE WHEN NOT sig THEN 'high' WHEN LEN(codes) = 0 THEN 'low' WHEN fresh THEN 'high' ELSE 'medium' END AS confidence FROM x
)
SELECT site_id, path, confidence, CASE WHEN sig AND LEN(codes) = 0 THEN 'unexplained_by_serp' ELSE ARRAY_TO_STRING(codes, ',') END AS cause_codes,
  CASE WHEN b IS NULL THEN 'Not enough weekly history for ' || path || ' to compare week over week yet (30d window).'
    WHEN NOT sig THEN 'Traffic to ' || path || ' held roughly steady this week (' || vw || ' views, ' || CASE WHEN change_pct >= 0 THEN '+' ELSE '' END || cp || '%). No significant change to explain.'
    WHEN LEN(codes) = 0 THEN head || ' Search position and AI answer status are unchanged' || CASE WHEN n > 0 THEN ' across ' || CAST(n AS VARCHAR) || ' tracked keyword' || CASE WHEN n = 1 THEN '' ELSE 's' END ELSE '' END ||
      ', so the cause is probably not search — check referrers, campaigns, or a recent deploy.'
    ELSE head || ' Likely cause: ' || CASE WHEN LEN(ph) <= 2 THEN ARRAY_TO_STRING(ph, ' and ') ELSE ARRAY_TO_STRING(ph[1:LEN(ph) - 1], ', ') || ', and ' || ph[LEN(ph)] END || '.' END AS explanation,
  CONCAT_WS(' ', CASE WHEN NOT EXISTS (SELECT 1 FROM page_kw k WHERE k.site_id = y.site_id AND k.path = y.path) THEN 'No target keywords are mapped to ' || path || '. Map one to get a search-side explanation.' END,
    CASE WHEN sig THEN firsts END, CASE WHEN confidence = 'medium' THEN 'The previous SERP snapshot is more than 14 days old, so the rank change may not line up exactly with this week.' END) AS caveats
FROM y
-- name: R12_next_step
WITH w AS (SELECT site_id, path, DATE_TRUNC('week', timestamp) AS week, COUNT(*) AS views FROM e30 WHERE type = 'pageview' GROUP BY 1, 2, 3),
wr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY week DESC) - CASE WHEN COUNT(*) OVER (PARTITION BY site_id, path) > 2 THEN 1 ELSE 0 END AS age FROM w),
wp AS (SELECT site_id, path, COALESCE(MAX(CASE WHEN age = 1 THEN views END), 0) AS c, MAX(CASE WHEN age = 2 THEN views END) AS b FROM wr GROUP BY 1, 2),
wx AS (SELECT *, CASE WHEN b = 0 THEN CASE WHEN c > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE (c - b) / CAST(b AS DOUBLE) * 100 END AS pct FROM wp),
tr AS (SELECT *, FLOOR(pct * 10 + 0.5) / 10 AS change_pct, COALESCE(ABS(pct) >= 5 AND ABS(c - b) >= 2, FALSE) AS sig,
  CASE WHEN b IS NULL THEN 'unknown' WHEN c - b < 0 THEN 'drop' WHEN c - b > 0 THEN 'spike' ELSE 'flat' END AS way FROM wx),
nw AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, keyword ORDER BY month DESC) AS rn FROM diffs),
d AS (
  SELECT nw.*, p.path, ROW_NUMBER() OVER (PARTITION BY p.site_id, p.path ORDER BY p.is_primary DESC, p.keyword) AS turn, tr.way, tr.sig,
    COALESCE('#' || CAST(prev_position AS VARCHAR), 'unranked') AS pw, COALESCE('#' || CAST(position AS VARCHAR), 'unranked') AS pn,
    CASE WHEN n_over > 0 THEN ', with ' || REPLACE(names, ', ', ' and ') || ' moving above you' ELSE '' END AS passed,
    LIST_FILTER([CASE WHEN add_snippet THEN 'a featured snippet' END, CASE WHEN add_paa THEN 'a ''People also ask'' box' END, CASE WHEN add_video THEN 'a video carousel' END], lambda v: v IS NOT NULL) AS fa,
    LIST_FILTER([CASE WHEN del_snippet THEN 'a featured snippet' END, CASE WHEN del_paa THEN 'a ''People also ask'' box' END, CASE WHEN del_video THEN 'a video carousel' END], lambda v: v IS NOT NULL) AS fr
  FROM nw JOIN page_kw p ON p.site_id = nw.site_id AND p.keyword = nw.keyword JOIN tr ON tr.site_id = p.site_id AND tr.path = p.path WHERE nw.rn = 1
), q AS (
  SELECT site_id, keyword, month, STRING_AGG('s' || CAST(host AS VARCHAR) || '.example.com', ' and ' ORDER BY slot) AS quoted FROM (
    SELECT r.site_id, c.keyword, c.month, c.host, c.slot, ROW_NUMBER() OVER (PARTITION BY r.site_id, c.keyword, c.month ORDER BY c.slot) AS rn
    FROM cites c JOIN ranks r ON r.keyword = c.keyword AND r.month = c.month AND r.own <> c.host) WHERE rn <= 2 GROUP BY 1, 2, 3
), t AS (
  SELECT d.*, q.quoted, CASE WHEN LEN(fa) <= 2 THEN ARRAY_TO_STRING(fa, ' and ') ELSE fa[1] || ', ' || fa[2] || ', and ' || fa[3] END AS fat,
    CASE WHEN LEN(fr) <= 2 THEN ARRAY_TO_STRING(fr, ' and ') ELSE fr[1] || ', ' || fr[2] || ', and ' || fr[3] END AS frt
  FROM d LEFT JOIN q ON q.site_id = d.site_id AND q.keyword = d.keyword AND q.month = d.month
), cs AS (
  SELECT site_id, path, turn, 1 AS o, 'rank_drop' AS code, 'rank slipped ' || pw || ' → ' || pn || ' on ''' || keyword || '''' || passed AS phrase FROM t WHERE position - prev_position >= 3
  UNION ALL SELECT site_id, path, turn, 2, 'page_one_exit', 'you dropped off page one for ''' || keyword || '''' || CASE WHEN position - prev_position >= 3 THEN '' ELSE passed END FROM t WHERE prev_position <= 10 AND (position IS NULL OR position > 10)
  UNION ALL SELECT site_id, path, turn, 3, 'ai_overview_displacement', CASE WHEN quoted IS NOT NULL THEN 'Google''s new AI answer box now quotes ' || quoted || ' instead of you' ELSE 'Google now shows an AI answer box for ''' || keyword || ''' and it does not quote you' END
    FROM t WHERE citation_change = 'new_overview' AND NOT is_cited
  UNION ALL SELECT site_id, path, turn, 4, 'ai_citation_lost', 'you were dropped from Google''s AI answer box for ''' || keyword || '''' FROM t WHERE citation_change = 'lost'
  UNION ALL SELECT site_id, path, turn, 5, 'serp_feature_added', 'Google added ' || fat || ' to the results for ''' || keyword || ''', pushing organic listings down' FROM t WHERE way = 'drop' AND position <= 10 AND LEN(fa) > 0
  UNION ALL SELECT site_id, path, turn, 6, 'serp_feature_removed', 'Google removed ' || frt || ' from the results for ''' || keyword || ''', lifting organic listings' FROM t WHERE way = 'spike' AND position <= 10 AND LEN(fr) > 0
  UNION ALL SELECT site_id, path, turn, 7, 'rank_gain', 'rank improved ' || pw || ' → ' || pn || ' on ''' || keyword || '''' FROM t WHERE way = 'spike' AND prev_position - position >= 3
  UNION ALL SELECT site_id, path, turn, 8, 'ai_citation_gained', 'Google''s AI answer box for ''' || keyword || ''' now quotes you' FROM t WHERE way = 'spike' AND citation_change = 'gained'
), pc AS (SELECT site_id, path, LIST(code ORDER BY turn, o) AS codes, LIST(phrase ORDER BY turn, o) AS ph FROM cs GROUP BY 1, 2),
pf AS (SELECT site_id, path, COUNT(*) AS n, BOOL_OR(prev_month >= DATE '2001-10-22') AS fresh,
  STRING_AGG(CASE WHEN prev_position IS NULL AND position IS NOT NULL THEN 'This is the first rank snapshot for ''' || keyword || ''', so there is no prior week to compare against.' END, ' ' ORDER BY turn) AS firsts FROM d GROUP BY 1, 2),
lo AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY turn) AS ln FROM d WHERE prev_position - position < 0 OR citation_change IN ('lost', 'new_overview')),
rv AS (
  SELECT l.site_id, l.path, s.host, s.slot, EXISTS (SELECT 1 FROM cites c WHERE c.keyword = l.keyword AND c.month = l.month AND c.host = s.host AND s.host <> l.own) AS cited,
    EXISTS (SELECT 1 FROM over_rows o WHERE o.site_id = l.site_id AND o.keyword = l.keyword AND o.month = l.month AND o.host = s.host AND o.rn <= 3) AS beat
  FROM lo l JOIN slots s ON s.keyword = l.keyword AND s.month = l.month AND (l.position IS NULL OR s.slot < l.position) WHERE l.ln = 1
), rb AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY site_id, path ORDER BY CASE WHEN cited AND beat THEN 1 WHEN beat THEN 2 WHEN cited THEN 3 ELSE 4 END, slot) AS bn FROM rv),
af AS (SELECT site_id, path, BOOL_OR(add_snippet OR add_paa) AS qa, BOOL_OR(add_video) AS vid FROM d WHERE way = 'drop' AND position <= 10 GROUP BY 1, 2),
x AS (
  SELECT tr.site_id, tr.path, tr.sig, tr.way, COALESCE(codes, []) AS codes, lo.path IS NOT NULL AS has_loser, 's' || CAST(rb.host AS VARCHAR) || '.example.com' AS dom, rb.slot, rb.cited, rb.beat, qa, vid
  FROM tr LEFT JOIN pc ON pc.site_id = tr.site_id AND pc.path = tr.path LEFT JOIN lo ON lo.site_id = tr.site_id AND lo.path = tr.path AND lo.ln = 1
  LEFT JOIN rb ON rb.site_id = tr.site_id AND rb.path = tr.path AND rb.bn = 1 LEFT JOIN af ON af.site_id = tr.site_id AND af.path = tr.path
), y AS (
  SELECT *, CASE WHEN NOT sig THEN NULL WHEN LEN(codes) = 0 THEN 'look_beyond_search' WHEN way = 'spike' THEN 'reinforce' WHEN NOT has_loser AND LIST_CONTAINS(codes, 'serp_feature_added') THEN 'target_feature'
    WHEN dom IS NOT NULL THEN 'study_rival' END AS next_action FROM x
)
SELECT site_id, path, next_action, CASE next_action
  WHEN 'look_beyond_search' THEN 'Search looks unchanged, so check referrers, campaigns, and recent deploys before spending time on SEO.'
  WHEN 'reinforce' THEN 'Whatever changed here is working — consider applying the same approach to similar pages.'
  WHEN 'target_feature' THEN CASE WHEN qa THEN 'Answer the searcher''s question in a short paragraph or list near the top of the page — that is what Google lifts into snippets and ''People also ask''.'
    WHEN vid THEN 'Google is now favouring video for this search — a short video on the page can win a spot in the carousel.'
    ELSE 'Your position held but the results page got busier, so expect fewer clicks at the same rank. Title and description are what earn the click now.' END
  WHEN 'study_rival' THEN CASE WHEN LIST_CONTAINS(codes, 'ai_overview_displacement') OR LIST_CONTAINS(codes, 'ai_citation_lost')
    THEN 'Compare your page against ' || dom || ', which now ranks #' || CAST(slot AS VARCHAR) || CASE WHEN cited THEN ' and is quoted in Google''s AI answer' ELSE '' END || ' — AI answers tend to quote pages that address the question directly and early.'
    ELSE 'Compare your page against ' || dom || ', which ' || CASE WHEN beat THEN 'moved above you and ' ELSE '' END || 'now ranks #' || CAST(slot AS VARCHAR) || ' for this term.' END END AS next_text
FROM y
