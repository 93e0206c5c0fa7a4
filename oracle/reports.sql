-- name: A59_dashboard_all
SELECT * FROM (
  WITH e30 AS (SELECT * FROM web_events WHERE timestamp >= TIMESTAMP '2024-01-24' AND timestamp <= TIMESTAMP '2024-01-31'),
  s30 AS (SELECT * FROM web_sessions WHERE started_at >= TIMESTAMP '2024-01-24' AND started_at <= TIMESTAMP '2024-01-31')
  SELECT site_id, 'traffic' AS report, date AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A01_traffic_over_time}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (visitors, sessions, pageviews))
  UNION ALL
  SELECT site_id, 'pageviews' AS report, date AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A04_pageviews_over_time}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (pageviews))
  UNION ALL
  SELECT site_id, 'top_pages' AS report, path AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A05_top_pages | rn <= 5 => rn <= 10}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (views, unique_visitors, share))
  UNION ALL
  SELECT site_id, 'sources' AS report, source AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A09_traffic_sources}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (visitors, percentage))
  UNION ALL
  SELECT site_id, 'devices' AS report, device AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A10_devices}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (visitors, percentage))
  UNION ALL
  SELECT site_id, 'countries' AS report, code || ' | ' || country AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A11_countries}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (visitors, percentage))
  UNION ALL
  SELECT site_id, 'sessions' AS report, bucket AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A14_session_duration_buckets}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (bucket_order, sessions, percentage))
  UNION ALL
  SELECT site_id, 'kpi' AS report, avg_session_duration || ' | ' || pages_per_session AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A15_kpi_summary}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (total_visitors, total_pageviews, total_sessions, bounce_rate, visitors_trend, pageviews_trend, bounce_rate_trend, session_trend))
  UNION ALL
  SELECT site_id, 'funnel' AS report, step AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A17_funnel}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (step_no, visitors, percentage, drop_off))
  UNION ALL
  SELECT site_id, 'realtime' AS report, dimension || ' | ' || label AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A18_realtime_summary | 2024-01-20 11:00:00 => 2024-01-30 23:55:00 | 2024-01-20 12:00:00 => 2024-01-31 00:00:00}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (visitors))
)
-- name: A60b_every_report_source
SELECT * FROM (
  WITH e30 AS (SELECT * FROM web_events WHERE timestamp >= TIMESTAMP '2024-01-24' AND timestamp <= TIMESTAMP '2024-01-31'),
  s30 AS (SELECT * FROM web_sessions WHERE started_at >= TIMESTAMP '2024-01-24' AND started_at <= TIMESTAMP '2024-01-31')
  SELECT * FROM {{A59_dashboard_all}} WHERE report IN ('traffic', 'sources', 'devices', 'sessions', 'kpi')
  UNION ALL
  SELECT site_id, 'top_pages' AS report, path AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A05_top_pages | rn <= 5 => rn <= 20}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (views, unique_visitors, share))
  UNION ALL
  SELECT site_id, 'countries' AS report, code || ' | ' || country AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A11_countries | rn <= 10 => rn <= 15}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (visitors, percentage))
  UNION ALL
  SELECT site_id, 'referrers' AS report, source AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A09_traffic_sources}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (visitors, percentage))
  UNION ALL
  SELECT site_id, 'utm' AS report, campaign || ' | ' || medium || ' | ' || source AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A20_utm_campaigns}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (visitors, pageviews, percentage))
  UNION ALL
  SELECT site_id, 'entry_pages' AS report, page AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A38_entry_pages | rn <= 5 => rn <= 20}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (entries, unique_users, bounce_rate, avg_session_duration, percentage))
  UNION ALL
  SELECT site_id, 'exit_pages' AS report, page AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A37_exit_pages | rn <= 5 => rn <= 20}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (exits, unique_users, avg_session_duration, percentage))
  UNION ALL
  SELECT site_id, 'browsers' AS report, browser AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A10b_browsers}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (visitors, percentage))
  UNION ALL
  SELECT site_id, 'os' AS report, os AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A10c_operating_systems}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (visitors, percentage))
  UNION ALL
  SELECT site_id, 'bounce_rate' AS report, date AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A02_bounce_rate_trend}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (bounce_rate))
  UNION ALL
  SELECT site_id, 'avg_session' AS report, date AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A03_avg_session_trend}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (avg_duration))
  UNION ALL
  SELECT site_id, 'conversions' AS report, goal_id || ' | ' || goal_name || ' | ' || type AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A30_goal_conversions}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (conversions, total_events, conversion_rate))
  UNION ALL
  SELECT site_id, 'new_vs_returning' AS report, date AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A34_new_vs_returning}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (new_visitors, returning_visitors, total_sessions))
  UNION ALL
  SELECT site_id, 'revenue' AS report, date AS item, metric, CAST(value AS DOUBLE) AS value FROM {{A36b_revenue_daily}}
    UNPIVOT INCLUDE NULLS (value FOR metric IN (purchases, revenue))
  UNION ALL
  SELECT site_id, 'web_vitals' AS report, vital || ' | ' || rating AS item, metric, CAST(value AS DOUBLE) AS value
  FROM (SELECT * RENAME (metric AS vital) FROM {{A54_web_vitals_overview}})
    UNPIVOT INCLUDE NULLS (value FOR metric IN (avg_value, p75_value, samples))
)
