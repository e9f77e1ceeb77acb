"""Batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs as j
from .base import query

c = F.col


def events(v):
    return v("v_log").select(c("job_id").cast("string").alias("key"), "ts", "id")


@query("SELECT id, date_trunc('hour', ts) AS window_start, row_number() OVER (PARTITION BY job_id, date_trunc('hour', ts) ORDER BY ts, id) <= 8 AS allowed FROM {v_log}")
def rate_fixed_window(v):
    return j.rate_fixed(events(v), 8).select("id", "window_start", "allowed")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE allowed) AS n_allowed FROM (SELECT row_number() OVER (PARTITION BY job_id, date_trunc('day', ts) ORDER BY ts, id) <= 2 AS allowed FROM {v_log}) t")
def rate_fixed_day(v):
    return j.rate_fixed(events(v), 2, "1 day").agg(F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed"))


@query("""WITH RECURSIVE e AS (SELECT CAST(job_id AS VARCHAR) AS key, ts, id FROM (SELECT event_id AS id, user_id AS job_id, ts FROM events) l),
    w AS (SELECT key, min(ts) AS opened FROM e GROUP BY key UNION ALL SELECT w.key, min(e.ts) AS opened FROM w JOIN e ON e.key = w.key AND e.ts >= w.opened + INTERVAL 86400 SECOND GROUP BY w.key, w.opened)
    SELECT key, id, row_number() OVER (PARTITION BY key, opened ORDER BY ts, id) <= 8 AS allowed FROM (SELECT e.key, e.id, e.ts, w.opened FROM e ASOF JOIN w ON e.key = w.key AND e.ts >= w.opened) t""")
def rate_anchored_window(v):
    return j.rate_anchored(events(v), 8, 86400.0).select("key", "id", "allowed")


@query("SELECT id FROM (SELECT id, value_class, lag(value_class) OVER (PARTITION BY job_id ORDER BY ts, id) AS before FROM (SELECT id, job_id, ts, level AS value_class FROM {v_log}) e) t WHERE value_class IS DISTINCT FROM before")
def changed_page_events(v):
    rows = v("v_log").select(c("job_id").cast("string").alias("url"), "ts", c("level").alias("hash"), "id")
    return j.page_changes(rows).select("id")


@query("SELECT job_id, date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) FILTER (WHERE level = 'error') AS n_errors FROM {v_log} GROUP BY 1, 2")
def crawl_counter_windows(v):
    return j.crawl_counter_stream(v("v_log"))


@query("SELECT job_id, id, before, ts, CAST(floor((epoch_us(ts) - epoch_us(before)) / 60000000.0) AS BIGINT) AS gap_minutes FROM (SELECT *, lag(ts) OVER (PARTITION BY job_id ORDER BY ts, id) AS before FROM {v_log}) t WHERE epoch_us(ts) - epoch_us(before) >= 1800000000")
def heartbeat_gaps(v):
    return j.heartbeat_gaps(v("v_log"))


@query("SELECT job_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY ts, id) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY job_id ORDER BY ts, id)) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM {v_log}) a) b GROUP BY job_id, s")
def heartbeat_sessions(v):
    return j.heartbeat_sessions(v("v_log"))
