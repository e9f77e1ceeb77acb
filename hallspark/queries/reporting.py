"""Reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as r
from .base import cents, pct, query, rnd
from .matching import SCORED, scored

c = F.col
HC = "{v_hall} d JOIN {v_college} k ON d.college_id = k.id"


@query(f"SELECT college_id, {cents('avg(yearly_cost)')} AS avg_cost, count(yearly_cost) AS n_costs FROM {{v_dorm}} WHERE is_active AND assignable AND granular AND status <> 'QUARANTINED' GROUP BY college_id")
def college_avg_cost_published(v):
    return r.college_avg_cost(v("v_dorm"), "published")


@query(f"SELECT state, count(*) AS n_halls, coalesce({cents('avg(CASE WHEN yearly_cost <> 0 THEN yearly_cost END)')}, 0e0) AS avg_cost, {pct('count(*) FILTER (WHERE has_ac)')} AS pct_ac, {pct('''count(*) FILTER (WHERE bathroom_style = 'SUITE')''')} AS pct_suite, {pct('count(*) FILTER (WHERE freshman AND NOT coalesce(upperclass, false))')} AS pct_freshman_only FROM {HC} GROUP BY state")
def state_stats(v):
    return r.state_stats(v("v_hall"), v("v_college"))


@query(f"SELECT count(*) AS n_halls, {pct('count(*) FILTER (WHERE has_ac)')} AS pct_ac, {pct('''count(*) FILTER (WHERE bathroom_style = 'SUITE')''')} AS pct_suite, {pct('count(*) FILTER (WHERE freshman)')} AS pct_freshman, {cents('avg(yearly_cost)')} AS avg_cost FROM {{v_hall}}")
def national_totals(v):
    return r.national_totals(v("v_hall"))


@query(f"SELECT school_type, count(yearly_cost) AS n, {cents('avg(yearly_cost)')} AS avg_cost FROM {HC} GROUP BY school_type")
def cost_by_school_type(v):
    return r.cost_by_school_type(v("v_hall"), v("v_college"))


@query("SELECT l.label, count(d.id) AS n FROM (VALUES ('PRIVATE'), ('SUITE'), ('SEMI_PRIVATE'), ('COMMUNAL'), ('UNKNOWN')) l(label) LEFT JOIN {v_dorm} d ON d.bathroom_style = l.label GROUP BY l.label")
def bathroom_distribution(v):
    return r.bathroom_distribution(v("v_dorm"))


@query("SELECT room_type, count(*) AS n FROM {v_room} GROUP BY room_type ORDER BY n DESC, room_type LIMIT 8")
def room_type_top8(v):
    return r.room_type_top(v("v_room"))


@query(f"SELECT CAST(floor(overall_score / 20e0) * 20 AS INTEGER) AS low, count(*) AS n FROM ({SCORED}) s WHERE overall_score >= 0 AND overall_score < 100 GROUP BY 1")
def score_histogram(v):
    return r.score_histogram(scored(v))


@query("SELECT college_id, count(*) FILTER (WHERE coalesce(yearly_cost, 0) < 12000) AS under_12k, count(*) FILTER (WHERE yearly_cost >= 12000 AND yearly_cost < 15000) AS from_12k, count(*) FILTER (WHERE yearly_cost >= 15000 AND yearly_cost < 18000) AS from_15k, count(*) FILTER (WHERE yearly_cost >= 18000) AS from_18k FROM {v_dorm} GROUP BY college_id")
def cost_ranges(v):
    return r.cost_ranges(v("v_dorm"))


@query(f"SELECT (SELECT count(*) FROM {{v_college}}) AS n_colleges, (SELECT count(DISTINCT state) FROM {{v_college}}) AS n_states, count(*) AS n_halls, {rnd('avg(confidence) * 100')} AS avg_confidence, (SELECT count(*) FROM {{v_source}} WHERE is_approved) AS n_sources FROM {{v_dorm}} WHERE is_active AND assignable AND granular AND status <> 'QUARANTINED'")
def site_stats(v):
    return r.site_stats(v("v_college"), v("v_dorm"), v("v_source"))


@query(f"SELECT coverage_status, count(*) AS n, {rnd('count(*) * 1000e0 / sum(count(*)) OVER ()')} / 10e0 AS pct FROM {{v_college}} GROUP BY coverage_status")
def coverage_breakdown(v):
    return r.coverage_breakdown(v("v_college"))


@query("SELECT state, count(*) AS n FROM {v_college} GROUP BY state ORDER BY n DESC, state LIMIT 10")
def top_states(v):
    return r.top_states(v("v_college"))


@query("""SELECT count(*) AS n_colleges, count(ipeds_id) AS n_ipeds, count(*) FILTER (WHERE housing_url <> '') AS n_housing_url, count(*) FILTER (WHERE has_housing) AS n_flagged, count(*) FILTER (WHERE NOT has_housing) AS n_no_housing,
    count(*) FILTER (WHERE id IN (SELECT college_id FROM {v_dorm})) AS n_with_halls, (SELECT count(*) FROM {v_dorm}) AS n_halls, (SELECT count(*) FROM {v_dorm} WHERE assignable) AS n_assignable,
    (SELECT count(*) FROM {v_dorm} WHERE id IN (SELECT parent_id FROM {v_dorm})) AS n_parents, (SELECT count(parent_id) FROM {v_dorm}) AS n_children, (SELECT count(*) FROM {v_dorm} WHERE id IN (SELECT dorm_id FROM {v_dorm_source})) AS n_sourced FROM {v_college}""")
def coverage_counters(v):
    return r.coverage_counters(v("v_college"), v("v_dorm"), v("v_dorm_source"))


@query(f"""SELECT count(*) AS n_halls, {rnd('avg(confidence) * 100')} AS avg_confidence, {rnd('avg(completeness) * 100')} AS avg_completeness, count(*) FILTER (WHERE yearly_cost IS NULL) AS n_missing_cost, count(*) FILTER (WHERE amenity_count IS NULL) AS n_missing_amenities, count(*) FILTER (WHERE age_days > 180) AS n_stale,
    (SELECT count(*) FROM {{v_job}}) AS n_jobs, (SELECT count(*) FROM {{v_job}} WHERE status = 'FAILED') AS n_failed, (SELECT {pct('''count(*) FILTER (WHERE status = 'COMPLETED')''')} FROM {{v_job}}) AS pct_success FROM {{v_hall}}""")
def admin_overview(v):
    return r.admin_overview(v("v_dorm"), v("v_job"), v("v_amenity"))


@query(f"""SELECT (SELECT count(*) FROM {{v_college}}) AS n_colleges, (SELECT {pct('''count(*) FILTER (WHERE housing_url <> '')''')} FROM {{v_college}}) AS pct_housing_url, (SELECT {pct('''count(*) FILTER (WHERE coverage_status = 'COMPLETE')''')} FROM {{v_college}}) AS pct_complete,
    count(*) AS n_halls, {pct('count(yearly_cost)')} AS pct_cost, {pct('count(has_ac)')} AS pct_ac_known, {pct('''count(*) FILTER (WHERE bathroom_style <> 'UNKNOWN')''')} AS pct_bathroom FROM {{v_dorm}}""")
def coverage_dashboard(v):
    return r.coverage_dashboard(v("v_college"), v("v_dorm"))


@query(f"SELECT college_id, state, count(*) AS n_halls, count(*) FILTER (WHERE yearly_cost IS NULL) AS missing_cost, count(*) FILTER (WHERE amenity_count IS NULL) AS missing_amenities, count(*) FILTER (WHERE confidence < 0.6e0) AS low_confidence, count(*) FILTER (WHERE status = 'DUPLICATE') AS duplicates, count(*) FILTER (WHERE age_days > 180) AS stale, floor(avg(completeness) * 1e6 + 0.5e0) / 1e6 AS avg_completeness FROM {HC} GROUP BY GROUPING SETS ((college_id), (state))")
def quality_report_rollup(v):
    return r.quality_report(v("v_hall"), v("v_college"))


@query(f"SELECT count(*) AS n_halls, count(*) FILTER (WHERE is_active) AS n_active, count(*) FILTER (WHERE status = 'QUARANTINED') AS n_quarantined, count(*) FILTER (WHERE scoreable) AS n_scoreable, " + ", ".join(f"(SELECT count(*) FROM {{v_college}} WHERE coverage_status = '{k}') AS n_{k.lower()}" for k in ("COMPLETE", "PARTIAL", "BLOCKED")) + f" FROM ({SCORED}) s")
def pipeline_metrics(v):
    return r.pipeline_metrics(scored(v), v("v_college"))


@query("SELECT id, name, state FROM {v_college} WHERE coverage_status = 'BLOCKED'")
def blocked_institutions(v):
    return r.blocked_colleges(v("v_college"))


@query("SELECT status, count(*) AS n FROM {v_checkpoint} GROUP BY status")
def checkpoint_counts(v):
    return r.checkpoint_counts(v("v_checkpoint"))


@query(f"SELECT k.id, k.name, latitude, longitude, count(d.id) AS n_halls, {cents('avg(CASE WHEN is_active THEN yearly_cost END)')} AS avg_cost FROM {{v_college}} k LEFT JOIN {{v_dorm}} d ON d.college_id = k.id WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY k.id, k.name, latitude, longitude ORDER BY k.name, k.id LIMIT 2000")
def map_pins(v):
    return r.map_pins(v("v_college"), v("v_dorm"))


EVIDENCE = """SELECT k.id AS college_id, coverage_status, (SELECT count(*) FROM {v_source} s WHERE s.college_id = k.id AND page_role LIKE '%housing_directory%') AS directories, (SELECT count(*) FROM {v_dorm} d WHERE d.college_id = k.id AND is_active AND status = 'ACTIVE') AS active,
    coalesce(p.metadata LIKE '%directoryExhausted":true%', false) AS exhausted, p.candidate_urls > 5 AND NOT coalesce(p.metadata LIKE '%directoryExhausted":true%', false) AS unresolved, inventory_days IS NOT NULL AS inventory_success FROM {v_college} k JOIN {v_checkpoint} p ON p.college_id = k.id"""


@query(EVIDENCE)
def coverage_evidence(v):
    return r.coverage_evidence(v("v_college"), v("v_source"), v("v_checkpoint"), v("v_dorm"))


@query(f"SELECT * FROM (SELECT college_id, 'PARTIAL' AS new_status, concat_ws(',', CASE WHEN directories = 0 THEN 'directory_page_role' END, CASE WHEN NOT exhausted THEN 'directory_not_exhausted' END, CASE WHEN NOT inventory_success THEN 'inventory_success' END, CASE WHEN active = 0 THEN 'no_active_entities' END, CASE WHEN unresolved THEN 'unresolved_frontier' END) AS missing FROM ({EVIDENCE}) e WHERE coverage_status = 'COMPLETE') m WHERE missing <> ''")
def coverage_recompute(v):
    return r.recompute_coverage(r.coverage_evidence(v("v_college"), v("v_source"), v("v_checkpoint"), v("v_dorm")))


COUNTERS = "SELECT id AS job_id, CASE WHEN id % 13 = 0 THEN false WHEN id % 13 = 1 THEN NULL ELSE true END AS has_housing, id % 17 = 0 AS blocked, CAST(id % 4 AS INTEGER) AS n_unique, CAST(id % 3 AS INTEGER) AS n_created, CAST((id + 1) % 3 AS INTEGER) AS n_updated, id % 2 = 0 AS site_found, CAST(id % 3 AS INTEGER) AS directory_sources, id % 5 > 1 AS directory_parsed, CAST(id % 2 AS INTEGER) AS directory_pages, CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id % 5 AS INTEGER) END AS published, CASE WHEN id % 7 = 0 THEN 2 ELSE 0 END AS unresolved_housing_links, CASE WHEN id % 8 = 0 THEN 1 END AS unresolved_directory_links, id % 11 = 0 AS hit_budget FROM {v_job}"


def counters(v):
    k = c("id")
    i = lambda e: e.cast("int")
    return v("v_job").select(
        k.alias("job_id"), F.when(k % 13 == 0, False).when(k % 13 == 1, None).otherwise(True).alias("has_housing"), (k % 17 == 0).alias("blocked"), i(k % 4).alias("n_unique"), i(k % 3).alias("n_created"), i((k + 1) % 3).alias("n_updated"), (k % 2 == 0).alias("site_found"), i(k % 3).alias("directory_sources"),
        (k % 5 > 1).alias("directory_parsed"), i(k % 2).alias("directory_pages"), F.when(k % 6 != 0, i(k % 5)).alias("published"), F.when(k % 7 == 0, 2).otherwise(0).alias("unresolved_housing_links"), F.when(k % 8 == 0, 1).alias("unresolved_directory_links"), (k % 11 == 0).alias("hit_budget"),
    )


DECIDED = f"""SELECT job_id, CASE WHEN NOT has_housing THEN 'NO_HOUSING' WHEN blocked THEN 'BLOCKED' WHEN n_unique = 0 AND n_created + n_updated = 0 THEN CASE WHEN site_found OR directory_sources > 0 THEN 'SITE_FOUND' ELSE 'RETRYABLE' END
    WHEN n_unique = 0 AND directory_sources > 0 AND NOT directory_parsed THEN 'DIRECTORY_PENDING'
    WHEN directory_parsed AND directory_sources >= 1 AND NOT coalesce(unresolved_directory_links, unresolved_housing_links) > 0 AND NOT hit_budget AND n_unique >= 1 AND ((published > 0 AND abs(n_unique - published) / CAST(published AS DOUBLE) <= 0.2e0) OR (published IS NULL AND directory_pages >= 1)) THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage FROM ({COUNTERS}) x"""


@query(DECIDED)
def coverage_decision(v):
    return r.decide_coverage(counters(v)).select("job_id", "coverage")


@query("SELECT job_id, count(*) AS n, count(*) FILTER (WHERE level = 'error') AS n_errors, count(DISTINCT level) AS n_levels, max(ts) AS last_ts FROM {v_log} GROUP BY job_id")
def crawl_counters(v):
    return r.crawl_counters(v("v_log"))


#: A crawl of stored pages: their roles and ages give status and change; the halls that a page names are its candidates; pages not approved are left to visit.
CRAWLED = "SELECT college_id, CASE age_days % 10 WHEN 0 THEN 403 WHEN 1 THEN 500 ELSE 200 END AS status, age_days % 4 = 0 AS unchanged, page_role = 'housing_directory' AS directory, page_role = 'detail' AS detail, page_role IS NOT NULL AS housing FROM {v_source}"
NAMED = "SELECT d.college_id, d.is_active AS accepted, CASE WHEN d.status <> 'REVIEW' THEN d.id END AS entity_id, d.is_verified AS created FROM {v_dorm_source} s JOIN {v_dorm} d ON d.id = s.dorm_id"
LEFT = "SELECT college_id, 30 + age_days % 30 AS priority FROM {v_source} WHERE NOT is_approved"


def run_counts(key: str) -> str:
    """The counters of each grain apart, joined by ``key``."""
    w = lambda k: f"CAST(count(*) FILTER (WHERE {k}) AS BIGINT)"
    f = "status BETWEEN 200 AND 299"
    return f"""SELECT k.college_id, coalesce(n_visited, 0) AS n_visited, coalesce(n_fetched, 0) AS n_fetched, coalesce(n_restricted, 0) AS n_restricted, coalesce(n_unchanged, 0) AS n_unchanged, coalesce(n_directory, 0) AS n_directory, coalesce(n_detail, 0) AS n_detail, coalesce(n_housing, 0) AS n_housing,
            coalesce(n_accepted, 0) AS n_accepted, coalesce(n_rejected, 0) AS n_rejected, coalesce(n_created, 0) AS n_created, coalesce(n_updated, 0) AS n_updated, coalesce(n_unique, 0) AS n_unique, coalesce(n_accepted, 0) - coalesce(n_unique, 0) AS n_duplicates, coalesce(n_left, 0) AS n_left, coalesce(n_unresolved, 0) AS n_unresolved,
            coalesce(n_fetched, 0) = 0 AND coalesce(n_restricted, 0) > 0 AND coalesce(n_unique, 0) = 0 AS blocked, coalesce(n_visited, 0) >= 2 AND coalesce(n_left, 0) > 0 AS hit_budget
        FROM (SELECT {key} AS college_id FROM ({CRAWLED}) p UNION SELECT {key} FROM ({NAMED}) q UNION SELECT {key} FROM ({LEFT}) r) k
        LEFT JOIN (SELECT {key} AS k1, count(*) AS n_visited, {w(f)} AS n_fetched, {w("status IN (401, 403)")} AS n_restricted, {w(f + " AND unchanged")} AS n_unchanged, {w(f + " AND directory")} AS n_directory, {w(f + " AND detail")} AS n_detail, {w(f + " AND housing")} AS n_housing FROM ({CRAWLED}) p GROUP BY 1) p ON k1 IS NOT DISTINCT FROM k.college_id
        LEFT JOIN (SELECT {key} AS k2, {w("accepted")} AS n_accepted, {w("NOT accepted")} AS n_rejected, {w("accepted AND created AND entity_id IS NOT NULL")} AS n_created, {w("accepted AND NOT created AND entity_id IS NOT NULL")} AS n_updated, count(DISTINCT CASE WHEN accepted THEN entity_id END) AS n_unique FROM ({NAMED}) q GROUP BY 1) q ON k2 IS NOT DISTINCT FROM k.college_id
        LEFT JOIN (SELECT {key} AS k3, count(*) AS n_left, {w("priority >= 40")} AS n_unresolved FROM ({LEFT}) r GROUP BY 1) r ON k3 IS NOT DISTINCT FROM k.college_id"""


def run_counters(v):
    age = c("age_days")
    pages = v("v_source").select("college_id", F.when(age % 10 == 0, 403).when(age % 10 == 1, 500).otherwise(200).alias("status"), (age % 4 == 0).alias("unchanged"), F.array(F.when(c("page_role") == "detail", "housing_detail").otherwise(c("page_role"))).alias("roles"), c("page_role").isNotNull().alias("housing"))
    halls = v("v_dorm").select(c("id").alias("dorm_id"), "college_id", c("is_active").alias("accepted"), F.when(c("status") != "REVIEW", c("id")).alias("entity_id"), c("is_verified").alias("created"))
    left = v("v_source").where("NOT is_approved").select("college_id", (30 + age % 30).alias("priority"))
    return r.crawl_run_counters(pages, v("v_dorm_source").join(halls, "dorm_id"), left, max_pages=2)


@query(run_counts("college_id"))
def crawl_run_counters(v):
    return run_counters(v).where("NOT is_total").drop("is_total")


@query(f"SELECT * EXCLUDE (college_id, blocked, hit_budget) FROM ({run_counts('CAST(NULL AS BIGINT)')}) t")
def crawl_run_summary(v):
    return run_counters(v).where("is_total").drop("is_total", "college_id", "blocked", "hit_budget")


RUN_COVERAGE = f"""SELECT g.id AS college_id, CASE WHEN NOT has_housing THEN 'NO_HOUSING' WHEN coalesce(blocked, false) THEN 'BLOCKED' WHEN coalesce(n_unique, 0) = 0 AND coalesce(n_created + n_updated, 0) = 0 THEN CASE WHEN coalesce(housing_url <> '', false) OR coalesce(n_housing, 0) > 0 OR coalesce(n_directory, 0) > 0 THEN 'SITE_FOUND' ELSE 'RETRYABLE' END
    WHEN coalesce(n_directory, 0) > 0 AND n_unresolved = 0 AND NOT hit_budget AND n_unique >= 1 AND (population IS NULL OR (population % 40 > 0 AND abs(n_unique - population % 40) / CAST(population % 40 AS DOUBLE) <= 0.2e0)) THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage FROM {{v_college}} g LEFT JOIN ({run_counts("college_id")}) t ON t.college_id = g.id"""


@query(RUN_COVERAGE)
def coverage_of_runs(v):
    colleges = v("v_college").select("id", "has_housing", "housing_url", (c("population") % 40).alias("published"))
    return r.decide_run_coverage(colleges, run_counters(v)).select("college_id", "coverage")
