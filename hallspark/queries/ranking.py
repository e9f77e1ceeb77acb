"""Rankings, searches and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as r
from ..operators import windows as w
from ..sources.tables import candidate_urls
from .base import query
from .matching import SCORED, scored

c = F.col


@query("SELECT dorm_id, user_id, n, rating, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dorm_id ORDER BY created_at DESC, user_id, n, rating, price, tax, s, disc, flag) AS INTEGER) AS rn FROM {v_review} WHERE status = 'APPROVED') t WHERE rn <= 20")
def latest_reviews(v):
    return w.latest_reviews(v("v_review")).select("dorm_id", "user_id", "n", "rating", "rn")


@query("SELECT dorm_id, field, value, source_id, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dorm_id ORDER BY ts DESC, k, n, price, qty, tax, source_id, value, confidence, ls) AS INTEGER) AS rn FROM {v_provenance}) t WHERE rn <= 50")
def latest_provenance(v):
    return w.latest_provenance(v("v_provenance")).select("dorm_id", "field", "value", "source_id", "rn")


@query("SELECT dorm_id, field, value, source_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY dorm_id, field ORDER BY confidence DESC, ts DESC, k, n, price, qty, tax, source_id, value, ls) AS rn FROM {v_provenance}) t WHERE rn = 1")
def provenance_best(v):
    return w.provenance_best(v("v_provenance")).select("dorm_id", "field", "value", "source_id", "confidence")


@query("SELECT j.id, j.status, l.id AS log_id, l.level FROM (SELECT * FROM {v_job} ORDER BY created_at DESC, id LIMIT 30) j LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, id) AS rn FROM {v_log}) l ON l.job_id = j.id % 150 AND rn <= 5")
def job_recent_logs(v):
    jobs = v("v_job").orderBy(F.desc("created_at"), "id").limit(30)
    logs = w.latest(v("v_log"), "job_id", [F.desc("ts"), F.asc("id")], 5).select("job_id", c("id").alias("log_id"), "level")
    return jobs.join(logs, c("job_id") == jobs.id % 150, "left").select(jobs.id, "status", "log_id", "level")


def _best(order: str, ok: str, value: str) -> str:
    return f"min_by(name, row({order}, name, id)) FILTER (WHERE {ok} AND {value} IS NOT NULL)"


RANKABLE = "scoreable AND assignable IS DISTINCT FROM false AND granular IS DISTINCT FROM false"


@query(f"SELECT college_id, {_best('yearly_cost', 'true', 'yearly_cost')} AS cheapest, {_best('-yearly_cost', 'true', 'yearly_cost')} AS most_expensive, {_best('-freshman_score', RANKABLE + ' AND freshman', 'freshman_score')} AS best_freshman, {_best('-value_score', RANKABLE, 'value_score')} AS best_value, {_best('-social', RANKABLE, 'social')} AS most_social, {_best('-quiet', RANKABLE, 'quiet')} AS quietest, coalesce(floor(avg(yearly_cost) * 100 + 0.5e0) / 100e0, 0e0) AS avg_cost, count(yearly_cost) > 0 AS has_cost_evidence FROM ({SCORED}) s GROUP BY college_id")
def highlights(v):
    return w.college_highlights(scored(v))


@query(f"SELECT college_id, {_best('-coalesce(social, 0)', 'true', 'coalesce(social, 0)')} AS most_social, {_best('-coalesce(quiet, 0)', 'true', 'coalesce(quiet, 0)')} AS quietest FROM ({SCORED}) s GROUP BY college_id")
def highlights_without_gate(v):
    return w.college_highlights(scored(v), evidence_gate=False).select("college_id", "most_social", "quietest")


@query("SELECT id, name, state, yearly_cost FROM (SELECT d.*, k.state, k.name AS college_name FROM {v_dorm} d JOIN {v_college} k ON d.college_id = k.id) t WHERE (lower(name) LIKE '%ring%' OR lower(college_name) LIKE '%ring%') AND has_ac AND yearly_cost >= 9000 AND yearly_cost <= 15000")
def hall_search(v):
    rows = r.with_college(v("v_dorm"), v("v_college"))
    return w.search_halls(rows, q="Ring", has_ac=True, least_cost=9000, most_cost=15000).select("id", "name", "state", "yearly_cost")


@query("SELECT id, name FROM {v_college} WHERE lower(name) LIKE '%college%' OR lower(coalesce(short_name, '')) LIKE '%college%' OR lower(city) LIKE '%college%' OR lower(alias) LIKE '%college%'")
def institution_search(v):
    return w.search_colleges(v("v_college"), "College").select("id", "name")


#: Names that an institution also bears: its alias, its city's and its slug's; every third has an official name.
NAMED = "SELECT id, name, short_name, city, list_value(alias, concat(city, ' ', alias), slug) AS aliases, CASE WHEN id % 3 = 0 THEN concat('Board of ', city) END AS official_name FROM {v_college}"


def named(v):
    aliases = F.array("alias", F.concat("city", F.lit(" "), "alias"), "slug")
    return v("v_college").select("id", "name", "short_name", "city", aliases.alias("aliases"), F.when(c("id") % 3 == 0, F.concat(F.lit("Board of "), "city")).alias("official_name"))


@query(f"SELECT id, name FROM ({NAMED}) k WHERE lower(name) LIKE '%ge-1%' OR lower(coalesce(short_name, '')) LIKE '%ge-1%' OR lower(city) LIKE '%ge-1%' OR lower(coalesce(official_name, '')) LIKE '%ge-1%' OR len(list_filter(aliases, lambda a: lower(a) LIKE '%ge-1%')) > 0")
def institution_search_aliases(v):
    return w.search_colleges(named(v), "Ge-1").select("id", "name")


@query(f"SELECT id, name FROM ({NAMED}) k WHERE lower(name) LIKE 'boa%' OR lower(coalesce(official_name, '')) LIKE 'boa%' OR lower(coalesce(short_name, '')) = 'boa' OR list_contains(list_transform(aliases, lambda a: lower(a)), 'boa')")
def institution_search_official(v):
    return w.search_colleges(named(v), "Boa").select("id", "name")


@query(f"SELECT d.id, d.name FROM {{v_dorm}} d JOIN ({NAMED}) k ON d.college_id = k.id WHERE (lower(d.name) LIKE '%ge-1%' OR lower(k.name) LIKE '%ge-1%' OR len(list_filter(aliases, lambda a: lower(a) LIKE '%ge-1%')) > 0) AND freshman")
def hall_search_aliases(v):
    own = named(v).select(c("id").alias("college_id"), c("name").alias("college_name"), "aliases")
    return w.search_halls(v("v_dorm").join(own, "college_id"), q="ge-1", freshman=True).select("id", "name")


@query("SELECT j.id, j.status, CAST(rn AS INTEGER) AS rn, n AS log_id, flag AS level FROM (SELECT * FROM {v_job} ORDER BY created_at DESC, id LIMIT 30) j LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, n, flag) AS rn FROM {v_review}) l ON l.user_id = j.id AND rn <= 5")
def recent_jobs(v):
    logs = v("v_review").select(c("user_id").alias("job_id"), c("n").alias("id"), c("flag").alias("level"), c("created_at").alias("ts"))
    return w.recent_jobs(v("v_job"), logs).select("id", "status", "rn", "log_id", "level")


@query("SELECT id, name FROM {v_college} WHERE lower(name) LIKE 'a1%' OR lower(coalesce(short_name, '')) = 'a1' OR lower(alias) = 'a1'")
def institution_search_short(v):
    return w.search_colleges(v("v_college"), "A1").select("id", "name")


@query("SELECT id, CAST(CASE WHEN lower(coalesce(short_name, '')) = 'c4' THEN 900 ELSE 0 END + CASE WHEN lower(alias) = 'c4' THEN 900 ELSE 0 END + CASE WHEN lower(alias) LIKE 'c4%' THEN 400 ELSE 0 END + CASE WHEN lower(name) LIKE '%c4%' THEN 100 ELSE 0 END + least(200, n * 40) + least(50, CAST(floor(coalesce(population, 0) / 2000e0) AS BIGINT)) - CASE WHEN lower(alias) <> 'c4' AND lower(coalesce(short_name, '')) <> 'c4' THEN 300 ELSE 0 END AS BIGINT) AS relevance FROM {v_college} k JOIN (SELECT college_id, count(*) AS n FROM {v_dorm} GROUP BY college_id) h ON h.college_id = k.id")
def institution_search_ranked(v):
    halls = v("v_dorm").groupBy(c("college_id").alias("id")).agg(F.count("*").alias("n_halls"))
    return w.rank_colleges(v("v_college").join(halls, "id"), "c4").select("id", "relevance")


@query("SELECT id, name, (SELECT count(*) FROM {v_college}) AS total, CAST(ceil((SELECT count(*) FROM {v_college}) / 10e0) AS BIGINT) AS total_pages FROM {v_college} ORDER BY name, id LIMIT 10 OFFSET 20")
def institution_page(v):
    return w.paginate(v("v_college"), [F.asc("name"), F.asc("id")], 3, 10).select("id", "name", "total", "total_pages")


@query(f"SELECT id, name, overall_score FROM ({SCORED}) s ORDER BY overall_score DESC NULLS FIRST, name, id LIMIT 100")
def hall_listing_top100(v):
    return w.sort_halls(scored(v)).limit(100).select("id", "name", "overall_score")


PRIORITY = "CASE WHEN regexp_matches(url, '(?i)housing\\.|reslife\\.|residentiallife\\.') THEN 50 ELSE 0 END + CASE WHEN regexp_matches(url, '(?i)residence-halls|housing-options|residences|explore-housing') THEN 40 ELSE 0 END + CASE WHEN regexp_matches(url, '(?i)rates|room-type|floor-plan|amenities') THEN 15 ELSE 0 END - CASE WHEN regexp_matches(url, '(?i)apply|login|portal|news|event') THEN 20 ELSE 0 END"


@query(f"SELECT id, priority, CAST(rank AS INTEGER) AS rank, rank <= 2 AS visited, rank > 2 AND priority >= 40 AS unresolved FROM (SELECT *, row_number() OVER (PARTITION BY college_id ORDER BY priority DESC, id % 5, url) AS rank FROM (SELECT *, {PRIORITY} AS priority FROM {{v_source}} WHERE id % 5 <= 3) s) t")
def frontier_plan(v):
    urls = v("v_source").withColumns({"depth": c("id") % 5, "housing_url": F.lit("")})
    return w.frontier_plan(urls, max_pages=2).select("id", "priority", "rank", "visited", "unresolved")


@query("SELECT id, name, n_halls FROM (SELECT k.id, k.name, count(*) AS n_halls FROM {v_college} k JOIN {v_dorm} d ON d.college_id = k.id GROUP BY k.id, k.name) t ORDER BY name, id LIMIT 3")
def featured_institutions(v):
    return w.featured_colleges(v("v_college"), v("v_dorm")).select("id", "name", "n_halls")


@query("SELECT id, name FROM {v_college} ORDER BY coalesce(population >= 20000, false) DESC, name, id LIMIT 25")
def enrollment_preference(v):
    return w.prefer_enrollment(v("v_college"), 20000).limit(25).select("id", "name")


@query("SELECT dorm_id, user_id, n, (SELECT count(*) FROM {v_review} WHERE status = 'PENDING') AS total FROM {v_review} WHERE status = 'PENDING' ORDER BY created_at DESC, dorm_id, user_id, n, price, tax, s, disc, flag, rating LIMIT 20")
def moderation_queue(v):
    return w.moderation_queue(v("v_review"), "PENDING").select("dorm_id", "user_id", "n", "total")


@query("SELECT dorm_id, key, title, role, CAST(row_number() OVER (PARTITION BY dorm_id ORDER BY CASE role WHEN 'detail' THEN 0 WHEN 'directory' THEN 1 WHEN 'rates' THEN 2 WHEN 'eligibility' THEN 3 ELSE 4 END, age_days, key) AS INTEGER) AS position FROM (SELECT dorm_id, key, coalesce(first(title ORDER BY path, arrival) FILTER (WHERE title <> ''), first(title ORDER BY path, arrival)) AS title, first(role ORDER BY path, arrival) FILTER (WHERE role IS NOT NULL) AS role, coalesce(first(age_days ORDER BY path, arrival) FILTER (WHERE title <> ''), first(age_days ORDER BY path, arrival)) AS age_days FROM (SELECT l.dorm_id, concat('https://h', CAST(l.source_id % 7 AS VARCHAR), '.example.edu/') AS key, CASE l.source_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('T', CAST(l.source_id AS VARCHAR)) END AS title, CASE l.source_id % 4 WHEN 0 THEN 'detail' WHEN 1 THEN 'rates' WHEN 2 THEN 'directory' END AS role, l.source_id % 90 AS age_days, l.source_id AS arrival, CASE WHEN l.source_id % 2 = 0 THEN 0 ELSE 1 END AS path FROM {v_dorm_source} l) s GROUP BY dorm_id, key) g")
def source_merge(v):
    k = c("source_id")
    rows = v("v_dorm_source").select(
        "dorm_id", "source_id", F.concat(F.lit("https://H"), (k % 7).cast("string"), F.lit(".example.edu/?utm_source=x#top")).alias("url"), F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("string").alias("canonical"),
        F.when(k % 3 == 0, None).when(k % 3 == 1, "").otherwise(F.concat(F.lit("T"), k.cast("string"))).alias("title"), F.when(k % 4 == 0, "detail").when(k % 4 == 1, "rates").when(k % 4 == 2, "directory").alias("role"), (k % 90).alias("age_days"), k.alias("arrival"),
    )
    merged = w.merge_sources(rows.where("source_id % 2 = 0"), rows.where("source_id % 2 <> 0"))
    return merged.select("dorm_id", "key", "title", "role", "position")


@query("SELECT DISTINCT college_id, url FROM (SELECT college_id, url FROM {v_source} UNION ALL SELECT id, housing_url FROM {v_college} WHERE housing_url <> '' UNION ALL SELECT id, housing_url FROM {v_college} WHERE housing_url <> '') u")
def candidate_url_union(v):
    own = v("v_college").where("housing_url <> ''").select(c("id").alias("college_id"), c("housing_url").alias("url"))
    return candidate_urls(v("v_source"), own, own)
