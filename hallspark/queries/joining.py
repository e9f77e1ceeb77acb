"""Joins, set operations and small selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import joins as j
from ..operators import matching as m
from .base import query
from .matching import RANKED, SCORED, matched, scored

c = F.col


@query(f"SELECT d.id, s.overall_score FROM {{v_dorm}} d LEFT JOIN (SELECT id, overall_score FROM ({SCORED}) x WHERE scoreable) s ON s.id = d.id")
def halls_with_score(v):
    return j.with_score(v("v_dorm").select("id"), scored(v).where("scoreable").select("id", "overall_score"))


@query("SELECT d.id, coalesce(a, '') AS amenities FROM {v_dorm} d LEFT JOIN (SELECT dorm_id, string_agg(DISTINCT amenity, ',' ORDER BY amenity) AS a FROM {v_amenity} GROUP BY dorm_id) x ON x.dorm_id = d.id")
def halls_with_amenities(v):
    return j.with_amenities(v("v_dorm"), v("v_amenity")).select("id", F.array_join("amenities", ",").alias("amenities"))


@query("SELECT dorm_id, source_id, url FROM (SELECT dorm_id, source_id FROM {v_dorm_source} UNION SELECT id, id % 50 FROM {v_dorm}) l JOIN {v_source} s ON s.id = l.source_id")
def hall_sources(v):
    legacy = v("v_dorm").select(c("id").alias("dorm_id"), (c("id") % 50).alias("source_id"))
    return j.all_sources(v("v_source"), v("v_dorm_source"), legacy).select("dorm_id", "source_id", "url")


@query("SELECT id FROM {v_college} WHERE id IN (SELECT college_id FROM {v_dorm} WHERE kind = 'UNIT')")
def institutions_with_units(v):
    return j.colleges_with_halls(v("v_college"), v("v_dorm").where("kind = 'UNIT'")).select("id")


@query("SELECT id FROM {v_dorm} WHERE id NOT IN (SELECT dorm_id FROM {v_amenity} WHERE amenity = 'amenity 7')")
def halls_without_amenity(v):
    return j.halls_without_amenity(v("v_dorm"), v("v_amenity").where("amenity = 'amenity 7'")).select("id")


@query("SELECT id FROM {v_college} WHERE coalesce(ipeds_id, -1) NOT IN (SELECT ipeds_id FROM {v_college} WHERE id % 2 = 0 AND ipeds_id IS NOT NULL) AND slug NOT IN (SELECT slug FROM {v_college} WHERE id % 3 = 0)")
def new_institutions(v):
    k = v("v_college")
    stored = k.where("id % 2 = 0").select("ipeds_id", F.lit("none").alias("slug")).unionByName(k.where("id % 3 = 0").select(F.lit(None).cast("long").alias("ipeds_id"), "slug"))
    return j.new_institutions(k, stored).select("id")


@query("SELECT id, name FROM {v_dorm} WHERE id IN (SELECT DISTINCT dorm_id FROM {v_review} WHERE rating = 5 AND n = 7)")
def fetched_by_ids(v):
    return j.fetch_by_ids(v("v_dorm"), v("v_review").where("rating = 5 AND n = 7").select(c("dorm_id").alias("id"))).select("id", "name")


@query(f"SELECT hall_id, name, CAST(rank AS INTEGER) AS rank FROM ({RANKED}) z WHERE outcome = 'eligible' AND profile_id % 10 = 3")
def shared_runs(v):
    results = matched(v).where("outcome = 'eligible'").select(c("profile_id").alias("run_id"), "hall_id", "rank")
    runs = v("v_profile").select(c("id").alias("run_id"), F.concat(F.lit("token-"), (c("id") % 10).cast("string")).alias("token"))
    return j.shared_run(runs, results, v("v_dorm"), "token-3").select("hall_id", "name", "rank")


@query("SELECT id, concat('M', CAST(id % 9 AS VARCHAR)) AS manual_alias FROM {v_college} WHERE id % 6 = 0")
def manual_aliases(v):
    rules = v("v_college").where("id % 6 = 0").select(F.upper("name").alias("name"), F.concat(F.lit("M"), (c("id") % 9).cast("string")).alias("alias"))
    return j.manual_aliases(v("v_college").select("id", "name"), rules).select("id", "manual_alias")


@query("SELECT job_id AS college_id, count(*) FILTER (WHERE level <> 'error') AS accepted, count(*) FILTER (WHERE level = 'error') AS rejected, count(*) AS total FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, id) AS nth FROM {v_log}) t WHERE nth <= 50 GROUP BY job_id")
def decision_summary(v):
    decisions = v("v_log").select(c("job_id").alias("college_id"), "ts", "id", (c("level") != "error").alias("accepted"))
    return j.decision_summary(decisions)


@query("SELECT id, college_id, CASE WHEN id % 3 = 0 THEN greatest(w_social, 3e0) ELSE w_social END AS w_social, CASE WHEN id % 4 = 1 THEN true ELSE require_ac END AS require_ac, CASE WHEN max_budget > 0 THEN max_budget END AS max_budget FROM {v_profile}")
def quick_statements(v):
    rows = v("v_profile").withColumns({"likes": c("id") % 3 == 0, "must": c("id") % 4 == 1})
    return j.apply_quick(rows, {"likes": "w_social"}, {"must": "require_ac"}).select("id", "college_id", "w_social", "require_ac", "max_budget")


@query("SELECT id, url FROM {v_source} WHERE regexp_matches(url, '^https?://([a-z0-9.-]*\\.)?example\\.com([/?#:]|$)')")
def allowed_urls(v):
    rows = v("v_source").select("college_id", "url", "id")
    domains = v("v_source").select("college_id").distinct().withColumn("domain", F.lit("example.com"))
    return j.allowed_urls(rows, domains).select("id", "url")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN concat(url, 'x') WHEN id % 3 = 1 THEN concat(url, 'y') ELSE url END AS resolved FROM {v_source}")
def resolved_urls(v):
    k = c("id") % 3
    final, canonical = F.when(k == 0, F.concat("url", F.lit("x"))).when(k == 1, c("url")), F.when(k == 1, F.concat("url", F.lit("y")))
    return v("v_source").select("id", urls.resolved_url(c("url"), final, canonical).alias("resolved"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN CAST(id AS DOUBLE) + 0.5e0 WHEN id % 4 = 2 THEN NULL ELSE CAST(id AS DOUBLE) END AS number, CASE WHEN id % 4 = 1 OR id % 4 = 3 THEN CAST(id AS INTEGER) END AS enrollment FROM {v_college}")
def numbers(v):
    k = c("id") % 4
    given = F.when(k == 0, " ").when(k == 1, F.concat(c("id").cast("string"), F.lit(".5"))).when(k == 2, "NaN").otherwise(F.concat(F.lit(" "), c("id").cast("string")))
    return v("v_college").select("id", text.as_number(given).alias("number"), text.enrollment(given).alias("enrollment"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'https://a.edu/p?ref=1&id=2' WHEN id % 3 = 1 THEN 'https://a.edu/p' ELSE 'https://a.edu/' END AS canonical FROM {v_dorm}")
def crawl_urls(v):
    k = c("id") % 3
    url = F.when(k == 0, "https://A.edu/p/?ref=1&utm_x=3&id=2#f").when(k == 1, "https://a.edu/p/?fbclid=1").otherwise("https://a.edu")
    return v("v_dorm").select("id", urls.canonical_url_crawl(url).alias("canonical"))


@query("SELECT id, CASE WHEN u0 = 0 THEN 'Maple Hall 1' WHEN u0 = 1 THEN 'North' ELSE NULL END AS title FROM (SELECT id, id % 3 AS u0 FROM {v_dorm}) t")
def slug_titles(v):
    k = c("id") % 3
    url = F.when(k == 0, "https://a.edu/halls/maple-hall_1/").when(k == 1, "https://a.edu/north").otherwise("https://a.edu/")
    return v("v_dorm").select("id", urls.title_from_slug(url).alias("title"))


@query("SELECT college_id, url AS canonical, CASE WHEN id % 2 = 0 THEN 'housing_directory' ELSE 'detail' END AS role FROM (SELECT id, college_id, concat('https://h.example.edu/', CAST(id AS VARCHAR)) AS url FROM {v_source}) s")
def source_upsert(v):
    base = v("v_source").select("id", "college_id", F.concat(F.lit("https://H.example.edu/"), c("id").cast("string")).alias("url"))
    pages = base.select("college_id", F.concat("url", F.lit("/?utm_source=a")).alias("url"), F.lit(None).cast("string").alias("final_url"), F.when(c("id") % 2 == 0, "housing_directory").otherwise("detail").alias("role"))
    again = pages.withColumn("role", F.lit("rates"))
    stored = base.where("id % 5 = 0").select("college_id", "url", F.lit("old").alias("role"))
    return j.upsert_sources(pages.unionByName(again), stored).select("college_id", "canonical", "role")


@query("SELECT page_id, count(*) AS n FROM (SELECT DISTINCT page_id, u FROM (SELECT page_id, unnest(['/housing/a', '/residence-halls', '/housing/a', 'mailto:housing@x', '/news']) AS u FROM {pages}) x WHERE u LIKE '/housing%' OR u LIKE '/residence%') y GROUP BY page_id")
def page_housing_links(v):
    found = F.array(*map(F.lit, ("/housing/a", "/residence-halls", "/housing/a", "mailto:housing@x", "/news")))
    links = v("pages").select("page_id", F.posexplode(found).alias("position", "href"))
    return j.housing_links(links).groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT id, least(100e0, greatest(0e0, (1e0 - abs((CASE WHEN social > 1 THEN social / 10e0 ELSE social END) - 0.7e0)) * 100e0)) AS closeness FROM {v_dorm} WHERE social IS NOT NULL")
def spectrum_closeness(v):
    from ..functions.preferences import spectrum

    return v("v_dorm").where("social IS NOT NULL").select("id", spectrum(c("social"), F.lit(7.0)).alias("closeness"))


@query("SELECT id, CASE WHEN confidence >= 0.75e0 THEN 'high' WHEN confidence >= 0.5e0 THEN 'medium' WHEN confidence >= 0.25e0 THEN 'low' ELSE 'very_low' END AS label FROM {v_dorm}")
def confidence_labels(v):
    return v("v_dorm").select("id", m.confidence_label(c("confidence") * 100).alias("label"))
