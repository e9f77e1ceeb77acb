"""Catalog import, seeds and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance as t
from ..sources import tables as s
from .base import query

c = F.col


def incoming(v):
    k = c("id")
    return v("v_college").select(F.when(k % 7 != 0, 100000 + k).alias("ipeds_id"), F.when(k % 11 == 0, F.lit("Shared Name")).otherwise(c("name")).alias("name"), F.when(k % 13 == 0, None).otherwise(c("state")).alias("state"), F.when(k % 10 == 0, 0).otherwise(1).alias("operating"), "id", "slug")


@query("SELECT q.id, coalesce(a.id, CASE WHEN b.ipeds_id IS NULL OR b.ipeds_id = CASE WHEN q.id % 7 <> 0 THEN 100000 + q.id END THEN b.id END) AS college_id FROM {v_college} q LEFT JOIN (SELECT * FROM {v_college} WHERE id % 2 = 0) a ON a.ipeds_id = CASE WHEN q.id % 7 <> 0 THEN 100000 + q.id END LEFT JOIN (SELECT * FROM {v_college} WHERE id % 2 = 0) b ON b.slug = q.slug")
def institution_match(v):
    stored = v("v_college").where("id % 2 = 0")
    return t.match_institutions(incoming(v), stored).select("id", "college_id")


@query("SELECT id, CASE WHEN k = 1 THEN base WHEN ipeds_id IS NOT NULL THEN concat(base, '-', CAST(ipeds_id AS VARCHAR)) ELSE concat(base, '-', CAST(1 + row_number() OVER (PARTITION BY base, k = 1, ipeds_id IS NULL ORDER BY k) AS VARCHAR)) END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ipeds_id NULLS LAST, id) AS k FROM (SELECT id, name, CASE WHEN id % 7 <> 0 THEN 100000 + id END AS ipeds_id, regexp_replace(regexp_replace(lower(CASE WHEN id % 11 = 0 THEN 'Shared Name' ELSE name END), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS base FROM {v_college}) b) r")
def slug_assignment(v):
    return t.assign_slugs(incoming(v).drop("slug"), v("v_college"), tie="id").select("id", "slug")


@query("SELECT count(*) AS fetched, count(*) FILTER (WHERE id % 13 = 0) AS skipped_invalid, count(*) FILTER (WHERE id % 13 <> 0 AND id % 10 = 0) AS skipped_closed FROM {v_college}")
def import_counters(v):
    return t.import_institutions(incoming(v).drop("slug"), v("v_college"))[1]


@query("SELECT count(*) AS n, count(college_id) AS n_known FROM (SELECT q.id, a.id AS college_id FROM {v_college} q LEFT JOIN (SELECT * FROM {v_college} WHERE id % 2 = 0) a ON a.ipeds_id = CASE WHEN q.id % 7 <> 0 THEN 100000 + q.id END WHERE q.id % 13 <> 0 AND q.id % 10 <> 0) t")
def import_changes(v):
    return t.import_institutions(incoming(v).drop("slug"), v("v_college").where("id % 2 = 0"))[0].agg(F.count("*").alias("n"), F.count("college_id").alias("n_known"))


@query("SELECT college_id, concat('x-', CAST(id AS VARCHAR)) AS slug FROM {v_dorm}")
def seeded_directory(v):
    directory = v("v_dorm").select("college_id", F.array(F.concat(F.lit("X "), c("id").cast("string")), F.concat(F.lit("Hall "), c("id").cast("string"))).alias("names"))
    return s.seed_directory(directory, v("v_dorm")).select("college_id", "slug")


@query("SELECT college_id, url, rn FROM (SELECT college_id, url, CAST(row_number() OVER (PARTITION BY college_id ORDER BY p) AS INTEGER) AS rn FROM (SELECT id AS college_id, concat('https://housing.c', CAST(id AS VARCHAR), '.example.edu/', w, '/', CAST(p AS VARCHAR)) AS url, p FROM {v_college}, (SELECT unnest(range(30)) AS p), (SELECT 'living' AS w)) u) t WHERE rn <= 20")
def sitemap_urls(v):
    own = F.concat(F.lit("c"), c("id").cast("string"), F.lit(".example.edu"))
    locs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.concat(F.lit("<url><loc> https://housing."), own, F.lit("/living/"), k.cast("string"), F.lit(" </loc></url><loc>https://other.org/housing</loc>"))), "")
    maps = v("v_college").select(c("id").alias("college_id"), own.alias("domain"), locs.alias("xml"))
    return s.sitemap_urls(maps).select("college_id", "url", "rn")


@query("SELECT d.id, d.name, k.name AS college, coalesce(n_amenities, 0) AS n_amenities, coalesce(n_sources, 0) AS n_sources FROM {v_dorm} d LEFT JOIN {v_college} k ON k.id = d.college_id LEFT JOIN (SELECT dorm_id, count(DISTINCT amenity) AS n_amenities FROM {v_amenity} GROUP BY dorm_id) a ON a.dorm_id = d.id LEFT JOIN (SELECT dorm_id, least(5, count(*)) AS n_sources FROM {v_dorm_source} l JOIN {v_source} s ON s.id = l.source_id AND is_approved GROUP BY dorm_id) u ON u.dorm_id = d.id")
def export_halls(v):
    rows = s.export_halls(v("v_dorm"), v("v_college"), v("v_amenity"), v("v_source"), v("v_dorm_source"))
    size = lambda k: F.coalesce(F.size(k), F.lit(0)).cast("long")
    return rows.select("id", "name", c("college.name").alias("college"), size("amenities").alias("n_amenities"), size("sources").alias("n_sources"))
