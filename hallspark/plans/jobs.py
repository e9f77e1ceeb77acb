"""The three workloads end to end: matching, inventory from pages, cleaning and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import with_scores
from ..operators import extraction, maintenance, matching, reports, resolution
from ..operators.windows import accept_once

c = F.col


def halls_with_evidence(halls: DataFrame, rooms: DataFrame, amenities: DataFrame, avg_over: str = "all") -> DataFrame:
    """Halls with room types, amenity count and the institution's average cost; the bridges are aggregated before they join."""
    own_rooms = rooms.groupBy(c("dorm_id").alias("id")).agg(F.collect_list(F.struct("room_type", "capacity")).alias("room_types"))
    counts = amenities.groupBy(c("dorm_id").alias("id")).agg(F.count("*").alias("amenity_count"))
    average = reports.college_avg_cost(halls, avg_over).select("college_id", "avg_cost")
    return halls.join(own_rooms, "id", "left").join(counts, "id", "left").join(average, "college_id", "left")


def recompute_scores(halls: DataFrame, rooms: DataFrame, amenities: DataFrame) -> DataFrame:
    scored = with_scores(halls_with_evidence(halls, rooms, amenities))
    return scored.select("id", "overall_score", "scoreable", "score_completeness", "data_confidence", *[k for k in scored.columns if k.endswith("_score") and k != "overall_score"])


def match_job(profiles: DataFrame, halls: DataFrame, rooms: DataFrame, amenities: DataFrame, weights: dict[str, Column], limit: int | None = None) -> DataFrame:
    toggle = c("communal_ok") if "communal_ok" in profiles.columns else None
    return matching.match_results(matching.match(profiles, halls_with_evidence(halls, rooms, amenities), weights, toggle=toggle, limit=limit))


def inventory_job(pages: DataFrame, sources: DataFrame, halls: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Changed pages (college_id, page_id, url, final_url, hash, version, html) to candidates, each with the stored hall that it means, if any, and with the category and parent hint of its section."""
    fresh = maintenance.changed_pages(pages, sources)
    found = accept_once(extraction.extract(fresh)).where("accepted")
    owners = fresh.select("page_id", "college_id")
    named = found.join(owners, "page_id").select(F.concat_ws("-", "page_id", "position").alias("candidate_id"), "college_id", c("name").alias("candidate_name"), "kind", "score_confidence", "category", "parent_hint", "image")
    resolved = resolution.resolve_entities(named, halls, aliases)
    return named.join(resolved.select("candidate_id", "hall_id"), "candidate_id")


def clean_job(halls: DataFrame, reviews: DataFrame) -> DataFrame:
    """Changes (id, status, reason): junk names are quarantined, duplicates flagged."""
    junk = resolution.junk_candidates(halls, reviews).select("id", F.lit("QUARANTINED").alias("status"), "reason")
    double = resolution.flag_duplicates(resolution.duplicate_pairs(halls)).select("id", F.lit("REVIEW").alias("status"), F.concat(F.lit("duplicate of "), c("duplicate_of")).alias("reason"))
    return junk.unionByName(double.join(junk.select("id"), "id", "left_anti"))
