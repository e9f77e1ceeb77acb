"""Joins between the tables of the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url_crawl, canonicalize_or_empty, domain

c = F.col


def with_score(halls: DataFrame, scores: DataFrame) -> DataFrame:
    """Halls with their stored score, if they have one."""
    return halls.join(scores, "id", "left")


def with_amenities(halls: DataFrame, dorm_amenities: DataFrame) -> DataFrame:
    own = dorm_amenities.groupBy(c("dorm_id").alias("id")).agg(F.array_sort(F.collect_set("amenity")).alias("amenities"))
    return halls.join(own, "id", "left").withColumn("amenities", F.coalesce("amenities", F.array().cast("array<string>")))


def all_sources(sources: DataFrame, links: DataFrame, legacy: DataFrame) -> DataFrame:
    """Hall and source ids over the link table and the older direct reference, once each, with the source's columns."""
    both = links.select("dorm_id", "source_id").unionByName(legacy.select("dorm_id", "source_id")).distinct()
    return both.join(sources.withColumnRenamed("id", "source_id"), "source_id")


def colleges_with_halls(colleges: DataFrame, halls: DataFrame) -> DataFrame:
    return colleges.join(halls.select(c("college_id").alias("id")), "id", "left_semi")


def halls_without_amenity(halls: DataFrame, dorm_amenities: DataFrame) -> DataFrame:
    return halls.join(dorm_amenities.select(c("dorm_id").alias("id")), "id", "left_anti")


def new_institutions(incoming: DataFrame, colleges: DataFrame) -> DataFrame:
    """Incoming rows whose ipeds id and slug are both unknown."""
    by_id = incoming.join(colleges.where("ipeds_id IS NOT NULL").select("ipeds_id"), "ipeds_id", "left_anti")
    return by_id.join(colleges.select("slug"), "slug", "left_anti")


def fetch_by_ids(halls: DataFrame, ids: DataFrame) -> DataFrame:
    return halls.join(ids.select("id").distinct(), "id", "left_semi")


def shared_run(runs: DataFrame, results: DataFrame, halls: DataFrame, token: str) -> DataFrame:
    """The stored results of the run with a share token, in rank order, with the halls' names."""
    own = runs.where(c("token") == token).select("run_id").join(results, "run_id")
    return own.join(halls.select(c("id").alias("hall_id"), "name"), "hall_id").orderBy("rank", "name", "hall_id")


def manual_aliases(colleges: DataFrame, rules: DataFrame) -> DataFrame:
    """Aliases of institutions by rules (name, alias); all rules are anchored, so they compare lower-cased names."""
    return colleges.join(rules.select(F.lower("name").alias("__key"), c("alias").alias("manual_alias")), F.lower("name") == c("__key")).drop("__key")


def decision_summary(decisions: DataFrame, last_n: int = 50) -> DataFrame:
    """Accepted, rejected and total of the latest decisions (college_id, ts, id, accepted) of each institution."""
    nth = F.row_number().over(Window.partitionBy("college_id").orderBy(F.desc("ts"), F.asc("id")))
    recent = decisions.withColumn("nth", nth).where(c("nth") <= last_n)
    return recent.groupBy("college_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~c("accepted")).alias("rejected"), F.count("*").alias("total"))


def housing_links(links: DataFrame, most: int = 60) -> DataFrame:
    """Distinct housing links of each page (page_id, position, href), the first ``most``."""
    wanted = c("href").rlike("(?i)housing|residence|residential|res-?life|living|dorm|hall|apartment") & ~c("href").rlike(r"(?i)facebook|twitter|instagram|youtube|linkedin|mailto:|tel:|maps\.")
    first = links.where(wanted).groupBy("page_id", "href").agg(F.min("position").alias("position"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("position", "href"))).where(c("nth") <= most)


def allowed_urls(urls: DataFrame, domains: DataFrame) -> DataFrame:
    """URLs (college_id, url) on a domain of their institution (college_id, domain) or below it."""
    host = domain(c("url"))
    joined = urls.join(domains.select("college_id", "domain"), "college_id")
    return joined.where((host == c("domain")) | host.endswith(F.concat(F.lit("."), c("domain")))).drop("domain").distinct()


def upsert_sources(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Stored sources with those of crawled pages (college_id, url, final_url, role) by canonical URL; the best role of a key's pages counts."""
    rank = F.when(c("role").contains("directory"), 0).when(c("role").contains("detail"), 1).when(c("role").contains("rates"), 2).otherwise(3)
    key = canonical_url_crawl(F.coalesce("final_url", "url"))
    fresh = pages.groupBy("college_id", key.alias("canonical")).agg(F.min(F.struct(rank.alias("k"), "role", "url")).alias("b"))
    fresh = fresh.select("college_id", "canonical", c("b.url").alias("new_url"), c("b.role").alias("new_role"))
    stored = sources.select("college_id", canonical_url_crawl(c("url")).alias("canonical"), "url", "role")
    joined = stored.join(fresh, ["college_id", "canonical"], "full_outer")
    return joined.select("college_id", "canonical", F.coalesce("url", "new_url").alias("url"), F.coalesce("new_role", "role").alias("role"))


def apply_quick(profiles: DataFrame, statements: dict[str, str], required: dict[str, str]) -> DataFrame:
    """Ticked statements (column to weight column) raise a weight to 3 at least; required ones (column to constraint) become hard; budgets up to 0 are none."""
    out = profiles
    for flag, weight in statements.items():
        out = out.withColumn(weight, F.when(c(flag), F.greatest(F.coalesce(c(weight), F.lit(0.0)), F.lit(3.0))).otherwise(c(weight)))
    for flag, hard in required.items():
        out = out.withColumn(hard, F.when(c(flag), True).otherwise(c(hard)))
    return out.withColumn("max_budget", F.when(c("max_budget") > 0, c("max_budget")))


def canonical_key(final_url: Column, url: Column) -> Column:
    return canonicalize_or_empty(F.coalesce(final_url, url))
