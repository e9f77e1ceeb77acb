"""Other sources and sinks: pages, sitemaps, directories, catalogs and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, slugify
from ..functions.urls import domain, is_official

c = F.col
#: The amenity catalog.
AMENITIES = ("Air Conditioning", "Laundry", "Kitchen", "Study Lounge", "Elevator", "Gym", "Wifi", "Parking", "Bike Storage", "Game Room", "Dining Hall", "Community Lounge", "Printing", "Mail Room")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages with their host and content hash."""
    return spark.read.parquet(path).withColumns({"host": domain(c("url")), "content_hash": content_hash(c("html"))})


def sitemap_urls(sitemaps: DataFrame, most: int = 20) -> DataFrame:
    """Housing URLs of official domains in sitemaps (college_id, domain, xml), the first 20 of each institution."""
    found = sitemaps.select("college_id", "domain", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("position", "url"))
    kept = found.where(c("url").rlike("(?i)housing|residence|residential|res-?life|living") & is_official(c("url"), c("domain")))
    return kept.withColumn("rn", F.row_number().over(Window.partitionBy("college_id").orderBy("position", "url"))).where(c("rn") <= most).drop("position")


def candidate_urls(*frames: DataFrame) -> DataFrame:
    """Distinct (college_id, url) of several ways to find them."""
    out = frames[0].select("college_id", "url")
    for f in frames[1:]:
        out = out.unionByName(f.select("college_id", "url"))
    return out.distinct()


def seed_directory(directory: DataFrame, halls: DataFrame) -> DataFrame:
    """Halls of official lists (college_id, names) that are not stored yet, by slug."""
    listed = directory.select("college_id", F.explode("names").alias("name")).withColumn("slug", slugify(c("name"))).dropDuplicates(["college_id", "slug"])
    return listed.join(halls.select("college_id", "slug"), ["college_id", "slug"], "left_anti").withColumn("confidence", F.lit(0.9))


def amenity_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, slugify_text(a)) for a in AMENITIES], "name string, normalized string")


def slugify_text(s: str) -> str:
    return s.lower().replace(" ", "_")


def export_halls(halls: DataFrame, colleges: DataFrame, amenities: DataFrame, sources: DataFrame, links: DataFrame, limit: int | None = None, most_sources: int = 5) -> DataFrame:
    """Halls with institution, amenities and their first approved sources, nested; all of them, or the first ``limit`` by id."""
    top = halls if limit is None else halls.orderBy("id").limit(limit)
    own = amenities.groupBy(c("dorm_id").alias("id")).agg(F.array_sort(F.collect_set("amenity")).alias("amenities"))
    approved = links.join(sources.where("is_approved").select(c("id").alias("source_id"), "url"), "source_id")
    first = approved.withColumn("rn", F.row_number().over(Window.partitionBy("dorm_id").orderBy("source_id"))).where(c("rn") <= most_sources)
    urls = first.groupBy(c("dorm_id").alias("id")).agg(F.array_sort(F.collect_list("url")).alias("sources"))
    college = colleges.select(c("id").alias("college_id"), F.struct(c("name"), c("state")).alias("college"))
    return top.join(own, "id", "left").join(urls, "id", "left").join(college, "college_id", "left")


def export_comparison_csv(rows: DataFrame, path: str) -> None:
    """Write a comparison as CSV; unknown values are empty."""
    rows.select(*[F.coalesce(c(k).cast("string"), F.lit("")).alias(k) for k in rows.columns]).write.mode("overwrite").csv(path, header=True, emptyValue="")
