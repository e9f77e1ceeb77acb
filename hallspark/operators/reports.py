"""Reports: national, state, coverage, quality and institution figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import listed, rounded

c = F.col
PUBLISHED = "is_active AND assignable AND granular AND status <> 'QUARANTINED'"
BATHROOMS = ("PRIVATE", "SUITE", "SEMI_PRIVATE", "COMMUNAL", "UNKNOWN")


def count_where(condition: Column | str) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent; 0 of nothing is 0."""
    return rounded(part * 100.0 / F.greatest(whole, F.lit(1)))


def cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100.0


def college_avg_cost(halls: DataFrame, over: str = "all") -> DataFrame:
    rows = {"all": halls, "published": halls.where(PUBLISHED), "active": halls.where("is_active")}[over]
    return rows.groupBy("college_id").agg(cents(F.avg("yearly_cost")).alias("avg_cost"), F.count("yearly_cost").alias("n_costs"))


def with_college(halls: DataFrame, colleges: DataFrame) -> DataFrame:
    own = colleges.select(c("id").alias("college_id"), c("name").alias("college_name"), "state", "school_type", "coverage_status")
    return halls.join(own, "college_id")


def state_stats(halls: DataFrame, colleges: DataFrame, state: str | None = None) -> DataFrame:
    rows = with_college(halls, colleges)
    n = F.count("*")
    out = (rows.where(c("state") == state) if state else rows).groupBy("state").agg(
        n.alias("n_halls"),
        F.coalesce(cents(F.avg(F.when(c("yearly_cost") != 0, c("yearly_cost")))), F.lit(0.0)).alias("avg_cost"),
        percent(count_where("has_ac"), n).alias("pct_ac"),
        percent(count_where("bathroom_style = 'SUITE'"), n).alias("pct_suite"),
        percent(count_where("freshman AND NOT coalesce(upperclass, false)"), n).alias("pct_freshman_only"),
    )
    return out.orderBy(F.desc("avg_cost"), "state")


def national_totals(halls: DataFrame) -> DataFrame:
    n = F.count("*")
    return halls.agg(n.alias("n_halls"), percent(count_where("has_ac"), n).alias("pct_ac"), percent(count_where("bathroom_style = 'SUITE'"), n).alias("pct_suite"), percent(count_where("freshman"), n).alias("pct_freshman"), cents(F.avg("yearly_cost")).alias("avg_cost"))


def cost_by_school_type(halls: DataFrame, colleges: DataFrame) -> DataFrame:
    return with_college(halls, colleges).groupBy("school_type").agg(F.count("yearly_cost").alias("n"), cents(F.avg("yearly_cost")).alias("avg_cost"))


def bathroom_distribution(halls: DataFrame, labels: tuple[str, ...] = BATHROOMS) -> DataFrame:
    """A row per label, also for those without halls."""
    return halls.agg(*[count_where(c("bathroom_style") == x).alias(x) for x in labels]).unpivot([], [c(x) for x in labels], "label", "n")


def room_type_top(rooms: DataFrame, n: int = 8) -> DataFrame:
    return rooms.groupBy("room_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "room_type").limit(n)


def score_histogram(scores: DataFrame, width: int = 20) -> DataFrame:
    """Bins from 0; the full score lies in none, as in the source data."""
    low = (F.floor(c("overall_score") / width) * width).cast("int")
    return scores.where("overall_score >= 0 AND overall_score < 100").groupBy(low.alias("low")).agg(F.count("*").alias("n"))


def cost_ranges(halls: DataFrame, by: str = "college_id") -> DataFrame:
    cost = F.coalesce(c("yearly_cost"), F.lit(0.0))
    return halls.groupBy(by).agg(count_where(cost < 12000).alias("under_12k"), count_where((cost >= 12000) & (cost < 15000)).alias("from_12k"), count_where((cost >= 15000) & (cost < 18000)).alias("from_15k"), count_where(cost >= 18000).alias("from_18k"))


def site_stats(colleges: DataFrame, halls: DataFrame, sources: DataFrame) -> DataFrame:
    a = colleges.agg(F.count("*").alias("n_colleges"), F.countDistinct("state").alias("n_states"))
    b = halls.where(PUBLISHED).agg(F.count("*").alias("n_halls"), rounded(F.avg("confidence") * 100).alias("avg_confidence"))
    return a.join(b, F.lit(True)).join(sources.where("is_approved").agg(F.count("*").alias("n_sources")), F.lit(True))


def coverage_breakdown(colleges: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window_all())
    return colleges.groupBy("coverage_status").agg(F.count("*").alias("n")).withColumn("pct", rounded(c("n") * 1000.0 / total) / 10.0)


def Window_all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def top_states(colleges: DataFrame, n: int = 10) -> DataFrame:
    return colleges.groupBy("state").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "state").limit(n)


def coverage_counters(colleges: DataFrame, halls: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counters; existence is a semi join, done on keys only."""
    own = halls.select(c("college_id").alias("id")).distinct().withColumn("__has", F.lit(True))
    a = colleges.join(own, "id", "left").agg(
        F.count("*").alias("n_colleges"), F.count("ipeds_id").alias("n_ipeds"), count_where("housing_url <> ''").alias("n_housing_url"), count_where("has_housing").alias("n_flagged"), count_where("NOT has_housing").alias("n_no_housing"), count_where("__has").alias("n_with_halls")
    )
    parents = halls.select(c("parent_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("__parent", F.lit(True))
    sourced = links.select(c("dorm_id").alias("id")).distinct().withColumn("__sourced", F.lit(True))
    b = halls.join(parents, "id", "left").join(sourced, "id", "left").agg(F.count("*").alias("n_halls"), count_where("assignable").alias("n_assignable"), count_where("__parent").alias("n_parents"), F.count("parent_id").alias("n_children"), count_where("__sourced").alias("n_sourced"))
    return a.join(b, F.lit(True))


def admin_overview(halls: DataFrame, jobs: DataFrame, amenities: DataFrame, stale_days: int = 180) -> DataFrame:
    own = amenities.select(c("dorm_id").alias("id")).distinct().withColumn("__a", F.lit(True))
    a = halls.join(own, "id", "left").agg(
        F.count("*").alias("n_halls"), rounded(F.avg("confidence") * 100).alias("avg_confidence"), rounded(F.avg("completeness") * 100).alias("avg_completeness"), count_where("yearly_cost IS NULL").alias("n_missing_cost"), count_where("__a IS NULL").alias("n_missing_amenities"), count_where(c("age_days") > stale_days).alias("n_stale")
    )
    b = jobs.agg(F.count("*").alias("n_jobs"), count_where("status = 'FAILED'").alias("n_failed"), percent(count_where("status = 'COMPLETED'"), F.count("*")).alias("pct_success"))
    return a.join(b, F.lit(True))


def coverage_dashboard(colleges: DataFrame, halls: DataFrame) -> DataFrame:
    """Shares of institutions by what is known of them, and of halls by the facts they state."""
    n = F.count("*")
    a = colleges.agg(n.alias("n_colleges"), percent(count_where("housing_url <> ''"), n).alias("pct_housing_url"), percent(count_where("coverage_status = 'COMPLETE'"), n).alias("pct_complete"))
    b = halls.agg(n.alias("n_halls"), percent(F.count("yearly_cost"), n).alias("pct_cost"), percent(F.count("has_ac"), n).alias("pct_ac_known"), percent(count_where("bathroom_style <> 'UNKNOWN'"), n).alias("pct_bathroom"))
    return a.join(b, F.lit(True))


def quality_report(halls: DataFrame, colleges: DataFrame, stale_days: int = 180) -> DataFrame:
    """Gaps per institution and per state, as two grouping sets of one pass."""
    rows = with_college(halls, colleges)
    aggregates = [F.count("*").alias("n_halls"), count_where("yearly_cost IS NULL").alias("missing_cost"), count_where("amenity_count IS NULL").alias("missing_amenities"), count_where("confidence < 0.6D").alias("low_confidence"), count_where("status = 'DUPLICATE'").alias("duplicates"), count_where(c("age_days") > stale_days).alias("stale"), (F.floor(F.avg("completeness") * 1e6 + 0.5) / 1e6).alias("avg_completeness")]
    return rows.groupingSets([["college_id"], ["state"]], "college_id", "state").agg(*aggregates)


#: Parts of a group of names, each ranked by itself: a group as large as the table is sorted by as many tasks.
NAME_PARTS = 256


def junk_report(candidates: DataFrame, samples: int = 3, top: int = 20, by: str = "reason", times: str | None = None) -> DataFrame:
    """Junk by reason, or by another column such as the institution, with the first names of each. ``times`` is a column that says for how many rows a row stands.

    One pass: rows are counted by name, names are ranked in parts of their group, and each part hands on its count and its first names only, so no group is gathered or sorted whole."""
    from pyspark.sql import Window

    one = F.sum(times) if times else F.count("*")
    part = F.pmod(F.hash("name"), F.lit(NAME_PARTS)).alias("part")
    ranked = candidates.groupBy(by, part, "name").agg(one.alias("n")).withColumn("k", F.row_number().over(Window.partitionBy(by, "part").orderBy(c("name").asc_nulls_last())))
    first = F.collect_list(F.when(c("k") <= samples, c("name")))
    out = ranked.groupBy(by).agg(F.sum("n").alias("n"), F.array_join(F.slice(F.array_sort(first), 1, samples), "; ").alias("samples"))
    return out.where(c(by).isNotNull()).orderBy(F.desc("n"), by).limit(top)


def pipeline_metrics(scored: DataFrame, colleges: DataFrame | None = None) -> DataFrame:
    """Counts of halls and, given institutions, of these by coverage."""
    halls = scored.agg(F.count("*").alias("n_halls"), count_where("is_active").alias("n_active"), count_where("status = 'QUARANTINED'").alias("n_quarantined"), count_where("scoreable").alias("n_scoreable"))
    if colleges is None:
        return halls
    covered = colleges.agg(*[count_where(c("coverage_status") == k).alias(f"n_{k.lower()}") for k in ("COMPLETE", "PARTIAL", "BLOCKED")])
    return halls.join(covered, F.lit(True))


def blocked_colleges(colleges: DataFrame) -> DataFrame:
    return colleges.where("coverage_status = 'BLOCKED'").select("id", "name", "state").orderBy("name", "id")


def checkpoint_counts(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("status").agg(F.count("*").alias("n"))


def score_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("scoreable").agg(F.count("*").alias("n"), F.min("overall_score").alias("least"), F.max("overall_score").alias("most"))


def map_pins(colleges: DataFrame, halls: DataFrame, limit: int = 2000) -> DataFrame:
    own = halls.groupBy(c("college_id").alias("id")).agg(F.count("*").alias("n_halls"), cents(F.avg(F.when(c("is_active"), c("yearly_cost")))).alias("avg_cost"))
    pins = colleges.where("latitude IS NOT NULL AND longitude IS NOT NULL").join(own, "id", "left")
    return pins.select("id", "name", "latitude", "longitude", F.coalesce("n_halls", F.lit(0)).alias("n_halls"), "avg_cost").orderBy("name", "id").limit(min(limit, 5000))


def coverage_evidence(colleges: DataFrame, sources: DataFrame, checkpoints: DataFrame, halls: DataFrame) -> DataFrame:
    directories = sources.where("page_role LIKE '%housing_directory%'").groupBy("college_id").agg(F.count("*").alias("directories"))
    active = halls.where("is_active AND status = 'ACTIVE'").groupBy("college_id").agg(F.count("*").alias("active"))
    done = F.coalesce((F.get_json_object("metadata", "$.directoryExhausted") == "true") | (F.get_json_object("metadata", "$.coverageDecision") == "COMPLETE"), F.lit(False))
    marks = checkpoints.select("college_id", done.alias("exhausted"), ((c("candidate_urls") > 5) & ~done).alias("unresolved"))
    out = colleges.withColumnRenamed("id", "college_id")
    for part in (directories, active, marks):
        out = out.join(part, "college_id", "left")
    no = F.lit(False)
    return out.select("college_id", "coverage_status", F.coalesce("directories", F.lit(0)).alias("directories"), F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("exhausted", no).alias("exhausted"), F.coalesce("unresolved", no).alias("unresolved"), c("inventory_days").isNotNull().alias("inventory_success"))


def recompute_coverage(evidence: DataFrame) -> DataFrame:
    """Institutions marked complete that lack evidence become partial; what is missing is listed."""
    missing = listed(F.when(c("directories") == 0, "directory_page_role"), F.when(~c("exhausted"), "directory_not_exhausted"), F.when(~c("inventory_success"), "inventory_success"), F.when(c("active") == 0, "no_active_entities"), F.when(c("unresolved"), "unresolved_frontier"))
    return evidence.where("coverage_status = 'COMPLETE'").withColumn("missing", F.array_join(missing, ",")).where("missing <> ''").select("college_id", F.lit("PARTIAL").alias("new_status"), "missing")


def decide_coverage(counters: DataFrame) -> DataFrame:
    """Add coverage: rules in order over a crawl's counters."""
    unresolved = F.coalesce(c("unresolved_directory_links"), c("unresolved_housing_links"), F.lit(0)) > 0
    created = c("n_created") + c("n_updated")
    reconciles = F.coalesce((c("published") > 0) & (F.abs(c("n_unique") - c("published")) / c("published") <= 0.2), F.lit(False))
    exhausted = F.coalesce(c("directory_parsed"), F.lit(False)) & (c("directory_sources") >= 1) & ~unresolved & ~F.coalesce(c("hit_budget"), F.lit(False))
    complete = exhausted & (c("n_unique") >= 1) & (reconciles | (c("published").isNull() & (c("directory_pages") >= 1)))
    status = (
        F.when(~c("has_housing"), "NO_HOUSING")
        .when(c("blocked"), "BLOCKED")
        .when((c("n_unique") == 0) & (created == 0), F.when(c("site_found") | (c("directory_sources") > 0), "SITE_FOUND").otherwise("RETRYABLE"))
        .when((c("n_unique") == 0) & (c("directory_sources") > 0) & ~F.coalesce(c("directory_parsed"), F.lit(False)), "DIRECTORY_PENDING")
        .when(complete, "COMPLETE")
        .otherwise("PARTIAL")
    )
    return counters.withColumn("coverage", status)


def crawl_counters(logs: DataFrame) -> DataFrame:
    return logs.groupBy("job_id").agg(F.count("*").alias("n"), count_where("level = 'error'").alias("n_errors"), F.countDistinct("level").alias("n_levels"), F.max("ts").alias("last_ts"))


def crawl_run_counters(pages: DataFrame, candidates: DataFrame, frontier: DataFrame, max_pages: int = 18, unresolved_from: int = 40) -> DataFrame:
    """What a crawl came to, by institution and, with a null college_id and ``is_total``, for the whole run.

    Three grains are stacked and counted in one pass with a grouping set for each level: pages (college_id, status,
    unchanged, roles, housing), candidates (college_id, accepted, entity_id, created) and links left to visit
    (college_id, priority). A page answered 401 or 403 is restricted, one answered 200 to 299 fetched; only fetched pages
    have roles. Accepted candidates without an entity, or with one seen before, are duplicates. An institution is
    blocked if nothing was fetched, something restricted and no entity found; it hit its budget if ``max_pages`` were
    visited and links are left. Rows without an institution count in the total only."""
    none, no = F.lit(None).cast("long"), F.lit(False)
    fetched = c("status").between(200, 299)
    has = lambda role: fetched & F.array_contains("roles", role)
    flags = ("visited", "fetched", "restricted", "unchanged", "directory", "detail", "housing", "accepted", "rejected", "created", "updated", "left", "unresolved")

    def stacked(rows: DataFrame, entity: Column, **own: Column) -> DataFrame:
        return rows.select("college_id", entity.alias("entity_id"), *[F.coalesce(own.get(k, no), no).alias(k) for k in flags])

    known = c("accepted") & c("entity_id").isNotNull()
    rows = stacked(pages, none, visited=F.lit(True), fetched=fetched, restricted=c("status").isin(401, 403), unchanged=fetched & c("unchanged"), directory=has("housing_directory"), detail=has("housing_detail"), housing=fetched & c("housing"))
    rows = rows.unionByName(stacked(candidates, F.when(c("accepted"), c("entity_id").cast("long")), accepted=c("accepted"), rejected=~c("accepted"), created=known & c("created"), updated=known & ~c("created")))
    rows = rows.unionByName(stacked(frontier, none, left=F.lit(True), unresolved=c("priority") >= unresolved_from))
    counted = rows.rollup("college_id").agg((F.grouping("college_id") == 1).alias("is_total"), F.countDistinct("entity_id").alias("n_unique"), *[F.count_if(k).alias(f"n_{k}") for k in flags])
    counted = counted.where("is_total OR college_id IS NOT NULL")
    return counted.withColumns({"n_duplicates": c("n_accepted") - c("n_unique"), "blocked": (c("n_fetched") == 0) & (c("n_restricted") > 0) & (c("n_unique") == 0), "hit_budget": (c("n_visited") >= max_pages) & (c("n_left") > 0)})


def decide_run_coverage(colleges: DataFrame, counters: DataFrame) -> DataFrame:
    """:func:`decide_coverage` fed by :func:`crawl_run_counters`, for every institution (id, has_housing, housing_url, published: halls that it says it has, or null)."""
    own = colleges.select(c("id").alias("college_id"), "has_housing", "published", F.coalesce(c("housing_url") != "", F.lit(False)).alias("known_site"))
    joined = own.join(counters.where("NOT is_total"), "college_id", "left")
    n = lambda k: F.coalesce(f"n_{k}", F.lit(0))
    fed = joined.select("college_id", "has_housing", "published", F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("hit_budget", F.lit(False)).alias("hit_budget"), n("unique").alias("n_unique"), n("created").alias("n_created"), n("updated").alias("n_updated"), (c("known_site") | (n("housing") > 0)).alias("site_found"), n("directory").alias("directory_sources"), n("directory").alias("directory_pages"), (n("directory") > 0).alias("directory_parsed"), n("unresolved").alias("unresolved_housing_links"), n("unresolved").alias("unresolved_directory_links"))
    return decide_coverage(fed)
