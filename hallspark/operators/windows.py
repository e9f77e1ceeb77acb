"""Rankings, latest rows per group, merges of sources, search and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_query
from ..functions.urls import canonicalize_or_empty, resolved_url, role_rank, url_priority

c = F.col


def latest(rows: DataFrame, key: str | list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps no more than n of a key before the shuffle."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(c("rn") <= n)


def latest_reviews(reviews: DataFrame, n: int = 20) -> DataFrame:
    return latest(reviews.where("status = 'APPROVED'"), "dorm_id", [F.desc("created_at"), *map(F.asc, ("user_id", "n", "rating", "price", "tax", "s", "disc", "flag"))], n)


def latest_provenance(provenance: DataFrame, n: int = 50) -> DataFrame:
    return latest(provenance, "dorm_id", [F.desc("ts"), *map(F.asc, ("k", "n", "price", "qty", "tax", "source_id", "value", "confidence", "ls"))], n)


def provenance_best(provenance: DataFrame) -> DataFrame:
    return latest(provenance, ["dorm_id", "field"], [F.desc("confidence"), F.desc("ts"), *map(F.asc, ("k", "n", "price", "qty", "tax", "source_id", "value", "ls"))], 1)


def recent_jobs(jobs: DataFrame, logs: DataFrame, n_jobs: int = 30, n_logs: int = 5) -> DataFrame:
    top = jobs.orderBy(F.desc("created_at"), "id").limit(n_jobs)
    own = latest(logs, "job_id", [F.desc("ts"), F.asc("id"), F.asc("level")], n_logs).select(c("job_id").alias("id"), c("id").alias("log_id"), "level", "rn")
    return top.join(own, "id", "left")


def college_highlights(scored: DataFrame, evidence_gate: bool = True) -> DataFrame:
    """One row per institution: the halls that lead by cost, freshman fit, value, social and quiet ratings. Ties go to the first name; only scored halls compete for the last four unless ``evidence_gate`` is off, when unknown values count as 0."""
    rankable = c("scoreable") & ~c("assignable").eqNullSafe(False) & ~c("granular").eqNullSafe(False) if evidence_gate else F.lit(True)

    def best(value: Column, ok: Column, low: bool = False) -> Column:
        v = value if evidence_gate else F.coalesce(value, F.lit(0))
        key = F.when(ok & v.isNotNull(), F.struct((v if low else -v).alias("v"), c("name").alias("name"), c("id").alias("id")))
        return F.min(key)["name"]

    cost = c("yearly_cost")
    return scored.groupBy("college_id").agg(
        F.min(F.when(cost.isNotNull(), F.struct(cost.alias("v"), "name", "id")))["name"].alias("cheapest"),
        F.min(F.when(cost.isNotNull(), F.struct((-cost).alias("v"), "name", "id")))["name"].alias("most_expensive"),
        best(c("freshman_score"), rankable & c("freshman")).alias("best_freshman"),
        best(c("value_score"), rankable).alias("best_value"),
        best(c("social"), rankable).alias("most_social"),
        best(c("quiet"), rankable).alias("quietest"),
        F.coalesce(F.floor(F.avg(cost) * 100 + 0.5) / 100.0, F.lit(0.0)).alias("avg_cost"),
        (F.count(cost) > 0).alias("has_cost_evidence"),
    )


def merge_sources(legacy: DataFrame, linked: DataFrame) -> DataFrame:
    """One source per hall and canonical URL out of two link paths (dorm_id, url, final_url, canonical, title, role, age_days, arrival).

    In order of arrival (legacy first): the first entry stays unless it lacks a title and a later one has one; its role
    is filled from the first that has one. Ordered by role, newest first."""
    both = legacy.withColumn("path", F.lit(0)).unionByName(linked.withColumn("path", F.lit(1)))
    keyed = both.withColumn("key", canonicalize_or_empty(F.coalesce("final_url", "url")))
    w = Window.partitionBy("dorm_id", "key").orderBy("path", "arrival")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    titled = F.when(c("title") != "", F.struct("title", "url", "final_url", "canonical", "age_days"))
    ranked = keyed.withColumns({"titled": F.first(titled, True).over(whole), "some_role": F.first("role", True).over(whole), "k": F.row_number().over(w)}).where("k = 1")
    use = F.coalesce("titled", F.struct("title", "url", "final_url", "canonical", "age_days"))
    out = ranked.withColumn("use", use).select("dorm_id", "key", "use.title", c("some_role").alias("role"), resolved_url(c("use.url"), c("use.final_url"), c("use.canonical")).alias("display_url"), "use.age_days")
    return out.withColumn("position", F.row_number().over(Window.partitionBy("dorm_id").orderBy(role_rank(c("role")), "age_days", "key")))


def any_of(names: list[str], columns: list[str], holds: Callable[[Column], Column]) -> Column:
    """Whether a text among the columns named that exist, or an element of an array column ``aliases``, fulfils ``holds``, in lower case; unknown texts don't."""
    texts = F.array(*[F.lower(c(k)) for k in names if k in columns])
    if "aliases" in columns:
        texts = F.concat(texts, F.coalesce(F.transform("aliases", lambda a: F.lower(a)), F.array().cast("array<string>")))
    return F.exists(texts, lambda t: F.coalesce(holds(t), F.lit(False)))


def search_halls(halls: DataFrame, q: str | None = None, state: str | None = None, has_ac: bool | None = None, freshman: bool | None = None, honors: bool | None = None, least_cost: float | None = None, most_cost: float | None = None, least_score: float | None = None, bathroom: str | None = None, dorm_type: str | None = None) -> DataFrame:
    """Halls that fulfil all conditions given; ``q`` is part of the hall's or institution's name or of one of its ``aliases``."""
    out = halls
    if q:
        out = out.where(any_of(["name", "college_name"], halls.columns, lambda t: t.contains(q.lower())))
    for column, value in (("state", state), ("has_ac", has_ac), ("freshman", freshman), ("honors", honors), ("bathroom_style", bathroom), ("dorm_type", dorm_type)):
        if value is not None:
            out = out.where(c(column) == value)
    if least_cost is not None:
        out = out.where(c("yearly_cost") >= least_cost)
    if most_cost is not None:
        out = out.where(c("yearly_cost") <= most_cost)
    return out if least_score is None else out.where(c("overall_score") >= least_score)


def sort_halls(halls: DataFrame, nulls: str = "first") -> DataFrame:
    """By score, best first; where unscored halls go is the database's choice in the source data, hence first by default."""
    order = F.desc_nulls_first("overall_score") if nulls == "first" else F.desc_nulls_last("overall_score")
    return halls.orderBy(order, "name", "id")


def search_colleges(colleges: DataFrame, query: str) -> DataFrame:
    """Short queries match the beginning of a name, a short name or an alias; longer ones any part of these or of the city. Official names (``official_name``) and all ``aliases`` count where the table has them."""
    q = query.lower().strip()
    called, short = ["name", "official_name"], ["short_name", "alias"]
    if len(q) <= 3:
        named = any_of(called, [k for k in colleges.columns if k != "aliases"], lambda t: t.startswith(q))
        return colleges.where(named | any_of(short, colleges.columns, lambda t: t == q))
    return colleges.where(any_of([*called, *short, "city"], colleges.columns, lambda t: t.contains(q)))


def rank_colleges(colleges: DataFrame, query: str) -> DataFrame:
    """Add relevance to institutions with n_halls and population; best first."""
    q = F.lit(query.lower())
    name, short, alias = F.lower("name"), F.coalesce(F.lower("short_name"), F.lit("")), F.coalesce(F.lower("alias"), F.lit(""))
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    score = points((name == q) | (name == normalize_query(q)), 1000) + points(short == q, 900) + points(alias == q, 900) + points(name.startswith(q), 500) + points(alias.startswith(q), 400) + points(name.contains(q), 100)
    score = score + F.least(F.lit(200), c("n_halls") * 40) + F.least(F.lit(50), F.floor(F.coalesce("population", F.lit(0)) / 2000))
    if len(query) <= 3:
        score = score - points((alias != q) & (short != q) & ~name.startswith(q), 300)
    return colleges.withColumn("relevance", score.cast("long")).orderBy(F.desc("relevance"), "name", "id")


def paginate(rows: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """One page with total and total_pages; the sort stops at the page's end."""
    page, size = max(1, page), min(100, max(1, page_size))
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).join(F.broadcast(total), F.lit(True)).withColumn("total_pages", F.ceil(c("total") / size).cast("long"))


def frontier_plan(urls: DataFrame, max_pages: int = 18, max_depth: int = 3, least_unresolved: int = 40) -> DataFrame:
    """The URLs (college_id, url, housing_url, depth) that a crawl visits, by priority, and those of priority that it leaves."""
    planned = urls.where(c("depth") <= max_depth).withColumn("priority", url_priority(c("url"), c("housing_url")))
    rank = F.row_number().over(Window.partitionBy("college_id").orderBy(F.desc("priority"), "depth", "url"))
    return planned.withColumn("rank", rank).withColumns({"visited": c("rank") <= max_pages, "unresolved": (c("rank") > max_pages) & (c("priority") >= least_unresolved)})


def accept_once(candidates: DataFrame) -> DataFrame:
    """A name is accepted once a page, whatever its case; all later candidates of an accepted name are skipped, rejected ones before it count. All others stay, however many a page has. Candidates: page_id, position, name, accepted."""
    accepted_at = F.min(F.when(c("accepted"), c("position"))).over(Window.partitionBy("page_id", F.lower("name")))
    return candidates.withColumn("accepted_at", accepted_at).where(c("accepted_at").isNull() | (c("position") <= c("accepted_at"))).drop("accepted_at")


def prefer_enrollment(targets: DataFrame, least: int) -> DataFrame:
    return targets.orderBy(F.desc(F.coalesce(c("population") >= least, F.lit(False))), "name", "id")


def featured_colleges(colleges: DataFrame, halls: DataFrame, n: int = 3) -> DataFrame:
    counts = halls.groupBy(c("college_id").alias("id")).agg(F.count("*").alias("n_halls"))
    return colleges.join(counts, "id").orderBy("name", "id").limit(n)


def moderation_queue(reviews: DataFrame, status: str, page: int = 1, page_size: int = 20) -> DataFrame:
    return paginate(reviews.where(c("status") == status), [F.desc("created_at"), *map(F.asc, ("dorm_id", "user_id", "n", "price", "tax", "s", "disc", "flag", "rating"))], page, page_size)
