"""Changes to stored tables: upserts, merges, provenance, quarantine, checkpoints and import. Jobs return change sets; :func:`apply_changes` merges them."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import assess_name
from ..functions.text import slugify

c = F.col


def merge_upsert(target: DataFrame, changes: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Rows of both by key: new keys are created, known ones get the ``update`` columns (all by default) where the change knows a value; columns that it leaves out stay."""
    update = [k for k in changes.columns if k not in keys] if update is None else update
    t = target.withColumn("__old", F.lit(True)).alias("t")
    s = changes.withColumn("__new", F.lit(True)).alias("s")
    on = [c(f"t.{k}").eqNullSafe(c(f"s.{k}")) for k in keys]
    joined = t.join(s, on, "full_outer")
    columns = []
    for k in target.columns:
        old = c(f"t.{k}")
        if k not in changes.columns:
            columns.append(old.alias(k))
        elif k in keys:
            columns.append(F.coalesce(old, c(f"s.{k}")).alias(k))
        elif k in update:
            columns.append(F.coalesce(c(f"s.{k}"), old).alias(k))
        else:
            columns.append(F.when(c("t.__old"), old).otherwise(c(f"s.{k}")).alias(k))
    return joined.select(*columns)


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], apply: bool = False) -> DataFrame:
    """The changes themselves on a dry run; the merged table if they apply. Applying twice equals applying once."""
    return merge_upsert(target, changes, keys) if apply else changes


def append_missing(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows whose key does not exist yet."""
    e, r = existing.select(*keys).alias("e"), rows.dropDuplicates(keys).alias("r")
    return r.join(e, [c(f"r.{k}").eqNullSafe(c(f"e.{k}")) for k in keys], "left_anti")


def link_sources(resolved: DataFrame, links: DataFrame) -> DataFrame:
    """New links (dorm_id, source_id, role) that the link table lacks."""
    return append_missing(links, resolved.select("dorm_id", "source_id", "role"), ["dorm_id", "source_id"])


def unlinked_sources(sources: DataFrame, links: DataFrame) -> DataFrame:
    return append_missing(links, sources.where("dorm_id IS NOT NULL").select("dorm_id", "source_id"), ["dorm_id", "source_id"])


def append_costs(costs: DataFrame, existing: DataFrame) -> DataFrame:
    return append_missing(existing, costs, ["dorm_id", "label", "period", "amount"])


PROVENANCE_FIELDS = ("has_ac", "bathroom_style", "yearly_cost", "kitchen", "laundry", "elevator", "freshman", "upperclass", "dorm_type", "name")


def provenance_rows(halls: DataFrame, fields: tuple[str, ...] = PROVENANCE_FIELDS) -> DataFrame:
    """A row (dorm_id, field, value) per known fact."""
    long = halls.select(c("id").alias("dorm_id"), *[c(f).cast("string").alias(f) for f in fields]).unpivot(["dorm_id"], list(fields), "field", "value")
    return long.where("value IS NOT NULL")


def append_provenance(halls: DataFrame, provenance: DataFrame, source_id: Column, fields: tuple[str, ...] = PROVENANCE_FIELDS) -> DataFrame:
    return append_missing(provenance, provenance_rows(halls, fields).withColumn("source_id", source_id), ["dorm_id", "field", "value", "source_id"])


def open_conflicts(conflicts: DataFrame, existing: DataFrame) -> DataFrame:
    """One open conflict per hall and field: those that are not open already."""
    first = conflicts.withColumn("k", F.row_number().over(Window.partitionBy("dorm_id", "field").orderBy(F.desc("ts"), "value", "source_id"))).where("k = 1").drop("k")
    return append_missing(existing.where("status = 'OPEN'"), first, ["dorm_id", "field"])


def backfill_unknown(halls: DataFrame, provenance: DataFrame, facts: dict[str, str]) -> DataFrame:
    """Facts (column to field name) of unverified halls that no provenance backs become unknown."""
    backed = provenance.groupBy(c("dorm_id").alias("id")).agg(*[F.max(F.when(c("field") == field, True)).alias(f"__{column}") for column, field in facts.items()])
    joined = halls.join(backed, "id", "left")
    for column in facts:
        joined = joined.withColumn(column, F.when(c("is_verified") | c(f"__{column}"), c(column)))
    return joined.drop(*[f"__{column}" for column in facts])


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder of the session's spark.checkpoint.dir; on a local master without one, as in tests, in a new folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="hallspark-"))
    return df.checkpoint()


def merge_closure(merge_map: DataFrame) -> DataFrame:
    """Each from_id with the end of its chain of merges, by pointer jumping: every round halves what is left of a chain. Of several targets the least counts; merges that lead back into themselves are left out."""
    current = _cut(merge_map.where("from_id <> to_id").groupBy("from_id").agg(F.min("to_id").alias("to_id")))
    for _ in range(current.count().bit_length() + 1):
        onward = current.select(c("from_id").alias("to_id"), c("to_id").alias("onward"))
        jumped = current.join(onward, "to_id", "left")
        if not jumped.where("onward IS NOT NULL").limit(1).count():
            return current
        current = _cut(jumped.select("from_id", F.coalesce("onward", "to_id").alias("to_id")))
    return current.join(current.select(c("from_id").alias("to_id")), "to_id", "left_anti").select("from_id", "to_id")


#: Rows that are ranked are shuffled into at least so many parts, as a task sorts the whole of one.
RANKED_PARTS = 192


def remap(rows: DataFrame, merge_map: DataFrame, column: str = "dorm_id", unique: list[str] | None = None) -> DataFrame:
    """Rows moved to the hall that theirs merges into; of rows that then have equal ``unique`` columns the target's own stays, else that of the least hall.

    A task holds its part of the merges, which are fewer than the rows, and rows stream past it unsorted; only ranking sorts them, once, after their shuffle."""
    m = merge_map.select(c("from_id").alias("__from"), c("to_id").alias("__to")).hint("shuffle_hash")
    moved = rows.join(m, c(column) == c("__from"), "left").withColumn(column, F.coalesce("__to", column))
    if unique:
        parts = max(RANKED_PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        nth = F.row_number().over(Window.partitionBy(*unique).orderBy(c("__from").asc_nulls_first()))
        moved = moved.drop("__to").repartition(parts, *unique).withColumn("__nth", nth).where("__nth = 1").drop("__nth")
    return moved.drop("__from", "__to")


def merge_counters(rows: DataFrame, merge_map: DataFrame, column: str = "dorm_id") -> DataFrame:
    m = merge_map.select(c("from_id").alias(column), "to_id")
    return rows.join(m, column).groupBy("to_id").agg(F.count("*").alias("n_migrated"))


def merged_counters(merge_map: DataFrame, **tables: DataFrame) -> DataFrame:
    """Rows of each table that move, by target: table, to_id, n_migrated, in one pass over the stacked tables. Rows are counted by hall before they meet the merges, so a task sorts halls, not rows."""
    stacked = [rows.select(F.lit(name).alias("table"), "dorm_id") for name, rows in tables.items()]
    counted = reduce(DataFrame.unionByName, stacked).groupBy("table", "dorm_id").agg(F.count("*").alias("n"))
    moved = counted.join(merge_map.select(c("from_id").alias("dorm_id"), "to_id"), "dorm_id")
    return moved.groupBy("table", "to_id").agg(F.sum("n").alias("n_migrated"))


def merge_halls(merge_map: DataFrame, halls: DataFrame, reviews: DataFrame, links: DataFrame, provenance: DataFrame, favorites: DataFrame | None = None, corrections: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables after duplicates moved into the ends of their chains (:func:`merge_closure`): children, reviews, links and favorites (both unique: a hall's own row stays), provenance and corrections follow; the duplicates are marked with what they duplicate. A hall whose parent merges into it loses that parent."""
    ends = merge_closure(merge_map)
    gone = ends.select(c("from_id").alias("id"), c("to_id").alias("duplicate_of"))
    marked = remap(halls.drop("duplicate_of"), ends, "parent_id").join(gone, "id", "left")
    duplicate = c("duplicate_of").isNotNull()
    marked = marked.withColumns({"status": F.when(duplicate, "DUPLICATE").otherwise(c("status")), "is_active": c("is_active") & ~duplicate, "parent_id": F.when(c("parent_id") != c("id"), c("parent_id"))})
    out = {"halls": marked, "reviews": remap(reviews, ends), "links": remap(links, ends, unique=["dorm_id", "source_id"]), "provenance": remap(provenance, ends)}
    if favorites is not None:
        out["favorites"] = remap(favorites, ends, unique=["user_id", "dorm_id"])
    if corrections is not None:
        out["corrections"] = remap(corrections, ends)
    return out


def quarantine(halls: DataFrame, candidates: DataFrame, deactivate: bool = True) -> DataFrame:
    """Changes with an audit of the values before and after."""
    own = halls.join(candidates.select("id", "reason"), "id")
    active = F.lit(False) if deactivate else c("is_active")
    return own.select("id", "reason", F.struct("status", "is_active").alias("before"), F.struct(F.lit("QUARANTINED").alias("status"), active.alias("is_active")).alias("after"), F.lit("QUARANTINED").alias("status"), active.alias("is_active"))


def restore_false_positives(halls: DataFrame) -> DataFrame:
    return halls.where((c("status") == "QUARANTINED") & F.lower("name").contains("apartment") & assess_name(c("name")).isNull()).select("id", F.lit("ACTIVE").alias("status"), F.lit(True).alias("is_active"))


def set_field(halls: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Changes of one column (assignability, parent, verification) where the value differs; wanted: id, value."""
    changed = halls.join(wanted, "id").where(~c(column).eqNullSafe(c("value")))
    if column == "parent_id":
        changed = changed.where(~c("value").eqNullSafe(c("id")))
    return changed.select("id", c("value").alias(column))


def apply_moderation(reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Reviews with their latest moderation (review_id, status, ts)."""
    last = events.groupBy("review_id").agg(F.max(F.struct("ts", "status")).alias("m"))
    return reviews.join(last, "review_id", "left").withColumn("status", F.coalesce("m.status", "status")).drop("m")


def select_targets(colleges: DataFrame, checkpoints: DataFrame, mode: str, *, state: str | None = None, slugs: list[str] | None = None, least_population: int | None = None, stale_days: int = 90, limit: int = 50, offset: int = 0) -> DataFrame:
    """Institutions that a crawl takes next, by mode; those of at least ``least_population`` first; never online schools, never locked ones."""
    rows = colleges.where(~F.lower("name").rlike(r"\b(online|global|world campus)\b")).join(checkpoints.select(c("college_id").alias("id"), c("status").alias("checkpoint"), "locked_minutes_ago"), "id", "left")
    rows = rows.where(~F.coalesce((c("checkpoint") == "RUNNING") & c("locked_minutes_ago").between(0, 30), F.lit(False)))
    known = {
        "slugs": c("slug").isin(*(slugs or [""])),
        "state": c("state") == (state or ""),
        "blocked": c("coverage_status") == "BLOCKED",
        "retry": c("coverage_status") == "RETRYABLE",
        "partial": c("coverage_status") == "PARTIAL",
        "stale": c("inventory_days") > stale_days,
        "discovery": c("coverage_status").isin("UNKNOWN", "SITE_FOUND", "DIRECTORY_PENDING") & (F.coalesce("housing_url", F.lit("")) == ""),
        "validate": c("coverage_status") == "COMPLETE",
        "nationwide": F.coalesce(c("has_housing"), F.lit(True)) & (c("coverage_status") != "NO_HOUSING"),
    }
    first = F.coalesce(c("population") >= least_population, F.lit(False)) if least_population else F.lit(True)
    return rows.where(known[mode]).orderBy(F.desc(first), F.desc_nulls_last("population"), "name", "id").offset(offset).limit(limit)


def claimable(checkpoints: DataFrame, ttl_minutes: int = 30) -> DataFrame:
    """Backlog rows that are due and whose lock is free or expired, oldest retry first."""
    due = c("retry_due_minutes").isNull() | (c("retry_due_minutes") <= 0)
    free = ~F.coalesce((c("status") == "RUNNING") & (c("locked_minutes_ago") >= 0) & (c("locked_minutes_ago") < ttl_minutes), F.lit(False))
    return checkpoints.where(c("status").isin("PENDING", "RETRYABLE", "PARTIAL", "RUNNING") & due & free).orderBy(F.asc_nulls_first("retry_due_minutes"), "college_id")


def checkpoint_after_failure(failures: DataFrame) -> DataFrame:
    """Blocked for a week on a refusal (401, 403), else retryable after an hour; one retry more."""
    blocked = c("message").rlike(r"\b(401|403)\b|(?i)forbidden|unauthorized")
    return failures.select("college_id", F.when(blocked, "BLOCKED").otherwise("RETRYABLE").alias("status"), F.when(blocked, 7 * 24 * 60).otherwise(60).cast("long").alias("retry_in_minutes"), (c("retry_count") + 1).alias("retry_count"))


def checkpoint_after_crawl(decided: DataFrame) -> DataFrame:
    """Stage and status of a checkpoint after a crawl with a coverage decision."""
    done = c("coverage").isin("COMPLETE", "NO_HOUSING")
    return decided.select("college_id", "coverage", F.when(done, "complete").when(c("coverage") == "PARTIAL", "inventory").otherwise("discovery").alias("stage"), F.when(done, "COMPLETED").when(c("coverage") == "BLOCKED", "BLOCKED").when(c("coverage") == "RETRYABLE", "RETRYABLE").otherwise("PARTIAL").alias("status"))


def crawl_outcomes(decided: DataFrame) -> DataFrame:
    """What a crawl leaves in checkpoint and institution: decided rows have college_id, coverage, blocked, n_unique, site_found and directory_sources.

    Halls found make an inventory success, a site or directory found a discovery success; each renews its time where
    ``renews_`` says so. The failure class is ``access_restricted`` of a blocked crawl, else ``empty_extraction`` of one without halls."""
    inventory, discovery = c("n_unique") > 0, c("site_found") | (c("directory_sources") > 0)
    complete = c("coverage") == "COMPLETE"
    stage = F.when(complete, "complete").when(inventory, "enrich").when(discovery, "directory").otherwise("discover")
    status = F.when(c("coverage").isin("BLOCKED", "RETRYABLE"), c("coverage")).when(complete, "COMPLETED").when(inventory, "PARTIAL").otherwise("RETRYABLE")
    failure = F.when(c("blocked"), "access_restricted").when(~inventory, "empty_extraction")
    return decided.select("college_id", "coverage", stage.alias("stage"), status.alias("status"), failure.alias("failure_class"), inventory.alias("renews_inventory"), discovery.alias("renews_discovery"), F.when(inventory, True).otherwise(c("has_housing")).alias("has_housing"), complete.alias("directory_exhausted"))


def match_institutions(incoming: DataFrame, colleges: DataFrame) -> DataFrame:
    """The stored institution of each incoming one (ipeds_id, name, slug): by ipeds id, else by slug unless that belongs to another ipeds id."""
    by_id = colleges.where("ipeds_id IS NOT NULL").select("ipeds_id", c("id").alias("id_by_ipeds"))
    by_slug = colleges.select("slug", c("id").alias("id_by_slug"), c("ipeds_id").alias("other_ipeds"))
    usable = c("other_ipeds").isNull() | c("other_ipeds").eqNullSafe(c("ipeds_id"))
    return incoming.join(by_id, "ipeds_id", "left").join(by_slug, "slug", "left").withColumn("college_id", F.coalesce("id_by_ipeds", F.when(usable, c("id_by_slug")))).drop("id_by_ipeds", "id_by_slug", "other_ipeds")


def assign_slugs(incoming: DataFrame, colleges: DataFrame, tie: str | None = None) -> DataFrame:
    """A slug for each incoming institution (ipeds_id, name): its name's, or with the ipeds id, or numbered from 2, so that none is given twice and no stored one again.

    Within a name the order is that of ipeds ids, nulls last, then of ``tie``. A name without letters or digits gives ``institution``, with the ipeds id if there is one."""
    stored = colleges.where("slug IS NOT NULL").select("slug").distinct()
    plain = slugify(c("name"))
    base = F.when(F.coalesce(plain, F.lit("")) != "", plain).otherwise(F.concat_ws("-", F.lit("institution"), c("ipeds_id").cast("string")))
    order = Window.partitionBy("base").orderBy(F.asc_nulls_last("ipeds_id"), "name", *([tie] if tie else []))
    ranked = incoming.withColumns({"base": base, "with_id": F.when(c("ipeds_id").isNotNull(), F.concat_ws("-", base, c("ipeds_id").cast("string")))}).withColumn("k", F.row_number().over(order))
    first = ranked.join(stored.select(c("slug").alias("base"), F.lit(True).alias("base_stored")), "base", "left").withColumn("own", c("base_stored").isNull() & (c("k") == 1))
    # what names of the batch will take as they are, and what is stored, no suffix may give again
    whole = stored.unionByName(first.where("own").select(c("base").alias("slug"))).distinct()
    second = first.join(whole.select(c("slug").alias("with_id"), F.lit(True).alias("id_taken")), "with_id", "left")
    second = second.withColumn("by_id", ~c("own") & c("with_id").isNotNull() & c("id_taken").isNull())
    taken = whole.unionByName(second.where("by_id").select(c("with_id").alias("slug"))).distinct()
    numbers = taken.select(F.regexp_replace("slug", r"-\d+$", "").alias("base"), F.try_to_number(F.regexp_extract("slug", r"-([1-9]\d{0,8})$", 1), F.lit("999999999")).cast("int").alias("number")).where("number >= 2")
    left = second.where("NOT own AND NOT by_id").withColumn("j", F.row_number().over(order))
    # the j-th number that is free: number - (how many taken ones lie below) counts the free ones before it
    gaps = numbers.withColumn("free_before", c("number") - 1 - F.row_number().over(Window.partitionBy("base").orderBy("number")))
    below = left.select("base", "j").join(gaps, "base", "left").groupBy("base", "j").agg(F.count_if(c("free_before") < c("j")).cast("int").alias("skipped"))
    numbered = left.join(below, ["base", "j"]).withColumn("slug", F.concat_ws("-", "base", (c("j") + 1 + c("skipped")).cast("string"))).drop("j", "skipped")
    done = second.where("own OR by_id").withColumn("slug", F.when(c("own"), c("base")).otherwise(c("with_id")))
    return done.unionByName(numbered).drop("k", "base", "with_id", "own", "by_id", "base_stored", "id_taken")


def import_institutions(parsed: DataFrame, colleges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(change set, counters) of an import: closed institutions are dropped, known ones updated, others created with fresh slugs."""
    valid = parsed.where("name IS NOT NULL AND state IS NOT NULL")
    opened = valid.where(F.coalesce(c("operating"), F.lit(1)) == 1)
    matched = match_institutions(opened.withColumn("slug", slugify(c("name"))), colleges)
    known = matched.where("college_id IS NOT NULL")
    fresh = assign_slugs(matched.where("college_id IS NULL").drop("slug"), colleges)
    changes = known.unionByName(fresh)
    counters = parsed.agg(F.count("*").alias("fetched"), F.count_if(c("name").isNull() | c("state").isNull()).alias("skipped_invalid"), F.count_if(c("name").isNotNull() & c("state").isNotNull() & (F.coalesce(c("operating"), F.lit(1)) != 1)).alias("skipped_closed"))
    return changes, counters


def changed_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages (college_id, url, final_url, hash, version) that no stored source of the institution has seen with this hash and extractor version, under either URL: two anti joins on narrow keys."""
    seen = sources.select("college_id", c("url").alias("seen_url"), "hash", "version")
    by_url = pages.join(seen, (pages.college_id == seen.college_id) & (pages.url == seen.seen_url) & (pages.hash == seen.hash) & (pages.version == seen.version), "left_anti")
    return by_url.join(seen, (by_url.college_id == seen.college_id) & (by_url.final_url == seen.seen_url) & (by_url.hash == seen.hash) & (by_url.version == seen.version), "left_anti")


def upsert_halls(resolved: DataFrame, halls: DataFrame) -> DataFrame:
    """Stored halls with the facts that extracted ones know; new halls are added."""
    return merge_upsert(halls, resolved.dropDuplicates(["id"]), ["id"])


# Last path parts of shared directory pages, and of complexes that are no numbered unit, as in the source data.
DIRECTORY_PATHS = r"^(residence-halls|explore-housing-options|housing|undergraduate|graduate|apartments)$"
NAMED_COMPLEXES = r"foothill|stern|clark-kerr|theme-programs"


def mismatched_links(links: DataFrame) -> DataFrame:
    """Links (name, slug, url) whose URL ends in the page of another unit or, for a numbered unit, of a named complex. Directory pages, and ends that hold the hall's slug or are held by it, are right."""
    end = F.lower(F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"^\w+://[^/]+/(?:.*/)?([^/]+)/*$", 1))
    own = F.lower("slug")
    same = (end == own) | (end == F.regexp_replace(F.lower("name"), r"\s+", "-")) | end.contains(own) | own.contains(end)
    complexes = end.rlike(NAMED_COMPLEXES) & own.rlike(r"^unit-\d") & ~own.contains(F.split_part(end, F.lit("-"), F.lit(1)))
    return links.where((end != "") & ~end.rlike(DIRECTORY_PATHS) & ~same & (end.rlike(r"unit-\d") | complexes))


def with_audit(rows: DataFrame, changes: DataFrame, action: str) -> DataFrame:
    """Changes (id and columns of rows) that alter something, each with the action and the values before and after."""
    fields = [k for k in changes.columns if k != "id" and k in rows.columns]
    old = rows.select("id", F.struct(*fields).alias("before"))
    audited = changes.join(old, "id").withColumn("after", F.struct(*fields)).where(~c("before").eqNullSafe(c("after")))
    return audited.select("id", F.lit(action).alias("action"), "before", "after", *fields)


def latest_flags(events: DataFrame, key: str, value: str) -> DataFrame:
    """The last decision of each key (id, value) out of events (key, ts, id, value); equal times go by the greater event id. For :func:`set_field`: approvals of sources, verifications of halls."""
    last = events.groupBy(c(key).alias("id")).agg(F.max(F.struct("ts", c("id").alias("event"), c(value).alias("value"))).alias("last"))
    return last.select("id", "last.value")


def repair_titles(sources: DataFrame) -> DataFrame:
    """Titles that end in a generic phrase are made from the URL; directories get a fixed one."""
    from ..functions.urls import title_from_slug

    generic = F.lower(F.coalesce("title", F.lit(""))).rlike("housing page$|^$")
    return sources.withColumn("title", F.when(generic & c("page_role").contains("directory"), "Official housing directory").when(generic, title_from_slug(c("url"))).otherwise(c("title")))
