"""Change sets of stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import slugify
from ..operators import maintenance as t
from ..operators import reports as r
from ..operators import resolution as o
from ..plans.jobs import recompute_scores
from .base import query
from .matching import PARTS, SCORED
from .reporting import DECIDED, RUN_COVERAGE, counters, run_counters, run_counts
from .resolving import PAIRS

c = F.col
MAP = f"SELECT greatest(id_a, id_b) AS from_id, min(least(id_a, id_b)) AS to_id FROM ({PAIRS}) d WHERE score = 1e0 GROUP BY 1"


def merges(v):
    return o.safe_merge_map(o.duplicate_pairs(v("v_dorm"), exact_one=True))


@query("SELECT id, name, CASE WHEN id % 3 = 0 THEN coalesce(CASE WHEN id % 2 = 0 THEN 1000e0 + id END, yearly_cost) ELSE yearly_cost END AS yearly_cost, has_ac FROM {v_dorm} WHERE id % 7 <> 3 UNION ALL SELECT id, concat(name, ' new'), CASE WHEN id % 2 = 0 THEN 1000e0 + id END, NULL FROM {v_dorm} WHERE id % 7 = 3")
def keyed_upsert(v):
    """A share of the halls arrives only as changes, another as changes of stored ones."""
    halls = v("v_dorm").select("id", "name", "yearly_cost", "has_ac")
    changes = halls.where("id % 3 = 0 OR id % 7 = 3").select("id", F.concat("name", F.lit(" new")).alias("name"), F.when(c("id") % 2 == 0, 1000.0 + c("id")).alias("yearly_cost"))
    return t.merge_upsert(halls.where("id % 7 <> 3"), changes, ["id"], ["yearly_cost"])


@query(f"SELECT coalesce(to_id, dorm_id) AS dorm_id, count(*) AS n, sum(CAST(rating AS BIGINT))::BIGINT AS ratings FROM {{v_review}} LEFT JOIN ({MAP}) m ON dorm_id = from_id GROUP BY 1")
def merge_remap_reviews(v):
    moved = t.remap(v("v_review"), merges(v))
    return moved.groupBy("dorm_id").agg(F.count("*").alias("n"), F.sum("rating").alias("ratings"))


@query(f"SELECT DISTINCT coalesce(to_id, dorm_id) AS dorm_id, source_id FROM {{v_dorm_source}} LEFT JOIN ({MAP}) m ON dorm_id = from_id")
def merge_remap_links(v):
    return t.remap(v("v_dorm_source"), merges(v), unique=["dorm_id", "source_id"])


@query(f"SELECT to_id, count(*) AS n_migrated FROM {{v_review}} JOIN ({MAP}) m ON dorm_id = from_id GROUP BY to_id")
def merge_counters(v):
    return t.merge_counters(v("v_review"), merges(v))


@query(f"SELECT d.id, CASE WHEN coalesce(p.to_id, d.parent_id) <> d.id THEN coalesce(p.to_id, d.parent_id) END AS parent_id, CASE WHEN g.from_id IS NULL THEN d.status ELSE 'DUPLICATE' END AS status, d.is_active AND g.from_id IS NULL AS is_active FROM {{v_dorm}} d LEFT JOIN ({MAP}) p ON d.parent_id = p.from_id LEFT JOIN ({MAP}) g ON d.id = g.from_id")
def merged_halls(v):
    tables = t.merge_halls(merges(v), v("v_dorm"), v("v_review"), v("v_dorm_source"), v("v_provenance"))
    return tables["halls"].select("id", "parent_id", "status", "is_active")


#: Chains of up to three merges: three of four halls merge into the one before them of their institution.
CHAIN = "SELECT id AS from_id, id - ns AS to_id, id - CAST(floor(id / ns) AS BIGINT) % 4 * ns AS ends_at FROM {v_dorm}, (SELECT count(*) AS ns FROM {supplier}) n WHERE CAST(floor(id / ns) AS BIGINT) % 4 > 0 AND id - CAST(floor(id / ns) AS BIGINT) % 4 * ns > 0"
ENDS = f"WITH RECURSIVE chain AS ({CHAIN}), walk AS (SELECT from_id, to_id FROM chain UNION ALL SELECT w.from_id, x.to_id FROM walk w JOIN chain x ON x.from_id = w.to_id) SELECT from_id, min(to_id) AS to_id FROM walk GROUP BY from_id"
FAVORITES = "SELECT DISTINCT user_id, dorm_id, concat('note ', CAST(dorm_id AS VARCHAR(9))) AS notes FROM {v_review}"


def chains(v):
    ns = v("supplier").agg(F.count("*").alias("ns"))
    step = F.floor(c("id") / c("ns")) % 4
    rows = v("v_dorm").select("id").crossJoin(F.broadcast(ns)).where((step > 0) & (c("id") - step * c("ns") > 0))
    return rows.select(c("id").alias("from_id"), (c("id") - c("ns")).alias("to_id"))


def chained(v):
    # a user's favorites of one hall are equal rows, of which merging keeps one
    favorites = v("v_review").select("user_id", "dorm_id", F.concat(F.lit("note "), c("dorm_id").cast("string")).alias("notes"))
    corrections = v("v_review").where("flag = 'R'").select("dorm_id", "user_id", "n")
    return t.merge_halls(chains(v), v("v_dorm"), v("v_review"), v("v_dorm_source"), v("v_provenance"), favorites, corrections)


@query(f"SELECT d.id, CASE WHEN coalesce(p.to_id, d.parent_id) <> d.id THEN coalesce(p.to_id, d.parent_id) END AS parent_id, CASE WHEN g.from_id IS NULL THEN d.status ELSE 'DUPLICATE' END AS status, d.is_active AND g.from_id IS NULL AS is_active, g.to_id AS duplicate_of FROM {{v_dorm}} d LEFT JOIN ({ENDS}) p ON d.parent_id = p.from_id LEFT JOIN ({ENDS}) g ON d.id = g.from_id")
def merged_chains(v):
    return chained(v)["halls"].select("id", "parent_id", "status", "is_active", "duplicate_of")


@query(f"SELECT user_id, root AS dorm_id, notes FROM (SELECT user_id, coalesce(to_id, dorm_id) AS root, notes, row_number() OVER (PARTITION BY user_id, coalesce(to_id, dorm_id) ORDER BY from_id IS NOT NULL, from_id) AS rn FROM ({FAVORITES}) f LEFT JOIN ({ENDS}) m ON dorm_id = from_id) z WHERE rn = 1")
def merged_chain_favorites(v):
    return chained(v)["favorites"]


@query(f"SELECT coalesce(to_id, dorm_id) AS dorm_id, count(*) AS n, sum(CAST(n AS BIGINT))::BIGINT AS lines FROM {{v_review}} LEFT JOIN ({ENDS}) m ON dorm_id = from_id WHERE flag = 'R' GROUP BY 1")
def merged_chain_corrections(v):
    return chained(v)["corrections"].groupBy("dorm_id").agg(F.count("*").alias("n"), F.sum("n").cast("long").alias("lines"))


@query(f"SELECT 'reviews' AS \"table\", to_id, count(*) AS n_migrated FROM {{v_review}} JOIN ({ENDS}) m ON dorm_id = from_id GROUP BY to_id UNION ALL SELECT 'links', to_id, count(*) FROM {{v_dorm_source}} JOIN ({ENDS}) m ON dorm_id = from_id GROUP BY to_id UNION ALL SELECT 'provenance', to_id, count(*) FROM {{v_provenance}} JOIN ({ENDS}) m ON dorm_id = from_id GROUP BY to_id")
def merged_chain_counters(v):
    return t.merged_counters(t.merge_closure(chains(v)), reviews=v("v_review"), links=v("v_dorm_source"), provenance=v("v_provenance"))


@query("SELECT dorm_id, source_id FROM {v_dorm_source} WHERE source_id % 3 = 0 EXCEPT SELECT dorm_id, source_id FROM {v_dorm_source} WHERE dorm_id % 2 = 0")
def legacy_link_reconcile(v):
    links = v("v_dorm_source")
    return t.unlinked_sources(links.where("source_id % 3 = 0"), links.where("dorm_id % 2 = 0"))


@query("SELECT id AS dorm_id, 'has_ac' AS field, CAST(has_ac AS VARCHAR) AS value FROM {v_dorm} WHERE has_ac IS NOT NULL UNION ALL SELECT id, 'bathroom_style', bathroom_style FROM {v_dorm} UNION ALL SELECT id, 'kitchen', CAST(kitchen AS VARCHAR) FROM {v_dorm} WHERE kitchen IS NOT NULL")
def provenance_append(v):
    existing = v("v_provenance").select("dorm_id", "field", "value", "source_id")
    rows = t.append_provenance(v("v_dorm"), existing, F.lit(-1).cast("long"), ("has_ac", "bathroom_style", "kitchen"))
    return rows.select("dorm_id", "field", "value")


@query("SELECT id, CASE WHEN is_verified OR EXISTS (SELECT 1 FROM {v_provenance} p WHERE p.dorm_id = d.id AND p.field = 'hasAC') THEN has_ac END AS has_ac, CASE WHEN is_verified OR EXISTS (SELECT 1 FROM {v_provenance} p WHERE p.dorm_id = d.id AND p.field = 'laundry') THEN laundry END AS laundry FROM {v_dorm} d")
def eligibility_backfill(v):
    return t.backfill_unknown(v("v_dorm"), v("v_provenance"), {"has_ac": "hasAC", "laundry": "laundry"}).select("id", "has_ac", "laundry")


@query("SELECT id, 'test' AS reason, status AS before, 'QUARANTINED' AS after FROM {v_dorm} WHERE id % 10 = 0")
def quarantine_changes(v):
    chosen = v("v_dorm").where("id % 10 = 0").select("id", F.lit("test").alias("reason"))
    return t.quarantine(v("v_dorm"), chosen).select("id", "reason", c("before.status").alias("before"), c("after.status").alias("after"))


@query("SELECT id FROM {v_dorm} WHERE status = 'QUARANTINED' AND lower(name) LIKE '%apartment%'")
def restored_false_positives(v):
    return t.restore_false_positives(v("v_dorm")).select("id")


@query("SELECT id, false AS assignable FROM {v_dorm} WHERE id % 8 = 0 AND assignable IS DISTINCT FROM false")
def assignability_changes(v):
    wanted = v("v_dorm").where("id % 8 = 0").select("id", F.lit(False).alias("value"))
    return t.set_field(v("v_dorm"), wanted, "assignable")


TARGETS = "SELECT k.id, k.name FROM {v_college} k LEFT JOIN {v_checkpoint} p ON p.college_id = k.id WHERE NOT (coalesce(p.status = 'RUNNING' AND locked_minutes_ago BETWEEN 0 AND 30, false)) AND @MODE@ ORDER BY coalesce(population >= 10000, false) DESC, population DESC NULLS LAST, name, k.id LIMIT 50"


def _targets(mode: str, **options):
    return lambda v: t.select_targets(v("v_college"), v("v_checkpoint"), mode, least_population=10000, **options).select("id", "name")


for _mode, _sql, _options in (
    ("nationwide", "coalesce(has_housing, true) AND coverage_status <> 'NO_HOUSING'", {}),
    ("state", "state = 'CA'", {"state": "CA"}),
    ("stale", "inventory_days > 90", {}),
    ("retry", "coverage_status = 'RETRYABLE'", {}),
    ("blocked", "coverage_status = 'BLOCKED'", {}),
    ("partial", "coverage_status = 'PARTIAL'", {}),
    ("validate", "coverage_status = 'COMPLETE'", {}),
    ("discovery", "coverage_status IN ('UNKNOWN', 'SITE_FOUND', 'DIRECTORY_PENDING') AND coalesce(housing_url, '') = ''", {}),
    ("slugs", "slug IN ('college-1', 'college-5')", {"slugs": ["college-1", "college-5"]}),
):
    _f = _targets(_mode, **_options)
    _f.__name__ = f"target_selection_{_mode}"
    query(TARGETS.replace("@MODE@", _sql))(_f)


@query("SELECT college_id, status FROM {v_checkpoint} WHERE status IN ('PENDING', 'RETRYABLE', 'PARTIAL', 'RUNNING') AND (retry_due_minutes IS NULL OR retry_due_minutes <= 0) AND NOT (status = 'RUNNING' AND locked_minutes_ago >= 0 AND locked_minutes_ago < 30)")
def claimable_backlog(v):
    return t.claimable(v("v_checkpoint")).select("college_id", "status")


@query("SELECT college_id, CASE WHEN college_id % 3 = 0 THEN 'BLOCKED' ELSE 'RETRYABLE' END AS status, CAST(CASE WHEN college_id % 3 = 0 THEN 10080 ELSE 60 END AS BIGINT) AS retry_in_minutes, retry_count + 1 AS retry_count FROM {v_checkpoint}")
def failure_transitions(v):
    failures = v("v_checkpoint").withColumn("message", F.when(c("college_id") % 3 == 0, "HTTP 403 Forbidden").otherwise("timeout"))
    return t.checkpoint_after_failure(failures)


@query(f"SELECT job_id, coverage, CASE WHEN coverage IN ('COMPLETE', 'NO_HOUSING') THEN 'complete' WHEN coverage = 'PARTIAL' THEN 'inventory' ELSE 'discovery' END AS stage, CASE WHEN coverage IN ('COMPLETE', 'NO_HOUSING') THEN 'COMPLETED' WHEN coverage IN ('BLOCKED', 'RETRYABLE') THEN coverage ELSE 'PARTIAL' END AS status FROM ({DECIDED}) d")
def checkpoint_transitions(v):
    decided = r.decide_coverage(counters(v)).withColumn("college_id", c("job_id"))
    return t.checkpoint_after_crawl(decided).withColumnRenamed("college_id", "job_id")


@query("SELECT dorm_id, field, count(*) AS n FROM (SELECT DISTINCT dorm_id, field FROM {v_provenance} WHERE dorm_id % 2 = 1) x GROUP BY dorm_id, field")
def opened_conflicts(v):
    rows = v("v_provenance").select("dorm_id", "field", "value", "source_id", "ts")
    existing = rows.where("dorm_id % 2 = 0").select("dorm_id", "field", F.lit("OPEN").alias("status"))
    return t.open_conflicts(rows, existing).groupBy("dorm_id", "field").agg(F.count("*").alias("n"))


@query("SELECT page_id FROM {pages} WHERE NOT (page_id % 3 = 0 AND page_id % 2 = 0)")
def unchanged_pages(v):
    pages = v("pages").select("page_id", (c("page_id") % 7).alias("college_id"), "url", c("url").alias("final_url"), F.substring(F.sha2("html", 256), 1, 32).alias("hash"), F.lit(2).alias("version"))
    seen = pages.where("page_id % 3 = 0").withColumn("version", F.when(c("page_id") % 2 == 0, 2).otherwise(1)).select("college_id", "url", "hash", "version")
    return t.changed_pages(pages, seen).select("page_id")


@query("SELECT id AS dorm_id, count(*) AS n_moderated FROM {v_dorm} WHERE id % 2 = 0 GROUP BY id")
def moderated_halls(v):
    rows = v("v_dorm").select(c("id").alias("review_id"), F.lit("PENDING").alias("status"))
    events = rows.where("review_id % 2 = 0").select("review_id", F.lit(1).alias("ts"), F.lit("REJECTED").alias("status")).unionByName(rows.where("review_id % 2 = 0").select("review_id", F.lit(2).alias("ts"), F.lit("APPROVED").alias("status")))
    return t.apply_moderation(rows, events).where("status = 'APPROVED'").groupBy(c("review_id").alias("dorm_id")).agg(F.count("*").alias("n_moderated"))


@query("SELECT id, CASE WHEN page_role LIKE '%directory%' AND (title IS NULL OR title = '') THEN 'Official housing directory' WHEN title IS NULL OR title = '' THEN 'made' ELSE title END AS title FROM {v_source}")
def repaired_titles(v):
    rows = t.repair_titles(v("v_source").withColumn("had", F.coalesce("title", F.lit("")) != ""))
    return rows.select("id", F.when(c("had") | (c("title") == "Official housing directory"), c("title")).otherwise("made").alias("title"))


@query("SELECT d.id, 'SET_PARENT' AS action, d.parent_id AS before, b.pid AS after FROM {v_dorm} d JOIN (SELECT college_id, min(id) AS pid FROM {v_dorm} WHERE kind = 'BUILDING' GROUP BY 1) b ON b.college_id = d.college_id WHERE d.kind = 'UNIT' AND d.parent_id IS DISTINCT FROM pid")
def parent_changes(v):
    """Units get the first building of their institution as their parent, with an audit."""
    halls = v("v_dorm")
    first = halls.where("kind = 'BUILDING'").groupBy("college_id").agg(F.min("id").alias("value"))
    wanted = halls.where("kind = 'UNIT'").select("id", "college_id").join(first, "college_id").select("id", "value")
    audited = t.with_audit(halls, t.set_field(halls, wanted, "parent_id"), "SET_PARENT")
    return audited.select("id", "action", c("before.parent_id").alias("before"), c("after.parent_id").alias("after"))


@query("SELECT id, 'RESTORED' AS action, status AS before, is_active AS was_active, 'ACTIVE' AS after FROM {v_dorm} WHERE status = 'QUARANTINED' AND lower(name) LIKE '%apartment%'")
def restored_audit(v):
    audited = t.with_audit(v("v_dorm"), t.restore_false_positives(v("v_dorm")), "RESTORED")
    return audited.select("id", "action", c("before.status").alias("before"), c("before.is_active").alias("was_active"), c("after.status").alias("after"))


@query("SELECT s.id, l.ok AS is_approved FROM {v_source} s JOIN (SELECT job_id, value > 50 AS ok, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, id DESC) AS k FROM {v_log}) l ON l.job_id = s.id AND k = 1 WHERE s.is_approved IS DISTINCT FROM l.ok")
def approved_sources(v):
    """The last event about a source approves it or not."""
    wanted = t.latest_flags(v("v_log").withColumn("ok", c("value") > 50), "job_id", "ok")
    return t.set_field(v("v_source"), wanted, "is_approved")


FACTS = "SELECT dorm_id AS id, max(CASE WHEN flag = 'A' THEN price END) AS yearly_cost, bool_or(CASE WHEN flag <> 'A' THEN flag = 'R' END) AS has_ac FROM {v_review} GROUP BY dorm_id"


@query(f"SELECT coalesce(s.id, f.id) AS id, coalesce(f.yearly_cost, s.yearly_cost) AS yearly_cost, coalesce(f.has_ac, s.has_ac) AS has_ac, s.name FROM (SELECT * FROM {{v_dorm}} WHERE kind <> 'HOUSE') s FULL JOIN ({FACTS}) f ON s.id = f.id")
def upserted_halls(v):
    """Facts of reviews meet stored halls; houses are not stored yet."""
    flag = c("flag")
    facts = v("v_review").groupBy(c("dorm_id").alias("id")).agg(F.max(F.when(flag == "A", c("price"))).alias("yearly_cost"), F.bool_or(F.when(flag != "A", flag == "R")).alias("has_ac"))
    return t.upsert_halls(facts, v("v_dorm").where("kind <> 'HOUSE'").select("id", "yearly_cost", "has_ac", "name"))


@query("SELECT l.dorm_id, l.source_id, CASE WHEN s.page_role = 'detail' THEN 'detail' ELSE 'directory' END AS role FROM {v_dorm_source} l JOIN {v_source} s ON s.id = l.source_id WHERE NOT EXISTS (SELECT 1 FROM {v_review} r WHERE r.flag = 'R' AND r.dorm_id = l.dorm_id AND r.s = l.source_id)")
def linked_sources(v):
    roles = v("v_source").select(c("id").alias("source_id"), F.when(c("page_role") == "detail", "detail").otherwise("directory").alias("role"))
    stored = v("v_review").where("flag = 'R'").select("dorm_id", c("s").alias("source_id"))
    return t.link_sources(v("v_dorm_source").join(roles, "source_id"), stored)


COSTS = "SELECT dorm_id, flag AS label, status AS period, price AS amount FROM {v_review}"


@query(f"SELECT * FROM ({COSTS}) a EXCEPT SELECT * FROM ({COSTS} WHERE disc > 0.05) b")
def appended_costs(v):
    costs = v("v_review").select("dorm_id", c("flag").alias("label"), c("status").alias("period"), c("price").alias("amount"), "disc")
    return t.append_costs(costs.drop("disc"), costs.where("disc > 0.05D").drop("disc"))


END = "concat('unit-', CAST(source_id % 5 AS VARCHAR(9)))"


@query(f"SELECT l.dorm_id, l.source_id FROM {{v_dorm_source}} l JOIN {{v_dorm}} d ON d.id = l.dorm_id WHERE source_id % 3 <> 0 AND NOT contains(replace(lower(d.name), ' ', '-'), {END})")
def mismatched_links(v):
    """Links to directories, and to pages of units that halls are or aren't."""
    k = c("source_id")
    url = F.concat(F.lit("https://housing.example.edu/halls/"), F.when(k % 3 == 0, "Residence-Halls/?page=1").otherwise(F.concat(F.lit("Unit-"), (k % 5).cast("string"), F.lit("/#top"))))
    halls = v("v_dorm").select(c("id").alias("dorm_id"), "name", slugify(c("name")).alias("slug"))
    return t.mismatched_links(v("v_dorm_source").join(halls, "dorm_id").withColumn("url", url)).select("dorm_id", "source_id")


@query(f"SELECT id, overall_score, scoreable, score_completeness, data_confidence, {', '.join(f'{k}_score' for k in PARTS)} FROM ({SCORED}) x")
def recomputed_scores(v):
    """All scores from the bridges: amenities are counted and the institution's average taken anew."""
    scored = recompute_scores(v("v_dorm"), v("v_room"), v("v_amenity"))
    return scored.select("id", "overall_score", "scoreable", "score_completeness", "data_confidence", *[f"{k}_score" for k in PARTS])


@query(f"""SELECT college_id, coverage, CASE WHEN coverage = 'COMPLETE' THEN 'complete' WHEN found THEN 'enrich' WHEN seen THEN 'directory' ELSE 'discover' END AS stage, CASE WHEN coverage IN ('BLOCKED', 'RETRYABLE') THEN coverage WHEN coverage = 'COMPLETE' THEN 'COMPLETED' WHEN found THEN 'PARTIAL' ELSE 'RETRYABLE' END AS status,
        CASE WHEN blocked THEN 'access_restricted' WHEN NOT found THEN 'empty_extraction' END AS failure_class, found AS renews_inventory, seen AS renews_discovery, found OR has_housing AS has_housing, coverage = 'COMPLETE' AS directory_exhausted
    FROM (SELECT g.id AS college_id, d.coverage, coalesce(n_unique, 0) > 0 AS found, coalesce(housing_url <> '', false) OR coalesce(n_housing, 0) > 0 OR coalesce(n_directory, 0) > 0 AS seen, coalesce(blocked, false) AS blocked, has_housing
        FROM {{v_college}} g JOIN ({RUN_COVERAGE}) d ON d.college_id = g.id LEFT JOIN ({run_counts("college_id")}) t ON t.college_id = g.id) x""")
def crawl_outcomes(v):
    colleges = v("v_college").select("id", "has_housing", "housing_url", (c("population") % 40).alias("published"))
    return t.crawl_outcomes(r.decide_run_coverage(colleges, run_counters(v)))
