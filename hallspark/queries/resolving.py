"""Duplicates, resolution, hierarchy, conflicts and junk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import reports as r
from ..operators import resolution as o
from .base import query

c = F.col
STRIP = "trim(regexp_replace(lower({x}), 'residence hall|res hall|hall', '', 'g'))"
FUZZY = "CASE WHEN x = y THEN 1e0 WHEN contains(x, y) OR contains(y, x) THEN 0.85e0 ELSE len(list_filter(wx, lambda t: list_contains(wy, t))) / CAST(len(list_distinct(list_concat(wx, wy))) AS DOUBLE) END"
NAMES = f"SELECT *, string_split_regex(x, '\\s+') AS wx FROM (SELECT id, college_id, name, {STRIP.replace('{x}', 'name')} AS x FROM {{v_dorm}}) n"
PAIRS = f"SELECT * FROM (SELECT college_id, id_a, name_a, id_b, name_b, {FUZZY} AS score FROM (SELECT a.college_id, a.id AS id_a, a.name AS name_a, b.id AS id_b, b.name AS name_b, a.x, b.x AS y, a.wx, b.wx AS wy FROM ({NAMES}) a JOIN ({NAMES}) b ON a.college_id = b.college_id AND (a.name < b.name OR (a.name = b.name AND a.id < b.id))) p) s"


@query(f"SELECT * FROM ({PAIRS}) d WHERE score >= 0.85e0 AND score < 1e0")
def duplicate_pairs(v):
    return o.duplicate_pairs(v("v_dorm"))


@query(f"SELECT * FROM ({PAIRS}) d WHERE score = 1e0")
def duplicate_pairs_equal(v):
    return o.duplicate_pairs(v("v_dorm"), exact_one=True)


@query(f"SELECT id, min_by(other, row(-score, other, other_id)) AS duplicate_of, max(score) AS score FROM (SELECT id_a AS id, name_b AS other, id_b AS other_id, score FROM ({PAIRS}) x WHERE score >= 0.85e0 AND score < 1e0 UNION ALL SELECT id_b, name_a, id_a, score FROM ({PAIRS}) y WHERE score >= 0.85e0 AND score < 1e0) b GROUP BY id")
def duplicate_flags(v):
    return o.flag_duplicates(o.duplicate_pairs(v("v_dorm")))


@query(f"SELECT id_a, id_b, score FROM ({PAIRS}) d WHERE score >= 0.85e0 AND score < 1e0 ORDER BY score DESC, id_a, id_b LIMIT 30")
def duplicate_top30(v):
    return o.top_duplicates(o.duplicate_pairs(v("v_dorm"))).select("id_a", "id_b", "score")


@query(f"SELECT greatest(id_a, id_b) AS from_id, min(least(id_a, id_b)) AS to_id FROM ({PAIRS}) d WHERE score = 1e0 GROUP BY 1")
def merge_map(v):
    return o.safe_merge_map(o.duplicate_pairs(v("v_dorm"), exact_one=True))


NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), '\b(the|residence|hall|dormitory|dorm|building|community)\b', ' ', 'g'), '\s+', ' ', 'g'))"


def same(a: str, b: str) -> str:
    """same_entity where names hold no number words or directions, as in the view."""
    na, nb = NORM.replace("{x}", a), NORM.replace("{x}", b)
    fuzzy = FUZZY.replace("wx", f"string_split_regex({STRIP.replace('{x}', a)}, '\\s+')").replace("wy", f"string_split_regex({STRIP.replace('{x}', b)}, '\\s+')")
    fuzzy = fuzzy.replace("x = y", f"{STRIP.replace('{x}', a)} = {STRIP.replace('{x}', b)}").replace("contains(x, y) OR contains(y, x)", f"contains({STRIP.replace('{x}', a)}, {STRIP.replace('{x}', b)}) OR contains({STRIP.replace('{x}', b)}, {STRIP.replace('{x}', a)})")
    digits = lambda n: f"regexp_extract({n}, '([0-9]+)', 1)"
    base = lambda n: f"trim(regexp_replace({n}, ' ?[0-9]+', '', 'g'))"
    return f"CASE WHEN {na} = '' OR {nb} = '' THEN false WHEN {na} = {nb} THEN true WHEN {digits(na)} <> {digits(nb)} THEN false ELSE ({digits(na)} <> '' AND {base(na)} <> '' AND {base(na)} = {base(nb)}) OR {fuzzy} >= 0.92e0 END"


@query(f"SELECT college_id, a.id AS id_a, b.id AS id_b FROM {{v_dorm}} a JOIN {{v_dorm}} b USING (college_id) WHERE a.id < b.id AND {same('a.name', 'b.name')}")
def same_entity_pairs(v):
    d = v("v_dorm").select("college_id", "id", "name")
    met = o.same_names(d.select("college_id", "name"), d.select("college_id", c("name").alias("hall_name")))
    pairs = met.join(d.withColumnRenamed("id", "id_a"), ["college_id", "name"]).join(d.select("college_id", c("id").alias("id_b"), c("name").alias("hall_name")), ["college_id", "hall_name"])
    return pairs.where("id_a < id_b").select("college_id", "id_a", "id_b")


#: Candidates that mean a hall by its slug, by one of its aliases only, by its name, or none; aliases of half of the halls.
ALIAS = "SELECT id AS dorm_id, concat(CASE WHEN id % 4 = 1 THEN 'Old Mill ' ELSE 'St. Anne''s ' END, CAST(id AS VARCHAR(9))) AS alias FROM {v_dorm} WHERE id % 4 IN (1, 2)"
CANDIDATES = "SELECT id AS candidate_id, college_id, CASE id % 5 WHEN 0 THEN concat(' HALL ', CAST(id AS VARCHAR(9)), ' ') WHEN 1 THEN concat('OLD mill - ', CAST(id AS VARCHAR(9))) WHEN 2 THEN concat('st. ANNE''S ', CAST(id AS VARCHAR(9))) WHEN 3 THEN concat('The ', upper(name)) ELSE CASE WHEN id % 2 = 0 THEN '?' ELSE 'Nowhere to be found' END END AS candidate_name FROM {v_dorm}"
SLUG = "regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
RULES = f"""SELECT q.candidate_id, d.id AS hall_id, CASE WHEN {SLUG.replace("{x}", "q.candidate_name")} = d.slug THEN 0 WHEN {SLUG.replace("{x}", "q.candidate_name")} = {SLUG.replace("{x}", "a.alias")} OR lower(trim(q.candidate_name)) = lower(a.alias) THEN 1 WHEN {same("q.candidate_name", "d.name")} THEN 2 END AS rule
    FROM ({CANDIDATES}) q JOIN {{v_dorm}} d ON d.college_id = q.college_id LEFT JOIN ({ALIAS}) a ON a.dorm_id = d.id WHERE length(trim(q.candidate_name)) >= 2 AND {SLUG.replace("{x}", "q.candidate_name")} <> ''"""
RULE = "CASE rule WHEN 0 THEN 'slug' WHEN 1 THEN 'alias' WHEN 2 THEN 'name' END"


def given_candidates(v):
    n, k = c("id").cast("string"), c("id") % 5
    name = F.when(k == 0, F.concat(F.lit(" HALL "), n, F.lit(" "))).when(k == 1, F.concat(F.lit("OLD mill - "), n)).when(k == 2, F.concat(F.lit("st. ANNE'S "), n)).when(k == 3, F.concat(F.lit("The "), F.upper("name"))).otherwise(F.when(c("id") % 2 == 0, "?").otherwise("Nowhere to be found"))
    aliases = v("v_dorm").where("id % 4 IN (1, 2)").select(c("id").alias("dorm_id"), F.concat(F.when(c("id") % 4 == 1, "Old Mill ").otherwise("St. Anne's "), n).alias("alias"))
    return v("v_dorm").select(c("id").alias("candidate_id"), "college_id", name.alias("candidate_name")), aliases


@query(f"SELECT q.candidate_id, m.hall_id, {RULE} AS rule FROM ({CANDIDATES}) q LEFT JOIN (SELECT candidate_id, min(hall_id) AS hall_id, min_by(rule, row(hall_id, rule)) AS rule FROM ({RULES}) r WHERE rule IS NOT NULL GROUP BY candidate_id) m USING (candidate_id)")
def entity_resolution_aliases(v):
    candidates, aliases = given_candidates(v)
    return o.resolve_entities(candidates, v("v_dorm"), aliases).select("candidate_id", "hall_id", "rule")


@query(f"SELECT q.candidate_id, m.hall_id, {RULE} AS rule FROM ({CANDIDATES}) q LEFT JOIN (SELECT candidate_id, min_by(hall_id, row(rule, hall_id)) AS hall_id, min(rule) AS rule FROM ({RULES}) r WHERE rule IS NOT NULL GROUP BY candidate_id) m USING (candidate_id)")
def entity_resolution_cascade(v):
    candidates, aliases = given_candidates(v)
    return o.resolve_entities(candidates, v("v_dorm"), aliases, priority=True).select("candidate_id", "hall_id", "rule")


#: By turns a stored hall with the name of its institution's hall before it as hint, a new one with its own or an earlier new one's name, and one with a hint that means nothing.
NEW = "concat('Rosewood place ', CAST({x} AS VARCHAR(9)))"
HINTED = f"""SELECT d.id AS candidate_id, d.college_id, CASE WHEN k = 0 THEN d.id END AS hall_id, CASE WHEN k = 1 THEN {NEW.replace("{x}", "d.id")} ELSE d.name END AS candidate_name,
        CASE k WHEN 0 THEN concat('The ', upper(p.name)) WHEN 1 THEN {NEW.replace("{x}", "CASE WHEN d.id % 2 = 0 THEN d.id ELSE d.id - 3 * ns END")} ELSE 'Nowhere' END AS parent_hint
    FROM (SELECT *, CAST(floor(id / ns) AS BIGINT) % 3 AS k FROM {{v_dorm}}, (SELECT count(*) AS ns FROM {{supplier}}) n) d LEFT JOIN {{v_dorm}} p ON p.id = d.id - ns"""
HINTED_ORACLE = f"""WITH h AS ({HINTED}), children AS (SELECT h.* FROM h LEFT JOIN {{v_dorm}} d ON d.id = h.hall_id WHERE h.hall_id IS NULL OR d.parent_id IS NULL),
    made AS (SELECT * FROM h WHERE hall_id IS NULL),
    first AS (SELECT x.candidate_id, min(d.id) AS parent_id FROM children x JOIN {{v_dorm}} d ON d.college_id = x.college_id AND d.id IS DISTINCT FROM x.hall_id AND ({same("x.parent_hint", "d.name")} OR lower(x.parent_hint) = lower(d.name)) GROUP BY 1),
    names AS (SELECT college_id, {SLUG.replace("{x}", "candidate_name")} AS slug, min(candidate_id) AS created_id FROM made GROUP BY 1, 2),
    owned AS (SELECT m.*, n.created_id FROM made m JOIN names n ON n.college_id = m.college_id AND n.slug = {SLUG.replace("{x}", "m.candidate_name")}),
    second AS (SELECT x.candidate_id, min(m.created_id) AS parent_created_id FROM children x LEFT JOIN owned w ON w.candidate_id = x.candidate_id JOIN owned m ON m.college_id = x.college_id AND m.created_id IS DISTINCT FROM w.created_id AND ({same("x.parent_hint", "m.candidate_name")} OR lower(x.parent_hint) = lower(m.candidate_name)) WHERE x.candidate_id NOT IN (SELECT candidate_id FROM first) GROUP BY 1)
    SELECT x.hall_id, w.created_id, min(x.candidate_id) AS candidate_id, min_by(f.parent_id, x.candidate_id) AS parent_id, min_by(s.parent_created_id, x.candidate_id) AS parent_created_id FROM children x LEFT JOIN owned w USING (candidate_id) LEFT JOIN first f USING (candidate_id) LEFT JOIN second s USING (candidate_id) WHERE f.parent_id IS NOT NULL OR s.parent_created_id IS NOT NULL GROUP BY 1, 2"""


@query(f"SELECT * FROM ({HINTED_ORACLE}) z")
def parent_hints(v):
    ns = v("supplier").agg(F.count("*").alias("ns"))
    d = v("v_dorm").crossJoin(F.broadcast(ns)).withColumn("k", F.floor(c("id") / c("ns")) % 3)
    before = v("v_dorm").select(c("id").alias("before"), c("name").alias("before_name"))
    new = lambda n: F.concat(F.lit("Rosewood place "), n.cast("string"))
    hint = F.when(c("k") == 0, F.concat(F.lit("The "), F.upper("before_name"))).when(c("k") == 1, new(F.when(c("id") % 2 == 0, c("id")).otherwise(c("id") - 3 * c("ns")))).otherwise("Nowhere")
    rows = d.join(before, c("before") == c("id") - c("ns"), "left").select(c("id").alias("candidate_id"), "college_id", F.when(c("k") == 0, c("id")).alias("hall_id"), F.when(c("k") == 1, new(c("id"))).otherwise(c("name")).alias("candidate_name"), hint.alias("parent_hint"))
    return o.resolve_parents(rows, v("v_dorm"))


@query(f"SELECT q.id AS candidate_id, min(d.id) AS hall_id FROM (SELECT id, college_id, concat('The ', upper(name)) AS name FROM {{v_dorm}}) q LEFT JOIN {{v_dorm}} d ON d.college_id = q.college_id AND {same('q.name', 'd.name')} GROUP BY q.id")
def entity_resolution(v):
    candidates = v("v_dorm").select(c("id").alias("candidate_id"), "college_id", F.concat(F.lit("The "), F.upper("name")).alias("candidate_name"))
    return o.resolve_entities(candidates, v("v_dorm")).select("candidate_id", "hall_id")


AUDIT = "SELECT d.id, d.parent_id, p.id IS NULL AS orphan, d.id = d.parent_id AS self, coalesce(NOT p.is_active, false) AS inactive_parent, p.parent_id IS NOT NULL AS nested, coalesce(p.assignable, false) AS assignable_parent FROM {v_dorm} d LEFT JOIN {v_dorm} p ON d.parent_id = p.id WHERE d.parent_id IS NOT NULL"


@query(AUDIT)
def hierarchy_audit(v):
    return o.hierarchy_audit(v("v_dorm"))


@query(f"SELECT count(*) AS n_links, count(*) FILTER (WHERE orphan) AS n_orphan, count(*) FILTER (WHERE self) AS n_self, count(*) FILTER (WHERE inactive_parent) AS n_inactive_parent, count(*) FILTER (WHERE nested) AS n_nested, count(*) FILTER (WHERE assignable_parent) AS n_assignable_parent FROM ({AUDIT}) a")
def hierarchy_counters(v):
    return o.hierarchy_counters(o.hierarchy_audit(v("v_dorm")))


SAID = "concat(coalesce(description, ''), ' ', coalesce(category_label, ''))"
KINDS = ", ".join(f"'{k}'" for k in o.PARENT_KINDS)
SUGGESTED = rf"""SELECT id, min_by(parent, row(rule, parent)) AS parent_id, min(rule) AS rule, min_by(confidence, row(rule, parent)) AS confidence FROM (
    SELECT id, parent, CASE WHEN phrase THEN 0 WHEN labelled THEN 1 WHEN nested OR unit THEN 2 END AS rule, CASE WHEN phrase THEN 0.85e0 WHEN labelled THEN 0.75e0 WHEN nested THEN CASE WHEN parent_kind = 'UNIT' THEN 0.8e0 ELSE 0.7e0 END ELSE 0.78e0 END AS confidence FROM (
        SELECT x.id, p.id AS parent, p.kind AS parent_kind, hint <> '' AND ({same("p.name", "hint")} OR contains(lower(p.name), lower(hint)) OR contains(lower(hint), lower(p.name))) AS phrase,
            coalesce(label <> '' AND x.kind IN ('BUILDING', 'HOUSE', 'RESIDENCE', 'OTHER', 'UNKNOWN') AND ({same("p.name", "label")} OR lower(p.name) = lower(label) OR contains(lower(label), lower(p.name))), false) AS labelled,
            lower(x.name) <> lower(p.name) AND contains(lower(x.name), lower(p.name)) AND length(x.name) > length(p.name) + 2 AND p.kind IN ({KINDS}) AS nested,
            lower(x.name) <> lower(p.name) AND regexp_extract(p.name, '(?i)unit\s*([0-9]+)', 1) <> '' AND list_contains(regexp_extract_all(lower(said), '\bunit\s*([0-9]+)\b', 1), regexp_extract(p.name, '(?i)unit\s*([0-9]+)', 1)) AS unit
        FROM (SELECT *, {SAID} AS said, trim(category_label) AS label, trim(regexp_extract({SAID}, '(?i)\b(?:part of|located in|within|buildings? (?:in|of)|houses? (?:in|of))\s+([A-Z][A-Za-z0-9 .''&\-]@<2,60>@)', 1)) AS hint FROM {{v_dorm}} WHERE parent_id IS NULL) x
        JOIN {{v_dorm}} p ON p.college_id = x.college_id AND p.id <> x.id AND (p.kind IN ({KINDS}) OR regexp_matches(p.name, '(?i)village|complex|unit\s*[0-9]|college|community'))) r) s WHERE rule IS NOT NULL GROUP BY id"""
CHANGED = f"SELECT s.id, s.parent_id, s.confidence FROM ({SUGGESTED}) s WHERE s.id <> s.parent_id AND s.confidence >= 0.7e0 AND NOT EXISTS (SELECT 1 FROM ({SUGGESTED}) b WHERE b.id = s.parent_id AND b.parent_id = s.id AND b.confidence >= 0.7e0) AND NOT EXISTS (SELECT 1 FROM {{v_dorm}} h WHERE h.id = s.parent_id AND h.parent_id = s.id)"
DEMOTED = f"SELECT d.id FROM {{v_dorm}} d WHERE d.kind IN ('COMPLEX', 'VILLAGE', 'RESIDENTIAL_COLLEGE') AND d.id IN (SELECT parent_id FROM ({CHANGED}) c)"


@query(f"SELECT *, confidence IN (0.85e0, 0.78e0) OR confidence >= 0.8e0 AS auto_link FROM ({SUGGESTED}) s")
def hierarchy_suggestions(v):
    return o.suggest_hierarchy(v("v_dorm"))


@query(f"SELECT id, parent_id FROM ({CHANGED}) c")
def hierarchy_changes(v):
    return o.apply_hierarchy(v("v_dorm"), o.suggest_hierarchy(v("v_dorm")), medium=True)


def hierarchy(v):
    return o.hierarchy_change_set(v("v_dorm"), o.suggest_hierarchy(v("v_dorm")), medium=True)


@query(f"SELECT id AS dorm_id, 'parent_id' AS field, CAST(parent_id AS VARCHAR) AS value, confidence, false AS verified FROM ({CHANGED}) c")
def hierarchy_provenance(v):
    return hierarchy(v)["provenance"]


@query(f"SELECT d.id, coalesce(c.parent_id, d.parent_id) AS parent_id, CASE WHEN m.id IS NULL THEN d.assignable ELSE false END AS assignable, CASE WHEN m.id IS NULL THEN d.granular ELSE false END AS granular FROM {{v_dorm}} d LEFT JOIN ({CHANGED}) c ON c.id = d.id LEFT JOIN ({DEMOTED}) m ON m.id = d.id")
def hierarchy_applied(v):
    return o.with_hierarchy(v("v_dorm"), hierarchy(v)).select("id", "parent_id", "assignable", "granular")


ENTRIES = "SELECT dorm_id, field, value, source_id, min(ts) AS first_ts FROM {v_provenance} GROUP BY dorm_id, field, value, source_id"


@query("SELECT dorm_id, field, value, source_id, ts, previous_value, previous_source, previous_ts FROM (SELECT a.*, b.value AS previous_value, b.source_id AS previous_source, b.ts AS previous_ts, row_number() OVER (PARTITION BY a.rid ORDER BY b.ts DESC, b.value DESC, b.source_id DESC) AS rn FROM (SELECT *, row_number() OVER () AS rid FROM {v_provenance}) a JOIN {v_provenance} b ON a.dorm_id = b.dorm_id AND a.field = b.field AND a.value <> b.value AND a.source_id <> b.source_id AND b.ts < a.ts) t WHERE rn = 1")
def provenance_conflicts(v):
    return o.conflicting_provenance(v("v_provenance"))


@query(f"SELECT dorm_id, field, 'OPEN' AS status, string_agg(concat(value, '@', CAST(source_id AS VARCHAR)), ',' ORDER BY first_ts, value, source_id) AS entries, count(*) AS n_entries FROM ({ENTRIES}) e GROUP BY dorm_id, field HAVING count(DISTINCT value) > 1")
def conflict_log(v):
    return o.conflict_log(v("v_provenance"))


#: Lines of documents stand in for extracted names: short and long, clean and not.
LINES = "SELECT id, trim(line) AS name, CAST(position AS INTEGER) AS position FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS position FROM {v_text}) l"
TRIED = f"SELECT id, position, name, len(string_split_regex(name, '\\s+')) AS words, regexp_matches(name, '(?i){names.HOUSING_TERMS}') AS housing FROM ({LINES}) t"
HAS = lambda p: f"regexp_matches(name, '(?i){p}')"
JUNK = f"""SELECT id, position, CASE WHEN name = '' THEN 'empty_name' WHEN {HAS(names.GENERIC)} THEN 'generic_category_label' WHEN {HAS(names.CAMPUS_SECTION)} THEN 'campus_section_label' WHEN {HAS(names.RATES_LINE)} OR {HAS(names.NAV)} THEN 'nav_or_policy_label'
    WHEN {HAS(names.CTA_EXACT)} OR {HAS(names.CTA_PREFIX)} THEN 'cta_phrase' WHEN {HAS(names.PROCEDURAL)} THEN 'procedural_title' WHEN words > 10 OR length(name) > 70 THEN 'sentence_length_name'
    WHEN (length(name) > 45 OR regexp_matches(name, '[!?;:]') OR regexp_matches(name, '\\.\\s+[A-Z]') OR words > 8) AND NOT housing THEN 'sentence_length_name' WHEN NOT housing AND length(name) > 40 THEN 'long_non_housing_name' WHEN NOT housing AND words <= 4 AND {HAS(names.ADMINISTRATIVE)} THEN 'nav_or_policy_label' END AS reason FROM ({TRIED}) n"""


def named_lines(v):
    return v("v_text").select("id", F.posexplode(F.split("text", "\n")).alias("position", "line")).select("id", "position", F.trim("line").alias("name"))


@query(JUNK)
def junk_assessment(v):
    return named_lines(v).select("id", "position", names.assess_name(c("name")).alias("reason"))


NAMED_JUNK = JUNK.replace("SELECT id, position, CASE", "SELECT id, position, name, CASE", 1)


def _sampled(by: str, rows: str, samples: int, top: int) -> str:
    return f"""SELECT n.{by}, n, samples FROM (SELECT {by}, count(*) AS n FROM ({rows}) a WHERE reason IS NOT NULL GROUP BY {by}) n
        JOIN (SELECT {by}, string_agg(name, '; ' ORDER BY name) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY name) AS k FROM (SELECT DISTINCT {by}, name FROM ({rows}) b WHERE reason IS NOT NULL) d) e WHERE k <= {samples} GROUP BY {by}) s ON s.{by} = n.{by} ORDER BY n DESC, n.{by} LIMIT {top}"""


def junk_lines(lines, *keys):
    """Junk among lines with the number of times that each occurs: lines are counted first, so a rule reads a line once, in the tasks of the shuffle."""
    counted = lines.groupBy(*keys, "name").agg(F.count("*").alias("times"))
    return counted.withColumn("reason", F.explode(F.array(names.assess_name(c("name"))))).where("reason IS NOT NULL")


@query(_sampled("reason", NAMED_JUNK, 3, 20))
def junk_report(v):
    return r.junk_report(junk_lines(named_lines(v)), times="times")


@query(_sampled("college_id", f"SELECT *, id % (SELECT count(*) FROM {{supplier}}) AS college_id FROM ({NAMED_JUNK}) j", 8, 50))
def junk_report_by_institution(v):
    """As pages do, texts belong to institutions by their number."""
    ns = v("supplier").agg(F.count("*").alias("ns"))
    lines = named_lines(v).crossJoin(F.broadcast(ns)).withColumn("college_id", c("id") % c("ns"))
    return r.junk_report(junk_lines(lines, "college_id"), 8, 50, "college_id", times="times")


@query("SELECT id, 'nav_or_policy_label' AS reason FROM {v_dorm} WHERE NOT is_verified AND status NOT IN ('QUARANTINED', 'RETIRED', 'DUPLICATE') AND id % 9 = 0")
def junk_candidates(v):
    listed = v("v_dorm").withColumn("name", F.when(c("id") % 9 == 0, F.concat("name", F.lit(" rates"))).otherwise(c("name")))
    return o.junk_candidates(listed, v("v_review")).select("id", "reason")
