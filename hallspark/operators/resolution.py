"""Which names mean one hall: duplicates, resolution of extracted candidates, hierarchy and conflicts."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import assess_name, fuzzy_name, name_form, same_form, stripped_name
from ..functions.text import slugify
from .maintenance import _cut

c = F.col
PARENT_KINDS = ("COMPLEX", "VILLAGE", "RESIDENTIAL_COLLEGE", "UNIT", "APARTMENT_COMMUNITY")
CHILD_KINDS = ("BUILDING", "HOUSE", "RESIDENCE", "OTHER", "UNKNOWN")


def _token_blocks(named: DataFrame, threshold: float, *own: str) -> DataFrame:
    """Prefix filter of the overlap bound: the columns ``own`` and a ``key`` for names (``own``, tokens) of all sides; ``own`` tells names apart and holds the college_id.

    An institution's tokens are ordered by the number of its names that have them. Of two names whose overlap reaches
    ``threshold`` the rarest shared token lies in the prefix of both: behind it too few tokens are left to reach the
    share of the name's own. A token that a name repeats counts as often, so the institution's greatest number of
    repeats widens its prefixes. Tokens are shuffled as hashes of institution and token; equal ones only make names meet."""
    held = named.select(*own, F.explode(F.array_distinct("tokens")).alias("token")).select(*own, F.xxhash64("college_id", "token").alias("key"))
    often = held.groupBy("key").agg(F.count("*").alias("often"))
    repeats = named.groupBy("college_id").agg(F.max(F.size("tokens") - F.size(F.array_distinct("tokens")) + 1).alias("repeats")).where("repeats > 1")
    by_rarity = held.join(often, "key").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("by_rarity")).join(repeats, "college_id", "left")
    n = F.size("by_rarity")
    prefix = F.least(n, (F.floor(n - F.lit(threshold) * n / F.coalesce("repeats", F.lit(1)) + F.lit(1e-9)) + 1).cast("int"))
    return by_rarity.select(*own, F.explode(F.slice("by_rarity", F.lit(1), prefix)).alias("t")).select(*own, c("t.key").alias("key"))


def _grams(x: Column, *sizes: int) -> Column:
    """All substrings of so many characters; the empty one is of none."""
    of = lambda q: F.when(F.length(x) >= q, F.transform(F.sequence(F.lit(1), F.length(x) - (q - 1)), lambda k: F.substring(x, k, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(q) if q else F.array(F.lit("")) for q in sizes]))


def _containment_pairs(names: DataFrame) -> DataFrame:
    """(college_id, inner, outer) of names (college_id, name, x), the one's x a part of the other's. A name asks for the rarest of its own three-character parts (a shorter one for itself, which only names of an institution with one are cut up for), so only names that hold it are compared.

    Parts are many, so they are shuffled as two hashes, of institution and part and of institution and name. Equal hashes only make names meet; they are compared by their texts."""
    own = names.where("college_id IS NOT NULL").select("college_id", "name", "x", F.xxhash64("college_id", "name").alias("name_hash"))
    cut = lambda rows, *sizes: rows.select("college_id", "name_hash", F.explode(_grams(c("x"), *sizes)).alias("gram")).select(F.xxhash64("college_id", "gram").alias("part_hash"), "name_hash")
    held, short = cut(own, 3), own.where(F.length("x") < 3)
    often = held.groupBy("part_hash").agg(F.count("*").alias("often"))
    rarest = held.join(often, "part_hash").groupBy("name_hash").agg(F.min(F.struct("often", "part_hash")).alias("r")).select("name_hash", c("r.part_hash").alias("part_hash"))
    asked = rarest.unionByName(short.select("name_hash", F.xxhash64("college_id", "x").alias("part_hash")))
    inner = asked.join(own.select("name_hash", "college_id", c("name").alias("inner"), c("x").alias("inner_x")), "name_hash").drop("name_hash")
    beside_short = own.join(short.select("college_id").distinct(), "college_id", "left_semi")
    met = inner.join(held, "part_hash").unionByName(inner.where(F.length("inner_x") < 3).join(cut(beside_short, 0, 1, 2), "part_hash")).drop("part_hash")
    both = met.join(own.select("name_hash", c("college_id").alias("outer_college"), c("name").alias("outer"), c("x").alias("outer_x")), "name_hash")
    return both.where((c("college_id") == c("outer_college")) & (c("inner") != c("outer")) & c("outer_x").contains(c("inner_x"))).select("college_id", "inner", "outer")


def _close_names(names: DataFrame, threshold: float) -> DataFrame:
    """Pairs (college_id, name_a <= name_b) of an institution's distinct names that may reach ``threshold``: equal forms, a name within the other (a similarity of 0.85) or enough shared tokens."""
    formed = names.withColumn("x", stripped_name(c("name"))).withColumn("tokens", F.split("x", r"\s+"))
    keys = formed.select("college_id", "name", F.xxhash64("college_id", F.lit("x:"), "x").alias("key")).unionByName(_token_blocks(formed.select("college_id", "name", "tokens"), threshold, "college_id", "name"))
    met = keys.select("college_id", "key", c("name").alias("name_a")).join(keys.select("college_id", "key", c("name").alias("name_b")), ["college_id", "key"]).where("name_a < name_b").select("college_id", "name_a", "name_b")
    if threshold <= 0.85:
        parts = _containment_pairs(formed)
        met = met.unionByName(parts.select("college_id", F.least("inner", "outer").alias("name_a"), F.greatest("inner", "outer").alias("name_b")))
    return met.distinct().unionByName(names.select("college_id", c("name").alias("name_a"), c("name").alias("name_b")))


def duplicate_pairs(halls: DataFrame, threshold: float = 0.85, exact_one: bool = False, exact: bool = False) -> DataFrame:
    """Pairs of halls of one institution with a name similarity from ``threshold`` up to, without, 1; ``exact_one`` gives the pairs of similarity 1 instead.

    Names repeat far more often than halls, so the similarity is computed on pairs of an institution's distinct names
    and joined back to the halls that bear them. Only names that share a block meet (:func:`_close_names`), which loses
    no pair; ``exact`` compares all names of an institution, as does a ``threshold`` of 0 or less, which excludes none.
    Halls without a name or an institution have no pairs."""
    names = halls.where("name IS NOT NULL").select("college_id", "name").distinct()
    if exact or (threshold <= 0 and not exact_one):
        a, b = names.alias("a"), names.alias("b")
        pairs = a.join(b, (c("a.college_id") == c("b.college_id")) & (c("a.name") <= c("b.name"))).select(c("a.college_id").alias("college_id"), c("a.name").alias("name_a"), c("b.name").alias("name_b"))
    else:
        pairs = _close_names(names, 1.0 if exact_one else threshold)
    scored = pairs.withColumn("score", fuzzy_name(c("name_a"), c("name_b")))
    wanted = scored.where((c("score") == 1.0) if exact_one else (c("score") >= threshold) & (c("score") < 1.0))
    left = halls.select("college_id", c("id").alias("id_a"), c("name").alias("name_a"))
    right = halls.select("college_id", c("id").alias("id_b"), c("name").alias("name_b"))
    out = wanted.join(left, ["college_id", "name_a"]).join(right, ["college_id", "name_b"])
    return out.where((c("name_a") < c("name_b")) | (c("id_a") < c("id_b"))).select("college_id", "id_a", "name_a", "id_b", "name_b", "score")


def flag_duplicates(pairs: DataFrame) -> DataFrame:
    """Both members of a pair, with the other name of the best one."""
    both = pairs.select(c("id_a").alias("id"), c("name_b").alias("other"), c("id_b").alias("other_id"), "score").unionByName(pairs.select(c("id_b").alias("id"), c("name_a").alias("other"), c("id_a").alias("other_id"), "score"))
    best = both.groupBy("id").agg(F.min(F.struct((-c("score")).alias("s"), "other", "other_id")).alias("b"))
    return best.select("id", c("b.other").alias("duplicate_of"), (-c("b.s")).alias("score"))


def top_duplicates(pairs: DataFrame, n: int = 30) -> DataFrame:
    return pairs.orderBy(F.desc("score"), "id_a", "id_b").limit(n)


def same_names(asked: DataFrame, known: DataFrame, or_equal: bool = False) -> DataFrame:
    """(college_id, name, hall_name): names of ``asked`` (college_id, name) and names of ``known`` (college_id, hall_name) that surely mean one entity; with ``or_equal`` also those equal but for case.

    Names meet by equal normal forms, equal bases with equal numbers and directions, or a shared token of their prefixes
    at the overlap that the rule asks for; what meets is verified. The distinct names of both sides are formed once, after
    they are grouped, and written with an id; the keys by which they meet are hashes and ids, written too, so neither
    side is computed again for what uses it."""
    sides = asked.select("college_id", "name", F.lit(True).alias("asks"), F.lit(False).alias("known")).unionByName(known.select("college_id", c("hall_name").alias("name"), F.lit(False).alias("asks"), F.lit(True).alias("known")))
    names = sides.where("college_id IS NOT NULL AND name IS NOT NULL").groupBy("college_id", "name").agg(F.bool_or("asks").alias("asks"), F.bool_or("known").alias("known"))
    formed = _cut(names.withColumn("form", name_form(c("name"))).withColumn("name_id", F.monotonically_increasing_id()))
    # names without a normal form mean no entity, and names equal but for case have one normal form
    told, own = c("form.norm") != "", ("college_id", "name_id", "asks", "known", "alike")
    key = lambda kind, *of: F.xxhash64("college_id", F.lit(kind), *of)
    numbered = (c("form.numbers") != "") & (c("form.base") != "")
    equal = [F.when(told, key("n:", "form.norm")), F.when(told & numbered, key("b:", "form.numbers", "form.turned", "form.base")), F.when(~told & F.lit(or_equal), key("l:", F.lower("name")))]
    ids = formed.select("name_id", "asks", "known", F.explode(F.array_compact(F.array(*equal))).alias("key"))
    tokens = _token_blocks(formed.where(told).select(*own[:4], F.xxhash64("form.numbers", "form.turned").alias("alike"), c("form.tokens").alias("tokens")), 0.92, *own)
    keys = _cut(ids.unionByName(tokens.select("name_id", "asks", "known", F.xxhash64("key", "alike").alias("key"))))
    met = keys.where("asks").select("key", "name_id").join(keys.where("known").select("key", c("name_id").alias("hall_name_id")), "key").select("name_id", "hall_name_id").distinct()
    halls = formed.where("known").select(c("name_id").alias("hall_name_id"), c("college_id").alias("hall_college"), c("name").alias("hall_name"), c("form").alias("hall_form"))
    both = met.join(formed.where("asks").select("name_id", "college_id", "name", "form"), "name_id").join(halls, "hall_name_id").where("college_id = hall_college")
    same = same_form(c("form"), c("hall_form"))
    return both.where(same | (F.lit(or_equal) & (F.lower("name") == F.lower("hall_name")))).select("college_id", "name", "hall_name")


def _usable(name: str) -> Column:
    """Names of two characters or more that leave a slug; others mean no hall."""
    return F.coalesce((F.length(F.trim(name)) >= 2) & (slugify(F.trim(name)) != ""), F.lit(False))


def resolve_entities(candidates: DataFrame, halls: DataFrame, aliases: DataFrame | None = None, priority: bool = False) -> DataFrame:
    """Candidates (candidate_id, college_id, candidate_name) with the hall that each means, by equal slugs, by an alias (dorm_id, alias; equal slugs, or equal but for case) or surely one entity: hall_id and rule (slug, alias, name).

    The first hall by id counts, whatever the rule. With ``priority`` the rules are a cascade: slugs first, then aliases,
    then names, each for what the one before left. Distinct names of an institution are resolved once; every rule is an
    equi-join, so no names meet that share nothing. Names too short to keep mean no hall."""
    key = ["college_id", "candidate_name"]
    asked = candidates.where(_usable("candidate_name")).select(*key).distinct().withColumns({"slug": slugify(F.trim("candidate_name")), "low": F.lower(F.trim("candidate_name"))})
    slugs = halls.groupBy("college_id", "slug").agg(F.min("id").alias("hall_id"))
    found = [asked.join(slugs, ["college_id", "slug"]).select(*key, "hall_id", F.lit("slug").alias("rule"))]
    rest = asked.join(found[-1], key, "left_anti") if priority else asked
    if aliases is not None:
        owned = aliases.join(halls.select(c("id").alias("dorm_id"), "college_id"), "dorm_id")
        for own, of_alias in (("slug", slugify(c("alias"))), ("low", F.lower("alias"))):
            named = owned.groupBy("college_id", of_alias.alias(own)).agg(F.min("dorm_id").alias("hall_id"))
            found.append(rest.join(named, ["college_id", own]).select(*key, "hall_id", F.lit("alias").alias("rule")))
        if priority:
            rest = rest.join(found[-2].unionByName(found[-1]), key, "left_anti")
    known = halls.where("name IS NOT NULL").groupBy("college_id", c("name").alias("hall_name")).agg(F.min("id").alias("hall_id"))
    same = same_names(rest.select("college_id", F.trim("candidate_name").alias("name")), known.select("college_id", "hall_name")).join(known, ["college_id", "hall_name"])
    found.append(rest.withColumn("name", F.trim("candidate_name")).join(same, ["college_id", "name"]).select(*key, "hall_id", F.lit("name").alias("rule")))
    order = F.when(c("rule") == "slug", 0).when(c("rule") == "alias", 1).otherwise(2)
    best = reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.min(F.struct("hall_id", order.alias("o"), "rule")).alias("m"))
    out = candidates.join(best, key, "left")
    return out.select("candidate_id", "college_id", "candidate_name", c("m.hall_id").alias("hall_id"), c("m.rule").alias("rule"))


def resolve_parents(candidates: DataFrame, halls: DataFrame) -> DataFrame:
    """Parents by hint, for candidates (candidate_id, college_id, candidate_name, parent_hint, hall_id) whose hall has none: a row for each child that gets one.

    A candidate with a hall_id is that stored hall; others are created, those of an institution with equal slugs as one
    (created_id: the least candidate_id). A hint means a hall of the institution that is surely the same entity or has
    an equal name but for case: a stored one if there is any, else one created in the same batch; the first by id each
    time, and never the child itself. Stored and created names meet the hints in one blocked join. Of several hints for
    a child the first candidate's that is resolved counts. Children that have a parent keep it. Columns: hall_id or
    created_id, the candidate_id whose hint it was, parent_id (stored) or parent_created_id."""
    kinds = dict(candidates.dtypes)["candidate_id"], dict(halls.dtypes)["id"]
    # written once with their slugs, as children, owners and those made first all start from them
    rows = _cut(candidates.select("candidate_id", "college_id", "candidate_name", "parent_hint", "hall_id", F.when(c("hall_id").isNull() & _usable("candidate_name"), slugify(F.trim("candidate_name"))).alias("slug")))
    made = rows.where("slug IS NOT NULL")
    first_made = made.groupBy("college_id", "slug").agg(F.min("candidate_id").alias("created_id"))
    fresh = made.join(first_made, ["college_id", "slug"]).drop("slug")
    parentless = halls.where("parent_id IS NULL").select(c("id").alias("hall_id"))
    stored = rows.where("hall_id IS NOT NULL").drop("slug").join(parentless, "hall_id", "left_semi").withColumn("created_id", F.lit(None).cast(kinds[0]))
    children = stored.unionByName(fresh).withColumn("name", F.trim("parent_hint")).where(F.coalesce(c("name") != "", F.lit(False)))
    owners = halls.where("name IS NOT NULL").select("college_id", c("name").alias("hall_name"), c("id").alias("known_id"), F.lit(None).cast(kinds[0]).alias("known_created"))
    owners = owners.unionByName(fresh.select("college_id", F.trim("candidate_name").alias("hall_name"), F.lit(None).cast(kinds[1]).alias("known_id"), c("created_id").alias("known_created")).distinct())
    met = same_names(children.select("college_id", "name"), owners.select("college_id", "hall_name"), or_equal=True).join(owners, ["college_id", "hall_name"])
    # of each kind the first and the next, as one of them may be the child itself
    phase = c("known_id").isNull().cast("int")
    nth = F.row_number().over(Window.partitionBy("college_id", "name", "phase").orderBy("known_id", "known_created"))
    few = met.select("college_id", "name", phase.alias("phase"), "known_id", "known_created").distinct().withColumn("nth", nth).where("nth <= 2")
    of = lambda k, column: F.min(F.when(c("nth") == k, c(column)))
    means = few.groupBy("college_id", "name").agg(of(1, "known_id").alias("a"), of(2, "known_id").alias("b"), of(1, "known_created").alias("x"), of(2, "known_created").alias("y"))
    other = lambda first, second, own: F.when(c(first).eqNullSafe(c(own)), c(second)).otherwise(c(first))
    found = children.join(means, ["college_id", "name"]).withColumn("parent_id", other("a", "b", "hall_id"))
    found = found.withColumn("parent_created_id", F.when(c("parent_id").isNull(), other("x", "y", "created_id"))).where("parent_id IS NOT NULL OR parent_created_id IS NOT NULL")
    best = found.groupBy("hall_id", "created_id").agg(F.min(F.struct("candidate_id", "parent_id", "parent_created_id")).alias("m"))
    return best.select("hall_id", "created_id", "m.*")


def hierarchy_audit(halls: DataFrame) -> DataFrame:
    """Each hall with a parent, and what is wrong or notable about the link."""
    parent = halls.select(c("id").alias("parent_id"), c("parent_id").alias("grandparent_id"), c("is_active").alias("parent_active"), c("assignable").alias("parent_assignable"), F.lit(True).alias("found"))
    linked = halls.where("parent_id IS NOT NULL").join(parent, "parent_id", "left")
    return linked.select("id", "parent_id", c("found").isNull().alias("orphan"), (c("id") == c("parent_id")).alias("self"), F.coalesce(~c("parent_active"), F.lit(False)).alias("inactive_parent"), c("grandparent_id").isNotNull().alias("nested"), F.coalesce(c("parent_assignable"), F.lit(False)).alias("assignable_parent"))


def hierarchy_counters(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("n_links"), *[F.count_if(k).alias(f"n_{k}") for k in ("orphan", "self", "inactive_parent", "nested", "assignable_parent")])


def suggest_hierarchy(halls: DataFrame) -> DataFrame:
    """A parent for halls without one: named by a phrase, by the category label, or by the hall's own name. Parents are few, so they are selected first; per child the rules count in order, then the parent's id."""
    low = F.lower
    parents = halls.where(c("kind").isin(*PARENT_KINDS) | c("name").rlike(r"(?i)village|complex|unit\s*\d|college|community")).select("college_id", c("id").alias("parent"), c("name").alias("parent_name"), c("kind").alias("parent_kind"), name_form(c("name")).alias("parent_form"))
    said = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("category_label", F.lit("")))
    hint = F.trim(F.regexp_extract(said, r"(?i)\b(?:part of|located in|within|buildings? (?:in|of)|houses? (?:in|of))\s+([A-Z][A-Za-z0-9 .'&\-]{2,60})", 1))
    children = halls.where("parent_id IS NULL").select("college_id", "id", "name", "kind", "category_label", said.alias("said"), hint.alias("hint"), name_form(hint).alias("hint_form"), name_form(F.trim("category_label")).alias("label_form"))
    pairs = children.join(parents, "college_id").where("id <> parent")
    pn, label = low("parent_name"), F.trim("category_label")
    phrase = (c("hint") != "") & (same_form(c("parent_form"), c("hint_form")) | pn.contains(low("hint")) | low("hint").contains(pn))
    labelled = (label != "") & c("kind").isin(*CHILD_KINDS) & (same_form(c("parent_form"), c("label_form")) | (pn == low(label)) | low(label).contains(pn))
    nested = (low("name") != pn) & low("name").contains(pn) & (F.length("name") > F.length("parent_name") + 2) & c("parent_kind").isin(*PARENT_KINDS)
    number = F.regexp_extract("parent_name", r"(?i)unit\s*(\d+)", 1)
    unit = (low("name") != pn) & (number != "") & F.array_contains(F.regexp_extract_all(low("said"), F.lit(r"\bunit\s*(\d+)\b"), F.lit(1)), number)
    rule = F.when(phrase, 0).when(labelled, 1).when(nested | unit, 2)
    confidence = F.when(c("rule") == 0, 0.85).when(c("rule") == 1, 0.75).when(nested, F.when(c("parent_kind") == "UNIT", 0.8).otherwise(0.7)).otherwise(0.78)
    hits = pairs.withColumn("rule", rule).where("rule IS NOT NULL").withColumn("confidence", confidence)
    best = hits.groupBy("id").agg(F.min(F.struct("rule", "parent", "confidence")).alias("m"))
    return best.select("id", c("m.parent").alias("parent_id"), c("m.rule").alias("rule"), c("m.confidence").alias("confidence"), (c("m.confidence").isin(0.85, 0.78) | (c("m.confidence") >= 0.8)).alias("auto_link"))


def apply_hierarchy(halls: DataFrame, suggestions: DataFrame, medium: bool = False) -> DataFrame:
    """Changes (id, parent_id): links that apply by themselves, or with ``medium`` also those from 0.7; none to itself and no pair of each other's parents."""
    wanted = suggestions.where(c("auto_link") | (F.lit(medium) & (c("confidence") >= 0.7))).where("id <> parent_id").select("id", "parent_id")
    back = wanted.select(c("parent_id").alias("id"), c("id").alias("parent_id"))
    existing = halls.where("parent_id IS NOT NULL").select(c("parent_id").alias("id"), c("id").alias("parent_id"))
    return wanted.join(back.unionByName(existing), ["id", "parent_id"], "left_anti")


ORGANIZATIONAL = ("COMPLEX", "VILLAGE", "RESIDENTIAL_COLLEGE")


def hierarchy_change_set(halls: DataFrame, suggestions: DataFrame, medium: bool = False) -> dict[str, DataFrame]:
    """What the links of :func:`apply_hierarchy` change, by table: links (id, parent_id); demoted, parents that only organize others and so are neither assigned nor ranked (id, assignable, granular); and a provenance row for each link (dorm_id, field, value, confidence, verified)."""
    links = apply_hierarchy(halls, suggestions, medium)
    organizers = halls.where(c("kind").isin(*ORGANIZATIONAL)).select("id")
    demoted = organizers.join(links.select(c("parent_id").alias("id")), "id", "left_semi").select("id", F.lit(False).alias("assignable"), F.lit(False).alias("granular"))
    known = links.join(suggestions.select("id", "parent_id", "confidence"), ["id", "parent_id"])
    provenance = known.select(c("id").alias("dorm_id"), F.lit("parent_id").alias("field"), c("parent_id").cast("string").alias("value"), "confidence", F.lit(False).alias("verified"))
    return {"links": links, "demoted": demoted, "provenance": provenance}


def with_hierarchy(halls: DataFrame, changes: dict[str, DataFrame]) -> DataFrame:
    """Halls with the links and demotions of a change set."""
    linked = halls.join(changes["links"].select("id", c("parent_id").alias("__parent")), "id", "left").join(changes["demoted"].select("id", F.lit(True).alias("__demoted")), "id", "left")
    kept = lambda k: F.when(c("__demoted"), F.lit(False)).otherwise(c(k))
    return linked.withColumns({"parent_id": F.coalesce("__parent", "parent_id"), "assignable": kept("assignable"), "granular": kept("granular")}).drop("__parent", "__demoted")


class _Latest:
    """The latest entries (ts, value, source) of one field that answer, for every value and source, which is the latest with another value and another source: the last entry, the last with another value than it, the last with neither its value nor the second one's source, and the same with the sources' part."""

    def __init__(self, entries: tuple = ()):
        self.entries = entries

    def other(self, value, source):
        return max((e for e in self.entries if e[1] != value and e[2] != source), default=None)

    def then(self, entry: tuple) -> _Latest:
        _, value, source = entry
        by_value = max((e for e in self.entries if e[1] != value), default=None)
        by_source = max((e for e in self.entries if e[2] != source), default=None)
        found = [entry, by_value, by_source]
        found.append(self.other(value, by_value[2]) if by_value else None)
        found.append(self.other(by_source[1], source) if by_source else None)
        return _Latest(tuple({e for e in found if e}))


def _previous(batches):
    """Rows sorted by hall, field and time: the state of one field is carried on, whatever its number of rows."""
    key, before, now, at = None, _Latest(), _Latest(), None
    for batch in batches:
        rows = []
        for dorm, field, value, source, ts in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if (dorm, field) != key:
                key, before, now, at = (dorm, field), _Latest(), _Latest(), None
            if ts != at:
                before, at = now, ts
            found = before.other(value, source)
            rows.append(found or (None, None, None))
            now = now.then((ts, value, source))
        kinds = batch.schema
        added = [pa.array([r[k] for r in rows], kinds.field(n).type) for k, n in ((1, "value"), (2, "source_id"), (0, "ts"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*kinds.names, "previous_value", "previous_source", "previous_ts"])


def conflicting_provenance(provenance: DataFrame) -> DataFrame:
    """For each row the latest earlier value of its hall's field that differs and comes from another source (of equal times the greatest value, then source); rows without one are left out.

    Rows stream through their partition in order of time; the state is five entries a field, so a hot field costs no memory. Rows without a value, source or time conflict with nothing."""
    rows = provenance.select("dorm_id", "field", "value", "source_id", "ts").where("value IS NOT NULL AND source_id IS NOT NULL AND ts IS NOT NULL")
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{k} {t}" for k, t in kinds.items()] + [f"previous_value {kinds['value']}", f"previous_source {kinds['source_id']}", f"previous_ts {kinds['ts']}"])
    return rows.repartition("dorm_id", "field").sortWithinPartitions("dorm_id", "field", "ts", "value", "source_id").mapInArrow(_previous, schema).where("previous_ts IS NOT NULL")


def conflict_log(provenance: DataFrame) -> DataFrame:
    """Distinct (value, source) entries of each hall and field in order of their first time, where values differ."""
    entries = provenance.groupBy("dorm_id", "field", "value", "source_id").agg(F.min("ts").alias("ts"))
    listed = F.array_sort(F.collect_list(F.struct("ts", "value", "source_id")))
    out = entries.groupBy("dorm_id", "field").agg(listed.alias("entries"), F.countDistinct("value").alias("n_values"))
    text = F.array_join(F.transform("entries", lambda e: F.concat(e["value"], F.lit("@"), e["source_id"].cast("string"))), ",")
    return out.where("n_values > 1").select("dorm_id", "field", F.lit("OPEN").alias("status"), text.alias("entries"), F.size("entries").cast("long").alias("n_entries"))


def junk_candidates(halls: DataFrame, reviews: DataFrame) -> DataFrame:
    """Halls whose names are junk: unverified, not already dealt with; those that users reviewed only for strong reasons."""
    from ..functions.names import STRONG_REASONS

    used = reviews.select(c("dorm_id").alias("id")).distinct().withColumn("used", F.lit(True))
    open_rows = halls.where("NOT is_verified AND status NOT IN ('QUARANTINED', 'RETIRED', 'DUPLICATE')").withColumn("reason", assess_name(c("name"))).where("reason IS NOT NULL")
    return open_rows.join(used, "id", "left").where(c("used").isNull() | c("reason").isin(*STRONG_REASONS)).drop("used")


def safe_merge_map(pairs: DataFrame) -> DataFrame:
    """Duplicates (from_id) with the hall to merge into (to_id), the one with the least id of their pairs."""
    return pairs.groupBy(F.greatest("id_a", "id_b").alias("from_id")).agg(F.min(F.least("id_a", "id_b")).alias("to_id"))
