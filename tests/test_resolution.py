"""Blocked joins of names against comparing all, alias and parent rules."""

import random

import pytest
from hallspark.functions.names import name_form, same_form
from hallspark.operators import maintenance, resolution
from pyspark.sql import functions as F

c = F.col

WORDS = ["north", "oak", "oak", "hall", "residence", "tower", "2", "two", "a", "ab", "abc", "quad", "élan", "village", "unit", "east"]


def names(rng, n):
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    return [*out, "", "hall", " ", "Hall", "oak", "OAK", "oak oak", "oak oak oak", "oak quad", "b", "x\ty", "oak  quad"]


@pytest.fixture(scope="module")
def halls(spark):
    rng = random.Random(8)
    rows = [(k, k % 3, n) for k, n in enumerate(names(rng, 160))] + [(1000, 0, None), (1001, None, "oak")]
    return spark.createDataFrame(rows, "id long, college_id long, name string").cache()


@pytest.mark.parametrize("threshold", [0.95, 0.85, 0.6, 0.3, 0.05])
def test_blocks_lose_no_pair(halls, threshold):
    key = lambda r: (r.id_a, r.id_b, round(r.score, 9))
    found = sorted(map(key, resolution.duplicate_pairs(halls, threshold).collect()))
    assert found == sorted(map(key, resolution.duplicate_pairs(halls, threshold, exact=True).collect())) and (found or threshold == 0.95)


def test_blocks_lose_no_equal_pair(halls):
    key = lambda r: (r.id_a, r.id_b, r.score)
    found = sorted(map(key, resolution.duplicate_pairs(halls, exact_one=True).collect()))
    assert found == sorted(map(key, resolution.duplicate_pairs(halls, exact_one=True, exact=True).collect())) and found


def test_default_plan_compares_no_whole_institution(halls):
    plan = resolution.duplicate_pairs(halls)._jdf.queryExecution().optimizedPlan().toString()
    whole = resolution.duplicate_pairs(halls, exact=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "<= name" in whole and "<= name" not in plan


def test_same_names_lose_no_pair(halls):
    known = halls.where("name IS NOT NULL")
    a = known.select("college_id", "name").distinct()
    b = a.withColumnRenamed("name", "hall_name")
    every = a.join(b, "college_id").where(same_form(name_form(F.col("name")), name_form(F.col("hall_name"))))
    assert sorted(map(tuple, resolution.same_names(a, b).collect())) == sorted(map(tuple, every.select("college_id", "name", "hall_name").collect()))


def test_aliases_and_priority(spark):
    halls = spark.createDataFrame([(1, 1, "Oak Tower", "oak-tower"), (2, 1, "Elm House", "elm-house"), (3, 1, "Ash Quad", "ash-quad"), (4, 2, "Elm House", "elm-house")], "id long, college_id long, name string, slug string")
    aliases = spark.createDataFrame([(1, "Elm house"), (3, "The Big One"), (4, "North-Side!"), (2, "A")], "dorm_id long, alias string")
    rows = [(1, 1, "elm HOUSE"), (2, 1, "the big-one"), (3, 2, "north side"), (4, 1, "north side"), (5, 1, "A"), (6, 1, None), (7, 1, "??"), (8, 1, " Oak tower "), (9, 3, "Elm House")]
    candidates = spark.createDataFrame(rows, "candidate_id long, college_id long, candidate_name string")
    of = lambda **o: {r.candidate_id: (r.hall_id, r.rule) for r in resolution.resolve_entities(candidates, halls, aliases, **o).collect()}
    common = {2: (3, "alias"), 3: (4, "alias"), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None), 8: (1, "slug"), 9: (None, None)}
    assert of() == {1: (1, "alias"), **common}  # the first hall counts
    assert of(priority=True) == {1: (2, "slug"), **common}
    assert resolution.resolve_entities(candidates, halls).where("candidate_id = 1").first().hall_id == 2


def test_parents(spark):
    halls = spark.createDataFrame([(1, 1, "Oak Village", None), (2, 1, "Oak House", None), (3, 1, "Elm House", 1), (4, 2, "Oak Village", None)], "id long, college_id long, name string, parent_id long")
    rows = [
        (1, 1, "Oak House", "the OAK village", 2),  # stored child, stored parent
        (2, 1, "Elm House", "Oak Village", 3),  # has a parent already
        (3, 1, "Oak Village", "Oak Village", 1),  # never its own
        (4, 1, "New House", "New Village", None),  # parent made in the batch, later
        (5, 1, "New Village", "New Village", None),
        (6, 1, "new-house", "Oak Village", None),  # the same child again: the first hint resolved counts
        (7, 2, "New House", "New Village", None),  # of another institution
        (8, 1, "Late House", None, None),
        (9, 1, "x", "Oak Village", None),  # no name to keep
    ]
    candidates = spark.createDataFrame(rows, "candidate_id long, college_id long, candidate_name string, parent_hint string, hall_id long")
    got = {(r.hall_id, r.created_id, r.candidate_id, r.parent_id, r.parent_created_id) for r in resolution.resolve_parents(candidates, halls).collect()}
    assert got == {(2, None, 1, 1, None), (None, 4, 4, None, 5)}


def test_merge_chains(spark):
    """A chain of three, two targets of one, a merge that leads back, a hall merged into its own child."""
    merge_map = spark.createDataFrame([(4, 3), (3, 2), (2, 1), (5, 7), (5, 6), (8, 9), (9, 8), (10, 10)], "from_id long, to_id long")
    assert {tuple(r) for r in maintenance.merge_closure(merge_map).collect()} == {(4, 1), (3, 1), (2, 1), (5, 6)}
    halls = spark.createDataFrame([(1, 4, "ACTIVE", True), (2, None, "ACTIVE", True), (3, None, "ACTIVE", True), (4, None, "ACTIVE", True), (11, 3, "REVIEW", True)], "id long, parent_id long, status string, is_active boolean")
    rows = spark.createDataFrame([(4, 1, "four"), (3, 1, "three"), (1, 1, "own"), (3, 2, "three"), (4, 2, "four"), (11, 2, "else")], "dorm_id long, user_id long, notes string")
    links = rows.withColumnRenamed("user_id", "source_id")
    out = maintenance.merge_halls(merge_map, halls, rows, links, rows, favorites=rows, corrections=rows)
    assert {(r.id, r.parent_id, r.status, r.is_active, r.duplicate_of) for r in out["halls"].collect()} == {(1, None, "ACTIVE", True, None), (2, None, "DUPLICATE", False, 1), (3, None, "DUPLICATE", False, 1), (4, None, "DUPLICATE", False, 1), (11, 1, "REVIEW", True, None)}
    assert {(r.dorm_id, r.user_id, r.notes) for r in out["favorites"].collect()} == {(1, 1, "own"), (1, 2, "three"), (11, 2, "else")}
    assert out["corrections"].where("dorm_id = 1").count() == 5 and out["links"].count() == 3


def test_hierarchy_change_set(spark):
    schema = "id long, college_id long, name string, kind string, parent_id long, category_label string, description string, assignable boolean, granular boolean"
    halls = spark.createDataFrame([(1, 1, "Oak Village", "VILLAGE", None, None, None, True, True), (2, 1, "Elm House", "HOUSE", None, "Oak Village", None, True, True), (3, 1, "Unit 1", "UNIT", None, None, None, True, True), (4, 1, "Christian Hall", "BUILDING", None, None, "Christian Hall is part of Unit 1 residence community", True, True)], schema)
    changes = resolution.hierarchy_change_set(halls, resolution.suggest_hierarchy(halls), medium=True)
    assert {tuple(r) for r in changes["links"].collect()} == {(2, 1), (4, 3)} and [r.id for r in changes["demoted"].collect()] == [1]
    assert {(r.dorm_id, r.value, r.confidence, r.verified) for r in changes["provenance"].collect()} == {(2, "1", 0.75, False), (4, "3", 0.85, False)}
    assert {(r.id, r.parent_id, r.assignable) for r in resolution.with_hierarchy(halls, changes).collect()} == {(1, None, False), (2, 1, True), (3, None, True), (4, 3, True)}
    assert {r.id for r in resolution.hierarchy_change_set(halls, resolution.suggest_hierarchy(halls))["links"].collect()} == {4}


def test_parts_of_names_are_shuffled_as_hashes(spark):
    texts = ["", "a", "ab", "abc", "abcd", "xabc", "ba", "Ã©a", "oak", "oak tower", "the oak tower", "tower", "elm"]
    names = spark.createDataFrame([(k, f"{t}!", t) for k in (1, 2) for t in texts if k == 1 or len(t) > 2] + [(None, "abc!", "abc")], "college_id long, name string, x string")
    found = resolution._containment_pairs(names)
    want = [(k, f"{a}!", f"{b}!") for k in (1, 2) for a in texts for b in texts if a != b and a in b and (k == 1 or min(len(a), len(b)) > 2)]
    assert sorted(set(map(tuple, found.collect()))) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cuts = [plan[k - 1] for k, line in enumerate(plan) if "Generate explode" in line]
    assert cuts and all("part_hash" in line and "x#" not in line.split("part_hash")[1] for line in cuts)  # no texts beside the parts


def test_rows_are_counted_before_they_meet_the_merges(spark):
    merge_map = spark.createDataFrame([(4, 1), (3, 1), (6, 5)], "from_id long, to_id long")
    rows = spark.createDataFrame([(4,), (4,), (3,), (6,), (1,), (None,)], "dorm_id long")
    out = maintenance.merged_counters(merge_map, reviews=rows, links=rows.where("dorm_id = 4"))
    assert {tuple(k) for k in out.collect()} == {("reviews", 1, 3), ("reviews", 5, 1), ("links", 1, 2)}
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")
    assert len(plan) == 2 and "Aggregate [table" in plan[1]


@pytest.mark.parametrize("or_equal", [False, True])
def test_names_are_formed_once(halls, or_equal):
    a = halls.select("college_id", "name").unionByName(halls.select("college_id", F.upper("name").alias("name"))).distinct()
    b = halls.select("college_id", c("name").alias("hall_name")).distinct()
    same = same_form(name_form(F.col("name")), name_form(F.col("hall_name"))) | (F.lit(or_equal) & (F.lower("name") == F.lower("hall_name")))
    found = resolution.same_names(a, b, or_equal)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, a.join(b, "college_id").where(same).select("college_id", "name", "hall_name").collect()))
    candidates = halls.select(c("id").alias("candidate_id"), "college_id", c("name").alias("candidate_name"), F.upper("name").alias("parent_hint"), F.when(c("id") % 2 == 0, c("id")).alias("hall_id"))
    parents = resolution.resolve_parents(candidates, halls.withColumn("parent_id", F.lit(None).cast("long")))
    for out in (found, parents):  # what uses the names and candidates reads them as written
        assert "[^a-z0-9]+" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_sorted_only_in_the_parts_in_which_they_are_ranked(spark):
    merge_map = spark.createDataFrame([(4, 1), (3, 1), (6, 5)], "from_id long, to_id long")
    rows = spark.createDataFrame([(4, 1, "four"), (4, 1, "four"), (3, 1, "three"), (3, 2, "three"), (4, 2, "four"), (1, 2, "own"), (6, None, "six"), (None, 1, "none"), (8, 1, "else")], "dorm_id long, user_id long, notes string")
    out = maintenance.remap(rows, merge_map, unique=["user_id", "dorm_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()  # as planned, before it runs
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("WindowGroupLimit") <= 1
    assert plan.count(" Sort [") == 1 and "hashpartitioning(user_id#" in plan and f", {maintenance.RANKED_PARTS})" in plan
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(1, 1, "three"), (1, 2, "own"), (5, None, "six"), (None, 1, "none"), (8, 1, "else")]))


def test_favorites_meet_the_merges_as_read(spark):
    from hallspark.queries import QUERIES

    plan = QUERIES["merged_chain_favorites"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("l_partkey") >= 1
