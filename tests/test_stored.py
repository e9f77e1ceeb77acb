"""Audits, decisions, links, searches and reports on small tables."""

from hallspark.operators import extraction as x
from hallspark.operators import maintenance as t
from hallspark.operators import reports as r
from hallspark.operators import windows as w


def test_audit_keeps_only_what_changes(spark):
    halls = spark.createDataFrame([(1, "ACTIVE", True, "a"), (2, "QUARANTINED", False, "b"), (3, None, None, "c")], "id long, status string, is_active boolean, name string")
    changes = spark.createDataFrame([(1, "ACTIVE", True), (2, "ACTIVE", True), (3, "ACTIVE", None), (9, "ACTIVE", True)], "id long, status string, is_active boolean")
    rows = {k.id: k for k in t.with_audit(halls, changes, "RESTORED").collect()}
    assert sorted(rows) == [2, 3]
    assert rows[2].before.status == "QUARANTINED" and rows[2].after.is_active and rows[2].action == "RESTORED"
    assert rows[3].before.status is None and rows[3].after.is_active is None


def test_last_decision_counts(spark):
    events = spark.createDataFrame([(1, 5, 10, True), (2, 5, 20, False), (3, 5, 20, True), (4, 6, 1, None)], "id long, source_id long, ts long, ok boolean")
    assert {tuple(k) for k in t.latest_flags(events, "source_id", "ok").collect()} == {(5, True), (6, None)}
    sources = spark.createDataFrame([(5, None), (6, True)], "id long, is_approved boolean")
    changed = t.set_field(sources, t.latest_flags(events, "source_id", "ok"), "is_approved")
    assert {tuple(k) for k in changed.collect()} == {(5, True), (6, None)}


def test_links_of_other_halls(spark):
    host = "https://housing.example.edu"
    links = [
        ("Unit 1", "unit-1", f"{host}/halls/unit-2/", True), ("Unit 1", "unit-1", f"{host}/halls/Unit-1?x=1", False), ("Unit 1", "unit-1", f"{host}/residence-halls", False),
        ("Unit 1", "unit-1", f"{host}/foothill", True), ("Foothill", "foothill", f"{host}/foothill-hall", False), ("Oak Hall", "oak-hall", f"{host}/stern", False),
        ("Oak Hall", "oak-hall", f"{host}/unit-3-mini-suites", True), ("Oak Hall", "oak-1", f"{host}/a/oak-hall#top", False), ("Unit 1", "unit-1", host, False), ("Unit 1", "unit-1", None, False),
    ]
    rows = spark.createDataFrame([(n, s, u) for n, s, u, _ in links], "name string, slug string, url string")
    assert {(k.slug, k.url) for k in t.mismatched_links(rows).collect()} == {(s, u) for _, s, u, wrong in links if wrong}


def test_search_by_every_name(spark):
    colleges = spark.createDataFrame(
        [(1, "State University", None, None, ["SU", "The State"], "Regents of Oak"), (2, "Oak College", "OC", "Elm", None, None), (3, "Su College", None, None, [None], None)],
        "id long, name string, short_name string, city string, aliases array<string>, official_name string",
    )
    found = lambda q: sorted(k.id for k in w.search_colleges(colleges, q).collect())
    assert found("su") == [1, 3] and found("oc") == [2] and found("reg") == [1]
    assert found("the state") == [1] and found("gents of") == [1] and found("elm") == [] and found("oak ") == [2] and found("ents of oak") == [1] and found("ak c") == [2]
    halls = spark.createDataFrame([(1, "Ash", "State University", ["The State"]), (2, "Elm", None, None)], "id long, name string, college_name string, aliases array<string>")
    assert [k.id for k in w.search_halls(halls, q="THE st").collect()] == [1]
    assert [k.id for k in w.search_halls(halls.drop("aliases"), q="elm").collect()] == [2]


def test_junk_by_institution_names_the_first(spark):
    rows = spark.createDataFrame([(1, "r", n) for n in "dcba"] + [(1, "r", "a"), (2, "s", "z")], "college_id long, reason string, name string")
    assert [tuple(k) for k in r.junk_report(rows, 2, 50, "college_id").collect()] == [(1, 5, "a; b"), (2, 1, "z")]


def test_embedded_names(spark):
    script = '<script id="__NEXT_DATA__" type="application/json">[{"name": "Oak Hall"},{"name":"Oak Hall"},{"name":"Dining Hall"},{"name":"Dean"},{"name":"Elm House"}]</script>'
    pages = spark.createDataFrame([(1, script), (2, "<p>none</p>"), (3, None)], "id long, html string")
    assert {k.id: k.names for k in pages.select("id", x.embedded_names(pages.html).alias("names")).collect()} == {1: ["Oak Hall", "Elm House"], 2: [], 3: None}


def test_junk_rules_read_a_line_once(spark):
    from hallspark.queries import QUERIES

    for name in ("junk_report", "junk_report_by_institution"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("long_non_housing_name") == 1, name  # the rules, once for distinct lines
    rows = spark.createDataFrame([("r", f"n{k:03}", 2) for k in range(600)] + [("r", None, 1), (None, "x", 9), ("s", "z", 3)], "reason string, name string, times long")
    assert [tuple(k) for k in r.junk_report(rows, times="times").collect()] == [("r", 1201, "n000; n001; n002"), ("s", 3, "z")]


def test_shared_first_letters_match_the_same(spark):
    import random

    from pyspark.sql import functions as F

    from hallspark.functions import names

    for pattern in names.WORDS:
        parts, pick = [p.strip("^$()\\b") for p in pattern.split("|")], random.Random(7)
        rows = spark.createDataFrame([(" ".join(pick.choice(parts) + pick.choice(["", "s", " 2 ", "("]) for _ in range(2))[pick.randint(0, 1) :],) for _ in range(300)], "t string")
        both = rows.select(F.col("t").rlike("(?i)" + pattern).alias("a"), F.col("t").rlike("(?i)" + names.by_first_letter(pattern)).alias("b")).collect()
        assert all(k.a == k.b for k in both) and {k.a for k in both} == {True, False}


def test_pages_are_handed_on_in_small_batches():
    import pyarrow as pa

    page = "<main><h2>Oak Hall</h2><a href='/floor-plan'>Floor plan</a><a href='/housing/oak'>Oak</a><p>" + "x" * 50_000 + "</p></main>"
    batch = pa.record_batch([pa.array([*range(99), None], pa.int64()), pa.array([*["https://h.example.edu/"] * 99, None]), pa.array([*[page] * 99, None])], names=["page_id", "url", "html"])
    out = list(x._parse(tuple(x.PARTS))(iter([batch])))
    assert len(out) > 4 and max(b.nbytes for b in out) < 4 * x.HANDED_ON
    rows = [row for b in out for row in b.to_pylist()]
    assert [k["page_id"] for k in rows] == [*range(99), None] and rows[0]["candidates"][0]["name"] == "Oak Hall"
    some = [row for b in x._parse(("image", "links"))(iter([batch])) for row in b.to_pylist()]
    assert some == [{k: row[k] for k in ("page_id", "url", "image", "links")} for row in rows]
