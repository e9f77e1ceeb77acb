"""Expectations on small rows: constraints, scores, names, URLs, coverage, pages."""

import pytest
from hallspark.functions import names, scores, text, urls
from hallspark.operators import extraction, maintenance, matching, reports, resolution, windows
from hallspark.queries.matching import weights
from pyspark.sql import functions as F

c = F.col
HALLS = [
    ("private-hall", "Private Hall", "PRIVATE", 4.0, 8.0, 9.0, True, True, 12000.0),
    ("communal-hall", "Communal Hall", "COMMUNAL", 9.0, 3.0, 4.0, True, False, 10000.0),
    ("suite-hall", "Suite Hall", "SUITE", 6.0, 6.0, 7.0, True, True, 14000.0),
    ("unknown-bath", "Mystery Hall", "UNKNOWN", 7.0, 5.0, 6.0, True, True, 11000.0),
    ("upperclass-only", "Senior Suites", "PRIVATE", 5.0, 7.0, 8.0, False, True, 15000.0),
]


@pytest.fixture(scope="module")
def halls(spark):
    rows = spark.createDataFrame(HALLS, "id string, name string, bathroom_style string, social double, quiet double, spaciousness double, freshman boolean, has_ac boolean, yearly_cost double")
    return rows.withColumns({"confidence": F.lit(0.8), "completeness": F.lit(0.8), "age_days": F.lit(30), "assignable": F.lit(True), "granular": F.lit(True), "college_id": F.lit(1)})


def outcomes(halls, **constraints):
    rows = matching.classify_constraints(matching.with_evidence(halls).withColumns({k: F.lit(v) for k, v in constraints.items()}))
    return {r.id: r.outcome for r in rows.collect()}


def test_private_bath(halls):
    got = outcomes(halls, require_private_bath=True)
    assert got == {"private-hall": "eligible", "communal-hall": "excluded", "suite-hall": "excluded", "unknown-bath": "unverified", "upperclass-only": "eligible"}


def test_private_or_suite(halls):
    got = outcomes(halls, require_private_or_suite=True)
    assert (got["private-hall"], got["suite-hall"], got["communal-hall"], got["unknown-bath"]) == ("eligible", "eligible", "excluded", "unverified")


def test_freshman_ac_and_budget(halls):
    assert outcomes(halls, require_freshman=True)["upperclass-only"] == "excluded"
    unknown = halls.withColumn("has_ac", F.lit(None).cast("boolean"))
    assert set(outcomes(unknown, require_ac=True).values()) == {"unverified"}
    costs = halls.withColumn("yearly_cost", F.when(c("id") == "private-hall", 8000.0).when(c("id") == "suite-hall", 20000.0))
    got = outcomes(costs, max_budget=12000.0)
    assert (got["private-hall"], got["suite-hall"], got["communal-hall"]) == ("eligible", "excluded", "unverified")
    assert set(outcomes(halls).values()) == {"eligible"}


def ranked(halls, given):
    profile = halls.sparkSession.range(1).select(F.lit(7).alias("id"), F.lit(1).alias("college_id"))
    rows = matching.match(profile, halls, {k: F.lit(float(v)) for k, v in given.items()})
    return rows.where("outcome = 'eligible'").orderBy("rank").collect()


def test_ranking(halls):
    assert ranked(halls, {"roomSpaciousness": 4, "quietAtmosphere": 2})[0].hall_id == "private-hall"
    assert ranked(halls, {"socialAtmosphere": 4})[0].hall_id == "communal-hall"
    bath = {r.hall_id: r for r in ranked(halls, {"privateBathroom": 3, "socialAtmosphere": 1})}
    assert bath["unknown-bath"].confidence_score < bath["private-hall"].confidence_score
    empty = ranked(halls, {})
    assert [r.match_score for r in empty] == [0] * 5 and [r.name for r in empty] == sorted(h[1] for h in HALLS)


def test_reasons(halls):
    given = {k: F.lit(3.0) for k in ("socialAtmosphere", "privateBathroom", "laundry")}
    rows = matching.match_reasons(matching.match_score(matching.with_dimensions(halls), given), given)
    got = {r.id: r for r in rows.collect()}
    assert got["communal-hall"].positives == ["Matches your preference for a social atmosphere"] and got["communal-hall"].tradeoffs == ["Does not have a private bathroom"]
    assert "Laundry access is unknown" in got["private-hall"].unknowns


def test_matchable(halls):
    rows = halls.withColumn("assignable", F.when(c("id") == "suite-hall", False).when(c("id") == "private-hall", True))
    assert {r.id for r in matching.filter_matchable(rows).collect()} == {h[0] for h in HALLS} - {"suite-hall"}


SCORE = "yearly_cost double, avg_cost double, has_ac boolean, bathroom_style string, privacy double, social double, quiet double, freshman boolean, amenity_count long, dining_m double, confidence double, completeness double"


def score(spark, **given):
    names_ = [k.split()[0] for k in SCORE.split(", ")]
    return scores.with_scores(spark.createDataFrame([tuple(given.get(k) for k in names_)], SCORE)).first()


def test_scores(spark):
    only_name = score(spark, confidence=0.95, completeness=0.2)
    assert only_name.overall_score is None and not only_name.scoreable and only_name.data_confidence == 95
    assert score(spark, yearly_cost=14000.0, avg_cost=15000.0).value_score is not None
    zeros = score(spark, amenity_count=0, social=0.0, has_ac=False, bathroom_style="COMMUNAL", freshman=False, dining_m=2000.0)
    assert (zeros.amenity_score, zeros.social_score, zeros.freshman_score) == (0, 0, 45) and zeros.comfort_score < 50
    sure, unsure = (score(spark, yearly_cost=14000.0, avg_cost=15000.0, confidence=x) for x in (1.0, 0.1))
    assert sure.value_score == unsure.value_score and (sure.data_confidence, unsure.data_confidence) == (100, 10)
    assert not score(spark, yearly_cost=14000.0, avg_cost=15000.0, has_ac=True).scoreable
    full = score(spark, yearly_cost=12000.0, avg_cost=15000.0, has_ac=True, bathroom_style="SUITE", privacy=7.0, social=8.0, quiet=5.0, freshman=True, amenity_count=6, dining_m=250.0, confidence=0.9)
    assert full.scoreable and full.score_completeness == 1 and full.data_confidence == 90


@pytest.mark.parametrize(("a", "b", "same"), [("Unit 1", "Unit 2", False), ("Jester East", "Jester West", False), ("North Hall", "South Hall", False), ("Building 1", "Building 10", False), ("Unit One", "Unit 1", True), ("McLaughlin Walsh", "McLaughlin-Walsh", True), ("", "x", False)])
def test_same_entity(spark, a, b, same):
    assert spark.range(1).select(names.same_entity(F.lit(a), F.lit(b)).alias("s")).first().s is same


def test_names_and_texts(spark):
    one = lambda column: spark.range(1).select(column.alias("x")).first().x
    assert one(names.assess_name(F.lit("Maple Hall"))) is None
    assert [one(names.assess_name(F.lit(x))) for x in (" ", "Apply now", "How to apply", "South Campus Unit 1", "Commons", "2 bedroom, 1 bath")] == ["empty_name", "nav_or_policy_label", "nav_or_policy_label", "campus_section_label", "generic_category_label", "room_type_listing"]
    assert one(text.normalize_ac(F.lit("spacious"))) is True and one(text.normalize_ac(F.lit("spacious"), strict=True)) is None
    assert one(text.parse_price(F.lit("$4,500.50 per semester"))).asDict() == {"amount": 4500.5, "period": "semester", "uncertain": False}
    assert one(text.parse_price(F.lit("$50 fee"))) is None
    assert one(names.fuzzy_name(F.lit("Oak Hall"), F.lit("Oak Residence Hall"))) == 1.0
    assert one(text.bathroom_from_text(F.lit("a private bath"))) == "unknown" and one(text.bathroom_from_text(F.lit("a private bath"), fixed=True)) == "PRIVATE"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://Housing.Example.edu/halls/?utm_source=a&id=3#top", "https://housing.example.edu/halls?id=3"),
        ("https://example.edu/?fbclid=1", "https://example.edu/"),
        ("https://example.edu", "https://example.edu/"),
        ("Not A URL ", "not a url"),
        ("https://example.edu/a?b=1&ref=x&c=2", "https://example.edu/a?b=1&c=2"),
    ],
)
def test_canonical_url(spark, raw, want):
    assert spark.range(1).select(urls.canonical_url(F.lit(raw)).alias("u")).first().u == want


def test_coverage(spark):
    schema = "has_housing boolean, blocked boolean, n_unique int, n_created int, n_updated int, site_found boolean, directory_sources int, directory_parsed boolean, directory_pages int, published int, unresolved_housing_links int, unresolved_directory_links int, hit_budget boolean"
    cases = [
        ((True, False, 8, 8, 0, True, 0, False, 0, None, 0, None, False), "PARTIAL"),
        ((True, False, 5, 0, 5, True, 1, True, 1, 5, 3, None, False), "PARTIAL"),
        ((True, False, 5, 0, 5, True, 1, True, 1, 5, 0, None, False), "COMPLETE"),
        ((True, True, 5, 0, 5, True, 1, True, 1, 5, 0, None, False), "BLOCKED"),
        ((None, False, 0, 0, 0, True, 0, False, 0, None, 0, None, False), "SITE_FOUND"),
        ((False, False, 5, 0, 5, True, 1, True, 1, 5, 0, None, False), "NO_HOUSING"),
        ((True, False, 0, 1, 0, True, 1, False, 0, None, 0, None, False), "DIRECTORY_PENDING"),
        ((True, False, 0, 0, 0, False, 0, False, 0, None, 0, None, False), "RETRYABLE"),
    ]
    for row, want in cases:
        assert reports.decide_coverage(spark.createDataFrame([row], schema)).first().coverage == want


PAGE = """<html><head><title>Residence Halls</title></head><body><nav><a href="/faq">FAQ</a><a href="/apply">Apply now</a></nav><main><h1>Residence Halls</h1>
<article class="card"><h3>Swig Hall</h3><p>Double rooms near the dining hall.</p></article><article class="card"><h3>Casa Italiana</h3><p>A residence hall with suites.</p></article>
<article class="card"><h3>Graham Residence Hall</h3><p>Single rooms, laundry.</p></article><article class="card"><h3>Campisi Hall</h3><p>Bathroom shared.</p></article></main>
<aside><h3>Housing Application</h3></aside><footer><a href="/contact">Contact</a></footer></body></html>"""


def test_page(spark):
    pages = spark.createDataFrame([(1, "https://www.example.edu/housing/residence-halls/", PAGE), (2, "https://x.example.edu/news", "<p>broken <b"), (3, "u", None)], "page_id long, url string, html string")
    rows = extraction.page_candidates(pages).collect()
    accepted = {r.name for r in rows if r.accepted}
    assert accepted == {"Swig Hall", "Casa Italiana", "Graham Residence Hall", "Campisi Hall"}
    assert "housing_directory" in extraction.page_roles(extraction.page_signals(pages)).where("page_id = 1").first().roles


STRUCTURES = """<html><head><title>T</title><meta property="og:title" content="On-campus housing"></head><body>
<nav aria-label="Breadcrumb trail"><a href="/">Home</a> <a href="/housing">Housing</a></nav><header><h2>Site Hall</h2></header>
<main><img src="/img/front.jpg"><section><h2>Oak Village</h2>
<div class="views-row"><a href="oak-house">Oak House</a><img src="oak.png"> Suites.</div><div class="views-row"><a href="../elm/">Elm House</a></div><div class="views-row"><span class="title">Ash Lodge</span></div></section>
<table><thead><tr><td>Name</td></tr></thead><tr><td>Birch Hall<td>Double<tr><td>Cedar Hall</td></tr></table>
<ul><li><a href="/units/unit-3"></a><li>second<li><h4>Third Tower</h4></ul>
<select><option>Please select<option>Dogwood Hall</select><a href="/plans/Floor-Plan.pdf">Plans</a><a href="http://[bad">Bad hall</a></main>
<footer><div class="card"><h3>Footer Hall</h3></div></footer><script>"<h1>Script Hall</h1>"</script></body></html>"""


def test_page_structures():
    """Every structural role of candidates, with what a section hands down to its cards."""
    page = extraction.parse_page(STRUCTURES, "https://h.example.edu/living/here/")
    got = {(k["name"], k["structural_role"]): k for k in page["candidates"]}
    card = got["Oak House", "card_title"]
    assert (card["category"], card["parent_hint"], card["href"], card["image"], card["repeated"], card["selector"]) == ("Oak Village", "Oak Village", "https://h.example.edu/living/here/oak-house", "https://h.example.edu/living/here/oak.png", True, ".views-row")
    assert got["Elm House", "card_title"]["href"] == "https://h.example.edu/living/elm/" and got["Ash Lodge", "card_title"]["href"] is None
    rows = [k for k in page["candidates"] if k["structural_role"] == "table_cell"]
    assert [(k["name"], k["surrounding"], k["repeated"], k["category"]) for k in rows] == [("Birch Hall", "Birch HallDouble", False, None), ("Cedar Hall", "Cedar Hall", False, None)]
    assert got["Unit 3", "link"]["href"] == "https://h.example.edu/units/unit-3" and got["Third Tower", "heading"]["role"] == "main"
    assert got["Oak Village", "heading"]["repeated"] is False and got["Dogwood Hall", "select_option"]["surrounding"].startswith("housing select")
    names = {k["name"] for k in page["candidates"]}
    assert not names & {"Site Hall", "Footer Hall", "Script Hall", "Please select", "Home", "Name", "Bad hall"}
    assert (page["og_title"], page["breadcrumbs"], page["image"]) == ("On-campus housing", "Home Housing", "https://h.example.edu/img/front.jpg")
    assert [k["position"] for k in page["candidates"]] == list(range(len(page["candidates"])))
    assert extraction.parse_page("<p>a<p>b", "")["main_text"] == "ab" and extraction.parse_page(None)["candidates"] == []


def test_detail_links(spark):
    pages = spark.createDataFrame([(1, "https://h.example.edu/living/here/", STRUCTURES), (2, None, "<main><img src=logo.png></main>")], "page_id long, url string, html string")
    got = {r.page_id: (r.floor_plan_url, r.virtual_tour_url, r.image) for r in extraction.detail_links(extraction.page_signals(pages)).collect()}
    assert got == {1: ("https://h.example.edu/plans/Floor-Plan.pdf", None, "https://h.example.edu/img/front.jpg"), 2: (None, None, None)}


def test_accept_once(spark):
    rows = spark.createDataFrame([(1, 0, "Oak Hall", False), (1, 1, "Oak Hall", True), (1, 2, "OAK HALL", True), (1, 3, "Elm", True)], "page_id long, position int, name string, accepted boolean")
    assert {(r.position) for r in windows.accept_once(rows).collect()} == {0, 1, 3}


def test_hierarchy(spark):
    schema = "id long, college_id long, name string, kind string, parent_id long, category_label string, description string"
    rows = spark.createDataFrame([(1, 1, "Oak Village", "VILLAGE", None, None, None), (2, 1, "Elm House", "HOUSE", None, "Oak Village", None), (3, 1, "Unit 1", "UNIT", None, None, None), (4, 1, "Christian Hall", "BUILDING", None, None, "Christian Hall is part of Unit 1 residence community"), (5, 1, "Far Hall", "BUILDING", None, None, None)], schema)
    got = {r.id: (r.parent_id, r.confidence) for r in resolution.suggest_hierarchy(rows).collect()}
    assert got == {2: (1, 0.75), 4: (3, 0.85)}


def test_upsert_twice_is_once(spark):
    target = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id long, name string, x long")
    changes = spark.createDataFrame([(2, None, 7), (3, "c", 1)], "id long, name string, x long")
    once = maintenance.apply_changes(target, changes, ["id"], apply=True)
    twice = maintenance.apply_changes(once, changes, ["id"], apply=True)
    want = [(1, "a", None), (2, "b", 7), (3, "c", 1)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want
    assert maintenance.apply_changes(target, changes, ["id"]).count() == 2


def test_source_merge(spark):
    schema = "dorm_id long, url string, final_url string, canonical string, title string, role string, age_days int, arrival int"
    legacy = spark.createDataFrame([(1, "https://a.edu/x?utm_source=1", None, None, None, None, 5, 0)], schema)
    linked = spark.createDataFrame([(1, "https://A.edu/x", None, None, "Halls", "detail", 9, 1), (1, "https://a.edu/rates", None, None, "Rates", "rates", 1, 2)], schema)
    rows = windows.merge_sources(legacy, linked).orderBy("position").collect()
    assert [(r.title, r.role) for r in rows] == [("Halls", "detail"), ("Rates", "rates")]


def test_partitions_do_not_matter(spark):
    from hallspark.queries import QUERIES

    for name in ("match_topk", "highlights", "source_merge"):
        seen = []
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert seen[0] == seen[1]


def test_match_plan_is_native(spark):
    from hallspark.queries.base import view

    frame = matching.match(view(spark, "/root/testdata/sf0.001", "v_profile"), view(spark, "/root/testdata/sf0.001", "v_hall"), weights(), toggle=c("communal_ok"), limit=10)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_conflicts_are_as_of(spark):
    """A value seen before and after another one's time counts as earlier; ties of time don't count as earlier."""
    import random

    from hallspark.operators.resolution import conflicting_provenance

    rng = random.Random(1)
    rows = [(d, "f", rng.choice("XYZ"), rng.randint(1, 4), rng.randint(1, 9)) for d in range(30) for _ in range(rng.randint(1, 12))] + [(99, "f", "X", 1, 1), (99, "f", "X", 1, 9), (99, "f", "Y", 2, 5), (98, "f", None, 1, 1), (98, "f", "X", 2, 2)]
    frame = spark.createDataFrame(rows, "dorm_id int, field string, value string, source_id int, ts int")
    want = []
    for a in rows:
        best = max(((b[4], b[2], b[3]) for b in rows if a[0] == b[0] and None not in (a[2], b[2]) and a[2] != b[2] and a[3] != b[3] and b[4] < a[4]), default=None)
        if best:
            want.append((*a, best[1], best[2], best[0]))
    assert sorted(map(tuple, conflicting_provenance(frame).collect())) == sorted(want) and (99, "f", "Y", 2, 5, "X", 1, 1) in want


def test_slugs_are_given_once(spark):
    from hallspark.operators.maintenance import assign_slugs

    stored = spark.createDataFrame([("state-college",), ("state-college-2",), ("state-college-3",), ("north-7",), ("north",)], "slug string")
    incoming = spark.createDataFrame([(None, "State College", 1), (None, "State College", 2), (7, "North", 3), (8, "North", 4), (None, "!!", 5), (9, "", 6), (None, "Solo 2", 7), (None, "Solo", 8), (None, "Solo", 9)], "ipeds_id long, name string, n int")
    out = {r.n: r.slug for r in assign_slugs(incoming, stored, tie="n").collect()}
    assert out == {1: "state-college-4", 2: "state-college-5", 3: "north-2", 4: "north-8", 5: "institution", 6: "institution-9", 7: "solo-2", 8: "solo", 9: "solo-3"}


def test_accepted_names_block_later_ones(spark):
    from hallspark.operators.windows import accept_once

    rows = [(1, 0, "A", False), (1, 1, "a", True), (1, 2, "A", False), (1, 3, "A", True), (1, 4, "b", False)]
    out = accept_once(spark.createDataFrame(rows, "page_id int, position int, name string, accepted boolean"))
    assert sorted(r.position for r in out.collect()) == [0, 1, 4]


def test_pages_keep_all_their_candidates(spark):
    """125 accepted and 85 rejected names on one page, with copies of the accepted ones behind them."""
    cards = [f'<div class="card"><h3>{name}</h3><p>Double rooms.</p></div>' for name in [*(f"Oak {k} Hall" for k in range(125)), *(f"Oak {k} Dining Hall" for k in range(85)), *(f"OAK {k} HALL" for k in range(125))]]
    pages = spark.createDataFrame([(1, "https://www.example.edu/housing/residence-halls/", f"<main>{''.join(cards)}</main>"), (2, "https://www.example.edu/housing/", f"<main>{''.join(cards[:3])}</main>")], "page_id long, url string, html string")
    cards_of = {(r.page_id, r.position): (r.name, r.accepted) for r in windows.accept_once(extraction.extract(pages).where("structural_role = 'card_title'")).collect()}
    want = {(1, k): (f"Oak {k} Hall", True) for k in range(125)} | {(1, 125 + k): (f"Oak {k} Dining Hall", False) for k in range(85)}
    assert cards_of == want | {(2, k): (f"Oak {k} Hall", True) for k in range(3)}


def test_long_texts_are_judged_whole(spark):
    """What speaks for a candidate, or against it, may stand far behind its name; a name, behind many blanks; a link's word, at its end."""
    cards = [f'<div class="card"><h3>{name}</h3><p>{"Nothing. " * 3000}{end}</p></div>' for name, end in (("Casa Italiana", "Double rooms"), ("Maison Rouge", "Doubled rooms"), ("Haus Mitte", "Laundry; how to apply"))]
    blanks = f'<div class="card"><h3>{" " * 200_000}<b>Oak Hall</b></h3></div>'
    link = f'<p><a href="/x">{"Nothing. " * 3000} dorm</a></p>'
    pages = spark.createDataFrame([(1, "https://www.example.edu/housing/", f"<main>{''.join(cards)}{blanks}{link}</main>")], "page_id long, url string, html string")
    rows = windows.accept_once(extraction.extract(pages)).collect()
    assert {r.name: r.accepted for r in rows if r.structural_role == "card_title"} == {"Casa Italiana": True, "Maison Rouge": False, "Haus Mitte": True, "Oak Hall": True}
    assert {r.name: round(r.score_confidence, 2) for r in rows if r.accepted and r.name in ("Casa Italiana", "Haus Mitte")} == {"Casa Italiana": 0.9, "Haus Mitte": 0.75}
    assert len([r for r in rows if r.structural_role == "link"]) == 1


@pytest.mark.parametrize("head", ["<title>{}</title>", "<h1>{}</h1>", "<div class=breadcrumbs><ol class=breadcrumb>{}</ol></div>"])
def test_roles_are_read_from_whole_heads(spark, head):
    pages = spark.createDataFrame([(1, "https://www.example.edu/x", head.format("Nothing. " * 3000 + "Residence Halls"))], "page_id long, url string, html string")
    row = extraction.page_roles(extraction.page_signals(pages, *extraction.SAYS)).first()
    assert row.roles == ["housing_directory"] and row.breadcrumbs.count("Residence Halls") == ("breadcrumbs" in head)


def test_texts_of_elements_say_what_they_say_alone(monkeypatch):
    """Against a search of each element's own text, on random markup, with words that touch its ends."""
    import random

    monkeypatch.setattr(extraction, "LONGEST_TEXT", 3)
    monkeypatch.setattr(extraction, "LONGEST_PHRASE", 24)
    rng, said = random.Random(5), 0
    words = ("double", "Suites", "s", "x", "hall", "residence hall", "residence", "how to apply", "deadlines", "dead", "mini-suites", "on campus housing option", "housing option", "terms and", "conditions", "  ", "\n", "é", "first", "-year")
    tags = ("div", "article", "h2", "p", "li", "ul", "table", "tr", "td", "script")
    for _ in range(1500):
        page = extraction._Page()
        page.feed("".join(rng.choice((f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", rng.choice(words), rng.choice(words) + " ")) for _ in range(rng.randint(1, 40))))
        page.close()
        for element in page.elements:
            own = " ".join("".join(page.texts[element.first_text : element.last_text]).split())
            assert (page.text(element, 7), page.text(element, 10_000)) == (own[:7], own)
            for key, pattern in extraction.SPEAKS.items():
                assert page.says(element, key) is (bool(pattern.search(own)) if len(own) > 3 else None), (own, key)
                said += bool(pattern.search(own))
    assert said > 1000


def test_topk_keeps_k_rows_before_the_shuffle(spark):
    from hallspark.queries import QUERIES

    plan = QUERIES["match_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
