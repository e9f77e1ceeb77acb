"""Scores and matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import preferences, scores
from ..functions.preferences import dimensions
from ..operators import matching as m
from .base import clamped, query, rnd

c = F.col
TEN = lambda x: clamped(f"{x} * 10e0")
BATH = "CASE bathroom_style WHEN 'PRIVATE' THEN 'PRIVATE' WHEN 'SUITE' THEN 'SUITE' WHEN 'COMMUNAL' THEN 'COMMUNAL' WHEN 'SEMI_PRIVATE' THEN 'SEMI_PRIVATE' END"
VALUE = f"CASE WHEN yearly_cost IS NULL THEN NULL WHEN avg_cost > 0 THEN {clamped('100e0 - ((yearly_cost - avg_cost * 0.8e0) / avg_cost) * 80e0')} ELSE {clamped('100e0 - ((yearly_cost - 8000e0) / 14000e0) * 100e0')} END"
PARTS = {
    "value": (VALUE, "0.18e0"),
    "comfort": ("((CASE WHEN has_ac THEN 85e0 WHEN NOT has_ac THEN 40e0 ELSE 0e0 END) + (CASE bathroom_style WHEN 'PRIVATE' THEN 95e0 WHEN 'SUITE' THEN 75e0 WHEN 'COMMUNAL' THEN 45e0 ELSE 0e0 END)) / nullif((CASE WHEN has_ac IS NULL THEN 0 ELSE 1 END) + (CASE WHEN bathroom_style IN ('PRIVATE', 'SUITE', 'COMMUNAL') THEN 1 ELSE 0 END), 0)", "0.18e0"),
    "privacy": (f"CASE WHEN privacy IS NOT NULL THEN {TEN('privacy')} WHEN bathroom_style = 'PRIVATE' THEN 90e0 WHEN bathroom_style = 'SUITE' THEN 65e0 WHEN bathroom_style = 'COMMUNAL' THEN 35e0 END", "0.14e0"),
    "social": (f"CASE WHEN quiet > 7 THEN {clamped(f'({TEN("social")}) + 10e0')} ELSE {TEN('social')} END", "0.12e0"),
    "convenience": ("CASE WHEN dining_m IS NULL THEN NULL WHEN dining_m < 300 THEN 85e0 WHEN dining_m < 600 THEN 75e0 WHEN dining_m < 1000 THEN 55e0 ELSE 35e0 END", "0.12e0"),
    "freshman": ("CASE WHEN freshman THEN 85e0 WHEN NOT freshman THEN 45e0 END", "0.14e0"),
    "amenity": (clamped("amenity_count / 8e0 * 100e0"), "0.12e0"),
}
RAW = "SELECT h.*, " + ", ".join(f"{x} AS raw_{k}" for k, (x, _) in PARTS.items()) + " FROM {v_hall} h"
SUMS = "SELECT r.*, " + " + ".join(["0e0", *[f"coalesce(raw_{k} * {w}, 0e0)" for k, (_, w) in PARTS.items()]]) + " AS t, " + " + ".join(["0e0", *[f"CASE WHEN raw_{k} IS NULL THEN 0e0 ELSE {w} END" for k, (_, w) in PARTS.items()]]) + " AS w, " + " + ".join(f"CASE WHEN raw_{k} IS NULL THEN 0 ELSE 1 END" for k in PARTS) + f" AS known FROM ({RAW}) r"
SCORED = f"SELECT s.*, known >= 3 AS scoreable, CASE WHEN known >= 3 THEN {rnd(clamped('t / w'))} END AS overall_score, known / 7e0 AS score_completeness, {rnd('CASE WHEN confidence <= 1 THEN confidence * 100e0 ELSE confidence END')} AS data_confidence, " + ", ".join(f"{rnd(f'raw_{k}')} AS {k}_score" for k in PARTS) + f" FROM ({SUMS}) s"


def scored(v):
    return scores.with_scores(v("v_hall"))


@query(f"SELECT id, overall_score, scoreable, score_completeness, data_confidence, {', '.join(f'{k}_score' for k in PARTS)} FROM ({SCORED}) x")
def hall_scores(v):
    return scored(v).select("id", "overall_score", "scoreable", "score_completeness", "data_confidence", *[f"{k}_score" for k in PARTS])


@query(f"""SELECT id, CASE WHEN NOT scoreable THEN 'Not enough data to compute a quality score yet.' ELSE concat_ws('|',
    CASE WHEN value_score >= 70 THEN 'Strong value relative to typical costs at this school.' WHEN value_score < 45 THEN 'Higher cost than many peers.' END, CASE WHEN comfort_score >= 75 THEN 'Comfort features boost this score.' END,
    CASE WHEN privacy_score >= 70 THEN 'Better privacy.' END, CASE WHEN social_score >= 75 THEN 'Known as a social hall.' END, CASE WHEN freshman_score >= 80 THEN 'Especially suitable for first-year students.' END,
    CASE WHEN data_confidence < 60 THEN 'Some data is uncertain.' END, CASE WHEN score_completeness < 0.5e0 THEN 'Limited data available.' END) END AS lines FROM ({SCORED}) x""")
def score_explanations(v):
    return scored(v).select("id", F.array_join(scores.explain_score(), "|").alias("lines"))


@query(f"SELECT scoreable, count(*) AS n, min(overall_score) AS least, max(overall_score) AS most FROM ({SCORED}) x GROUP BY scoreable")
def score_summary(v):
    from ..operators.reports import score_summary as run

    return run(scored(v))


@query("""SELECT id, concat_ws('|', CASE WHEN has_ac THEN 'Has AC' END, CASE WHEN freshman THEN 'Freshman Friendly' END, CASE WHEN dorm_type = 'SUITE' OR bathroom_style = 'SUITE' THEN 'Suite Style' END, CASE WHEN dorm_type = 'APARTMENT' THEN 'Apartment Style' END,
    CASE WHEN honors THEN 'Honors Housing' END, CASE WHEN social >= 7 THEN 'Social Dorm' END, CASE WHEN quiet >= 7 THEN 'Quiet Dorm' END, CASE WHEN yearly_cost <> 0 AND avg_cost <> 0 AND yearly_cost < avg_cost * 0.95e0 THEN 'Best Value' END,
    CASE WHEN coalesce(dining_m, 9999) < 400 THEN 'Close to Dining' END, CASE WHEN confidence >= 0.85e0 THEN 'High Confidence Data' WHEN confidence < 0.6e0 THEN 'Needs Verification' END, CASE WHEN NOT is_verified AND confidence < 0.7e0 THEN 'Needs Verification' END) AS badges FROM {v_hall}""")
def badges(v):
    return v("v_hall").select("id", F.array_join(scores.badges(), "|").alias("badges"))


SUMMARY = "concat_ws(' ', CASE WHEN has_ac AND bathroom_style = 'SUITE' AND coalesce(yearly_cost, 0e0) > coalesce(avg_cost, 15000e0) THEN 'Likely comfortable (AC and suite bathrooms) but on the expensive side.' END, CASE WHEN freshman AND bathroom_style = 'COMMUNAL' THEN 'May be more social with communal bathrooms.' END, CASE WHEN dorm_type = 'APARTMENT' AND kitchen AND upperclass THEN 'Fits students who want independence.' END, CASE WHEN honors THEN 'Honors or themed community.' END, CASE WHEN social >= 8 THEN 'Often described as lively and social.' END, CASE WHEN quiet >= 8 THEN 'Tends to be quieter.' END, CASE WHEN NOT coalesce(has_ac, false) THEN 'May not have air conditioning.' END)"


@query(f"SELECT id, CASE WHEN {SUMMARY} = '' THEN 'A solid on-campus option.' ELSE {SUMMARY} END AS summary FROM {{v_hall}}")
def hall_summaries(v):
    return v("v_hall").select("id", scores.hall_summary().alias("summary"))


WEIGHTS = {"socialAtmosphere": "w_social", "quietAtmosphere": "w_quiet", "bathroomPrivacy": "w_bath", "communalBathroomOk": "w_amenities", "airConditioning": "w_ac", "laundry": "w_laundry", "buildingAmenities": "w_amenities", "proximityDining": "w_dining", "affordability": "w_affordability"}
STYLE = f"CASE {BATH} WHEN 'PRIVATE' THEN 95e0 WHEN 'SEMI_PRIVATE' THEN 80e0 WHEN 'SUITE' THEN 70e0 WHEN 'COMMUNAL' THEN 30e0 END"
RATING = lambda x: clamped(f"{x} / 10e0 * 100e0")
DIMS = {
    "socialAtmosphere": RATING("social"),
    "quietAtmosphere": RATING("quiet"),
    "bathroomPrivacy": f"CASE WHEN privacy IS NULL THEN {STYLE} WHEN {STYLE} IS NULL THEN {RATING('privacy')} ELSE {clamped(f'({RATING("privacy")}) * 0.5e0 + ({STYLE}) * 0.5e0')} END",
    "communalBathroomOk": f"CASE WHEN {BATH} IS NULL THEN NULL WHEN communal_ok = false THEN CASE WHEN {BATH} = 'COMMUNAL' THEN 20e0 ELSE 80e0 END ELSE CASE WHEN {BATH} = 'COMMUNAL' THEN 100e0 ELSE 40e0 END END",
    "airConditioning": "CASE WHEN has_ac THEN 100e0 WHEN NOT has_ac THEN 0e0 END",
    "laundry": "CASE WHEN laundry THEN 100e0 WHEN NOT laundry THEN 0e0 END",
    "buildingAmenities": clamped("amenity_count / 8e0 * 100e0"),
    "proximityDining": clamped("(1e0 - dining_m / 1200e0) * 100e0"),
    "affordability": f"CASE WHEN yearly_cost IS NULL THEN NULL WHEN avg_cost > 0 THEN {clamped('100e0 - ((yearly_cost / avg_cost - 0.8e0) / 0.6e0) * 100e0')} ELSE {clamped('100e0 - ((yearly_cost - 8000e0) / 14000e0) * 100e0')} END",
}
VIOLATED = "concat_ws('|', CASE WHEN require_freshman AND NOT freshman THEN 'Not eligible for freshmen' END, CASE WHEN yearly_cost > max_budget THEN 'Yearly cost exceeds budget' END, CASE WHEN require_private_or_suite AND bathroom_style = 'COMMUNAL' THEN 'Bathroom is communal; private or suite required' END, CASE WHEN require_ac AND NOT has_ac THEN 'No air conditioning' END)"
UNKNOWN = "concat_ws('|', CASE WHEN require_freshman AND freshman IS NULL THEN 'Freshman eligibility not verified' END, CASE WHEN max_budget IS NOT NULL AND yearly_cost IS NULL THEN 'Cost not verified against budget' END, CASE WHEN require_private_or_suite AND bathroom_style = 'UNKNOWN' THEN 'Private/suite bathroom not verified' END, CASE WHEN require_ac AND has_ac IS NULL THEN 'Air conditioning not verified' END)"
PAIRS = f"SELECT p.*, h.id AS hall_id, h.*, {VIOLATED} AS violated, {UNKNOWN} AS unknown_facts, " + ", ".join(f"{x} AS d_{k}" for k, x in DIMS.items()) + " FROM (SELECT id AS profile_id, p0.* EXCLUDE (id) FROM {v_profile} p0) p JOIN (SELECT * FROM {v_hall} WHERE assignable IS DISTINCT FROM false AND granular IS DISTINCT FROM false) h ON p.college_id = h.college_id"
_t = " + ".join(["0e0", *[f"CASE WHEN {w} > 0 AND d_{k} IS NOT NULL THEN d_{k} * {w} ELSE 0e0 END" for k, w in WEIGHTS.items()]])
_w = " + ".join(["0e0", *[f"CASE WHEN {w} > 0 AND d_{k} IS NOT NULL THEN {w} ELSE 0e0 END" for k, w in WEIGHTS.items()]])
_m = " + ".join(["0e0", *[f"CASE WHEN {w} > 0 THEN {w} ELSE 0e0 END" for w in WEIGHTS.values()]])
TOTALS = f"SELECT q.*, CASE WHEN violated <> '' THEN 'excluded' WHEN unknown_facts <> '' THEN 'unverified' ELSE 'eligible' END AS outcome, CASE WHEN violated <> '' THEN violated ELSE unknown_facts END AS reasons, {_t} AS t, {_w} AS w, {_m} AS mass FROM ({PAIRS}) q"
FRESH = "CASE WHEN age_days IS NULL THEN 0.7e0 WHEN age_days <= 180 THEN 1e0 WHEN age_days <= 365 THEN 0.9e0 WHEN age_days <= 730 THEN 0.75e0 ELSE 0.55e0 END"
SURE = rnd(clamped(f"((CASE WHEN mass > 0 THEN w / mass ELSE 1e0 END) * 0.55e0 + (confidence * 0.6e0 + completeness * 0.4e0) * 0.3e0 + ({FRESH}) * 0.15e0) * 100e0"))
JUDGED = f"SELECT x.*, CASE WHEN w > 0 THEN {rnd(clamped('t / w'))} ELSE 0 END AS match_score, {SURE} AS confidence_score FROM ({TOTALS}) x"
RANKED = f"SELECT y.*, CASE WHEN outcome = 'excluded' THEN 0 ELSE row_number() OVER (PARTITION BY profile_id, outcome ORDER BY match_score DESC, confidence_score DESC, name, hall_id) END AS rank FROM ({JUDGED}) y"
LABEL = "CASE WHEN confidence_score >= 75 THEN 'high' WHEN confidence_score >= 50 THEN 'medium' WHEN confidence_score >= 25 THEN 'low' ELSE 'very_low' END"


def weights():
    return {k: c(w) for k, w in WEIGHTS.items()}


def matched(v):
    return m.match(v("v_profile"), v("v_hall"), weights(), toggle=c("communal_ok"))


def best(v, limit=10):
    return m.match(v("v_profile"), v("v_hall"), weights(), toggle=c("communal_ok"), limit=limit, outcomes=("eligible",))


@query(f"SELECT profile_id, hall_id, name, match_score, confidence_score, {LABEL} AS confidence_label, CAST(rank AS INTEGER) AS rank FROM ({RANKED}) z WHERE outcome = 'eligible' AND rank <= 10")
def match_topk(v):
    """The ten best halls of every profile: the flagship."""
    return best(v).select("profile_id", "hall_id", "name", "match_score", "confidence_score", "confidence_label", "rank")


@query(f"SELECT profile_id, hall_id, outcome, CAST(rank AS INTEGER) AS rank, CASE WHEN outcome = 'excluded' THEN 0 ELSE match_score END AS match_score, confidence_score / 100e0 AS confidence, reasons FROM ({RANKED}) z")
def match_outcomes(v):
    return m.match_results(matched(v)).select("profile_id", "hall_id", "outcome", "rank", "match_score", "confidence", F.array_join("outcome_reasons", "|").alias("reasons"))


@query(f"SELECT outcome, count(*) AS n, count(DISTINCT profile_id) AS n_profiles FROM ({TOTALS}) x GROUP BY outcome")
def match_outcome_counts(v):
    pairs = m.match_pairs(v("v_profile"), m.with_evidence(m.filter_matchable(v("v_hall"))))
    return m.classify_constraints(pairs).groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("profile_id").alias("n_profiles"))


_long = " UNION ALL ".join(f"SELECT profile_id, hall_id, '{k}' AS dimension, CASE WHEN d_{k} IS NULL THEN 0 ELSE {rnd(f'd_{k}')} END AS score, {w} AS weight, d_{k} IS NOT NULL AS has_evidence FROM top WHERE {w} > 0" for k, w in WEIGHTS.items())


@query(f"WITH top AS (SELECT * FROM ({RANKED}) z WHERE outcome = 'eligible' AND rank <= 10) {_long}".replace("WITH top AS", "SELECT * FROM (WITH top AS") + ") long_form")
def dimension_scores_long(v):
    top = best(v).withColumn("d", F.explode(m.dimension_scores(None, weights(), c("communal_ok"))))
    return top.select("profile_id", "hall_id", c("d.id").alias("dimension"), "d.score", "d.weight", "d.has_evidence")


_dims = {d.id: d for d in dimensions()}
_entries = ", ".join(f"@<'by': -CAST({w} AS DOUBLE), 'k': {i}, 's': CASE WHEN d_{k} IS NOT NULL THEN {rnd(f'd_{k}')} END, 'p': '{_dims[k].texts[0]}', 'n': '{_dims[k].texts[1]}', 'u': '{_dims[k].texts[2]}'>@" for i, (k, w) in enumerate(WEIGHTS.items()))
_some = lambda test, text: f"list_transform(list_filter(entries, lambda e: {test}), lambda e: e.{text})"
_first = f"{_some('e.s IS NULL', 'u')}[1:5]"
_must = f"list_filter({_some('e.s IS NULL AND e.by <= -3', 'u')}, lambda t: NOT list_contains({_first}, t))"
REASONS = f"SELECT profile_id, hall_id, name, match_score, {_some('e.s >= 65', 'p')}[1:5] AS positives, {_some('e.s < 45', 'n')}[1:5] AS tradeoffs, list_concat({_first}, {_must})[1:6] AS unknowns FROM (SELECT z.*, list_filter(list_sort([{_entries}]), lambda e: e.by < 0) AS entries FROM ({RANKED}) z WHERE outcome = 'eligible' AND rank <= 10) t"


def reasoned(v):
    return m.match_reasons(best(v), weights(), c("communal_ok"))


@query(f"SELECT profile_id, hall_id, array_to_string(positives, '|') AS positives, array_to_string(tradeoffs, '|') AS tradeoffs, array_to_string(unknowns, '|') AS unknowns FROM ({REASONS}) r")
def match_reasons(v):
    return reasoned(v).select("profile_id", "hall_id", *[F.array_join(k, "|").alias(k) for k in ("positives", "tradeoffs", "unknowns")])


@query(f"SELECT profile_id, hall_id, concat(name, ': ', concat_ws(', ', concat(CASE WHEN match_score >= 75 THEN 'Strong match' WHEN match_score >= 55 THEN 'Good fit' ELSE 'Moderate fit' END, ' (', CAST(match_score AS VARCHAR), '%)'), CASE WHEN len(positives) > 0 THEN array_to_string(positives[1:2], '; ') END, CASE WHEN len(tradeoffs) > 0 THEN concat('tradeoff: ', tradeoffs[1]) END), '.') AS sentence FROM ({REASONS}) r")
def match_sentences(v):
    return reasoned(v).select("profile_id", "hall_id", m.match_sentence().alias("sentence"))


@query(f"SELECT profile_id, hall_id, len(positives) AS n_positives, len(tradeoffs) AS n_tradeoffs, len(unknowns) AS n_unknowns FROM ({REASONS}) r")
def match_reason_counts(v):
    return reasoned(v).select("profile_id", "hall_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("positives", "tradeoffs", "unknowns")])


@query(" UNION ALL ".join(f"SELECT p.id AS profile_id, '{d.id}' AS dimension, '{d.category}' AS category, '{d.mode}' AS mode, {str(d.may_be_required).lower()} AS may_be_required, CAST({w} AS DOUBLE) AS weight FROM @v_profile@ p".replace("@v_profile@", "{v_profile}") for k, w in WEIGHTS.items() for d in [_dims[k]]))
def profile_dimensions(v):
    """The registry's rows that a profile weighs."""
    rows = F.array(*[F.struct(F.lit(_dims[k].id).alias("dimension"), F.lit(_dims[k].category).alias("category"), F.lit(_dims[k].mode).alias("mode"), F.lit(_dims[k].may_be_required).alias("may_be_required"), c(w).cast("double").alias("weight")) for k, w in WEIGHTS.items()])
    return v("v_profile").select(c("id").alias("profile_id"), F.explode(rows).alias("d")).select("profile_id", "d.*")


def quizzes(v):
    k = c("id")
    return v("v_profile").select(
        "id", "college_id", (k % 3 == 0).alias("is_freshman"), (k % 2 == 0).alias("prefers_social"), (k % 5 == 0).alias("prefers_quiet"), (k % 11).cast("int").alias("priority_price"), (k % 7).cast("int").alias("priority_comfort"), (k % 9).cast("int").alias("priority_privacy"), (k % 10).cast("int").alias("priority_location"), (k % 4 == 0).alias("wants_ac"),
        F.when(k % 3 == 0, "private").when(k % 3 == 1, "suite").otherwise("communal").alias("bathroom"), (k % 6 == 0).alias("near_dining"), (k % 8 == 0).alias("apartment_style"), (k % 7 == 0).alias("honors_themed"), (k % 5 == 1).alias("study_lounges"), F.when(k % 2 == 0, "cheapest").otherwise("best_fit").alias("goal"),
    )


@query(f"""SELECT id, CASE WHEN id % 2 = 0 THEN 4e0 ELSE CAST({rnd('(id % 11) / 2.5e0')} AS DOUBLE) END AS w_affordability, CASE WHEN id % 4 = 0 THEN 3e0 ELSE 0e0 END AS "w_airConditioning", CAST({rnd('(id % 9) / 2.5e0')} AS DOUBLE) AS w_privacy,
    CASE WHEN id % 3 = 2 THEN 2e0 ELSE 0e0 END AS "w_communalBathroomOk", CAST({rnd('(id % 7) / 2.5e0')} AS DOUBLE) AS w_cleanliness, CASE WHEN id % 2 = 0 THEN 1e0 ELSE 2e0 END AS "w_overallSatisfaction", CASE WHEN id % 3 = 0 THEN true END AS require_freshman, id % 3 = 2 AS communal_ok FROM {{v_profile}}""")
def quiz_profiles(v):
    return m.quiz_profile(quizzes(v)).select("id", "w_affordability", "w_airConditioning", "w_privacy", "w_communalBathroomOk", "w_cleanliness", "w_overallSatisfaction", "require_freshman", "communal_ok")


@query("""SELECT id, (id % 9) / 2.5e0 AS w_privacy, CASE WHEN id % 2 = 0 THEN 4e0 ELSE 2e0 END AS w_value, CASE WHEN id % 3 = 0 THEN true END AS require_freshman, CASE WHEN id % 4 = 0 THEN true END AS require_ac, CASE WHEN id % 3 = 0 THEN true END AS require_private_bath, CASE WHEN id % 3 = 1 THEN true END AS require_private_or_suite FROM {v_profile}""")
def quiz_profiles_route(v):
    return m.quiz_profile_route(quizzes(v)).select("id", "w_privacy", "w_value", "require_freshman", "require_ac", "require_private_bath", "require_private_or_suite")


@query()
def quiz_topk(v):
    return m.quiz_topk(quizzes(v), v("v_hall")).select("profile_id", "hall_id", "match_score", "confidence_score", "rank")


@query(f"""WITH s AS ({SCORED}), l AS (SELECT a.id AS a_id, b.id AS b_id, concat_ws(' ', CASE WHEN a.social > b.social + 1 THEN concat(a.name, ' is more social.') WHEN b.social > a.social + 1 THEN concat(b.name, ' is more social.') END,
    CASE WHEN a.yearly_cost < b.yearly_cost * 0.95e0 THEN concat(a.name, ' costs less.') WHEN b.yearly_cost < a.yearly_cost * 0.95e0 THEN concat(b.name, ' costs less.') END,
    CASE WHEN a.privacy_score > b.privacy_score + 10 THEN concat(a.name, ' offers more privacy.') WHEN b.privacy_score > a.privacy_score + 10 THEN concat(b.name, ' offers more privacy.') END,
    CASE WHEN a.overall_score > b.overall_score + 5 THEN concat(a.name, ' scores higher overall.') WHEN b.overall_score > a.overall_score + 5 THEN concat(b.name, ' scores higher overall.') END) AS t FROM s a JOIN s b ON b.id = a.id + 1)
    SELECT a_id, b_id, CASE WHEN t = '' THEN 'Both halls are fairly similar.' ELSE t END AS comparison FROM l""".replace("WITH s AS", "SELECT * FROM (WITH s AS") + ") compared")
def compare_neighbours(v):
    halls = scored(v)
    pairs = halls.select(c("id").alias("a_id"), (c("id") + 1).alias("b_id"))
    return m.compare_pair(pairs, halls)


def _flag(x: str, yes: float, no: float) -> str:
    return f"CASE WHEN {x} THEN {yes}e0 WHEN NOT {x} THEN {no}e0 END"


def _near(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN {clamped(f'(1e0 - {x} / 1200e0) * 100e0')} END"


def _mean(*parts: str) -> str:
    return "(" + " + ".join(f"coalesce({p}, 0e0)" for p in parts) + ") / nullif(" + " + ".join(f"CAST(({p}) IS NOT NULL AS INTEGER)" for p in parts) + ", 0)"


_LARGE = clamped("(coalesce(building_capacity, resident_count) - 50) / 750e0 * 100e0")
_HALL = "CASE WHEN dorm_type IN ('RESIDENCE_HALL', 'MIXED', 'FRESHMAN_ONLY') THEN 100e0 ELSE 0e0 END"
_APARTMENT = "(dorm_type LIKE '%APARTMENT%' OR dorm_type LIKE '%TOWNHOUSE%')"
_QUALITY = f"coalesce({RATING('overall_satisfaction')}, {RATING('(CASE WHEN overall_rating > 10 THEN overall_rating / 10e0 ELSE overall_rating END)')})"
#: Dimensions that profiles seldom weigh.
RARE = {
    "roomSpaciousness": f"coalesce({RATING('spaciousness')}, {RATING('room_spaciousness')})",
    "storage": f"coalesce({RATING('storage_rating')}, {_flag('has_storage', 75, 25)})",
    "renovatedNewer": f"coalesce({_flag('is_renovated', 90, 35)}, CASE WHEN 2026 - renovation_year <= 5 THEN 95e0 WHEN 2026 - renovation_year <= 10 THEN 80e0 WHEN 2026 - renovation_year <= 20 THEN 55e0 WHEN renovation_year IS NOT NULL THEN 30e0 END, CASE WHEN building_age <= 10 THEN 85e0 WHEN building_age <= 25 THEN 55e0 WHEN building_age IS NOT NULL THEN 30e0 END)",
    "studyEnvironment": _mean(_flag("study_lounges", 100, 20), RATING("quiet")),
    "communityAtmosphere": f"coalesce({RATING('community')}, {RATING('social')})",
    "suiteStyle": "CASE WHEN dorm_type LIKE '%SUITE%' THEN 100e0 ELSE 0e0 END",
    "apartmentStyle": _flag(_APARTMENT, 100, 0),
    "corridorStyle": _HALL,
    "traditionalDormExperience": f"CASE WHEN {BATH} = 'COMMUNAL' THEN {clamped(f'({_HALL}) + 15e0')} ELSE {_HALL} END",
    "apartmentIndependence": _mean(_flag(_APARTMENT, 100, 20), _flag("kitchen", 100, 30)),
    "proximityGym": _near("gym_m"),
    "location": _mean(_near("dining_m"), _near("class_m"), _near("gym_m")),
    "buildingSizeLarge": _LARGE,
    "buildingSizeSmall": f"100e0 - ({_LARGE})",
    "overallSatisfaction": f"coalesce({RATING('overall_satisfaction')}, CASE WHEN overall_rating <= 10 THEN {RATING('overall_rating')} ELSE overall_rating END)",
    "value": f"CASE WHEN ({DIMS['affordability']}) IS NULL THEN {_QUALITY} WHEN {_QUALITY} IS NULL THEN {DIMS['affordability']} ELSE {clamped(f'({DIMS["affordability"]}) * 0.55e0 + ({_QUALITY}) * 0.45e0')} END",
    "genderInclusive": _flag("gender_inclusive", 100, 0),
    "substanceFree": _flag("substance_free", 100, 0),
    "upperclassFriendly": _flag("upperclass", 100, 0),
    "elevator": _flag("elevator", 100, 0),
    "kitchens": _flag("kitchen", 100, 0),
}


@query("SELECT id, " + ", ".join(f'floor(({x}) * 1e6 + 0.5e0) / 1e6 AS "{k}"' for k, x in RARE.items()) + " FROM {v_evidence}")
def hall_dimensions(v):
    """Every hall by dimensions that profiles seldom weigh."""
    halls = v("v_evidence")
    halls = halls.withColumns({k: F.lit(None).cast(t) for k, t in preferences.EVIDENCE.items() if k not in halls.columns})
    of = {d.id: d.score(preferences.Options()) for d in preferences.dimensions()}
    return halls.select("id", *[(F.floor(of[k] * 1e6 + 0.5) / 1e6).alias(k) for k in RARE])
