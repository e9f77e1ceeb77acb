"""Halls against preference profiles: constraints in three outcomes, weighted scores, confidence, reasons and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import clamp, listed, rounded
from ..functions.preferences import EVIDENCE, Options, accessibility, bath_class_rank, dimensions, has_private_bath, has_single, has_suite_bath, substance_free

c = F.col
FLAGS = ("require_freshman", "require_upperclass", "require_single", "require_private_bath", "require_private_or_suite", "require_gender_inclusive", "require_ac", "require_accessibility", "require_substance_free", "require_elevator")


def with_evidence(halls: DataFrame) -> DataFrame:
    """Add what a table of halls lacks as unknown."""
    return halls.withColumns({k: F.lit(None).cast(t) for k, t in EVIDENCE.items() if k not in halls.columns})


def filter_matchable(halls: DataFrame) -> DataFrame:
    """Drop halls that are known not to be assignable or granular; unknown passes."""
    return halls.where(~c("assignable").eqNullSafe(False) & ~c("granular").eqNullSafe(False))


def filter_published(halls: DataFrame) -> DataFrame:
    return halls.where(c("is_active") & c("assignable") & c("granular") & (c("status") != "QUARANTINED"))


def _tri(flag: str, fact: Column, no: str, unknown: str) -> tuple[Column, Column]:
    wanted = F.coalesce(c(flag), F.lit(False))
    return F.when(wanted & ~fact, no), F.when(wanted & fact.isNull(), unknown)


def classify_constraints(pairs: DataFrame) -> DataFrame:
    """Add outcome (excluded if a constraint is violated, else unverified if a fact is unknown, else eligible) and outcome_reasons. Constraints are the columns of FLAGS and max_budget; absent ones don't constrain."""
    rows = pairs.withColumns({k: F.lit(None).cast("boolean") for k in FLAGS if k not in pairs.columns})
    if "max_budget" not in rows.columns:
        rows = rows.withColumn("max_budget", F.lit(None).cast("double"))
    cost, budget = c("yearly_cost"), c("max_budget")
    private, suite = has_private_bath(), has_suite_bath()
    either = F.coalesce(c("require_private_or_suite"), F.lit(False))
    communal = bath_class_rank(c("bathroom_style")) == "COMMUNAL"
    checks = [
        _tri("require_freshman", c("freshman"), "Not eligible for freshmen", "Freshman eligibility not verified"),
        _tri("require_upperclass", c("upperclass"), "Not eligible for upperclass students", "Upperclass eligibility not verified"),
        (F.when(cost > budget, "Yearly cost exceeds budget"), F.when(budget.isNotNull() & cost.isNull(), "Cost not verified against budget")),
        _tri("require_single", has_single(), "No single rooms available", "Single-room availability not verified"),
        _tri("require_private_bath", private, "Does not have a private bathroom", "Private bathroom not verified"),
        (
            F.when(either & ~private & (F.coalesce(~suite, F.lit(False)) | (suite.isNull() & F.coalesce(communal, F.lit(False)))), "Bathroom is communal; private or suite required"),
            F.when(either & suite.isNull() & (private.isNull() | (~private & bath_class_rank(c("bathroom_style")).isNull())), "Private/suite bathroom not verified"),
        ),
        _tri("require_gender_inclusive", c("gender_inclusive"), "Not gender-inclusive housing", "Gender-inclusive status not verified"),
        _tri("require_ac", c("has_ac"), "No air conditioning", "Air conditioning not verified"),
        _tri("require_accessibility", accessibility(), "Accessibility features not available", "Accessibility not verified"),
        _tri("require_substance_free", substance_free(), "Not a substance-free community", "Substance-free status not verified"),
        _tri("require_elevator", c("elevator"), "No elevator access", "Elevator access not verified"),
    ]
    violated, unknown = listed(*[v for v, _ in checks]), listed(*[u for _, u in checks])
    rows = rows.withColumns({"__v": violated, "__u": unknown})
    outcome = F.when(F.size("__v") > 0, "excluded").when(F.size("__u") > 0, "unverified").otherwise("eligible")
    reasons = F.when(F.size("__v") > 0, c("__v")).otherwise(c("__u"))
    return rows.withColumns({"outcome": outcome, "outcome_reasons": reasons}).drop("__v", "__u", *[k for k in FLAGS if k not in pairs.columns])


def with_dimensions(halls: DataFrame, options: Options | None = None, names: list[str] | None = None) -> DataFrame:
    """Score columns dim_<id> of every hall; computed once a hall, before it meets profiles. The one that depends on a profile comes as two."""
    options = options or Options()
    full = with_evidence(halls)
    added = {f"dim_{d.id}": d.score(options) for d in dimensions() if names is None or d.id in names}
    if names is None or "communalBathroomOk" in names:
        unwanted = Options(options.current_year, options.proximity_max, F.lit(False))
        added["dim_communalBathroomOk_unwanted"] = next(d for d in dimensions() if d.id == "communalBathroomOk").score(unwanted)
    return full.withColumns(added)


def freshness(age_days: Column) -> Column:
    return F.when(age_days.isNull(), 0.7).when(age_days <= 180, 1.0).when(age_days <= 365, 0.9).when(age_days <= 730, 0.75).otherwise(0.55)


def review_factor(confidence: Column, completeness: Column) -> Column:
    unit = lambda x: F.when(x <= 1, x).otherwise(x / 100.0)
    a, b = unit(confidence), unit(completeness)
    return F.when(a.isNull() & b.isNull(), 0.6).when(a.isNull(), b).when(b.isNull(), a).otherwise(a * 0.6 + b * 0.4)


def confidence_label(x: Column) -> Column:
    return F.when(x >= 75, "high").when(x >= 50, "medium").when(x >= 25, "low").otherwise("very_low")


def _dim(name: str, toggle: Column | None) -> Column:
    if name == "communalBathroomOk" and toggle is not None:
        return F.when(toggle == False, c("dim_communalBathroomOk_unwanted")).otherwise(c("dim_communalBathroomOk"))  # noqa: E712
    return c(f"dim_{name}")


def match_score(pairs: DataFrame, weights: dict[str, Column], toggle: Column | None = None, age_days: Column | None = None) -> DataFrame:
    """Add match_score, confidence_score and confidence_label to pairs of scored halls and profiles. ``weights``: column of each weight; names that no dimension has are ignored, weights up to 0 and unknown dimensions are skipped."""
    total, weight, mass = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for d in dimensions():
        if d.id in weights:
            w, s = F.coalesce(weights[d.id].cast("double"), F.lit(0.0)), _dim(d.id, toggle)
            used = w > 0
            total = total + F.when(used & s.isNotNull(), s * w).otherwise(0.0)
            weight = weight + F.when(used & s.isNotNull(), w).otherwise(0.0)
            mass = mass + F.when(used, w).otherwise(0.0)
    out = pairs.withColumns({"__t": total, "__w": weight, "__m": mass})
    coverage = F.when(c("__m") > 0, c("__w") / c("__m")).otherwise(1.0)
    sure = rounded(clamp((coverage * 0.55 + review_factor(c("confidence"), c("completeness")) * 0.3 + freshness(c("age_days") if age_days is None else age_days) * 0.15) * 100.0))
    out = out.withColumns({"match_score": F.when(c("__w") > 0, rounded(clamp(c("__t") / c("__w")))).otherwise(F.lit(0)).cast("long"), "confidence_score": sure}).drop("__t", "__w", "__m")
    return out.withColumn("confidence_label", confidence_label(c("confidence_score")))


def dimension_scores(pairs: DataFrame, weights: dict[str, Column], toggle: Column | None = None) -> Column:
    """Array of (id, score rounded or 0, weight, has_evidence, order) of the dimensions with a weight above 0."""
    entries = []
    for k, d in enumerate(dimensions()):
        if d.id in weights:
            w, s = F.coalesce(weights[d.id].cast("double"), F.lit(0.0)), _dim(d.id, toggle)
            entries.append(F.when(w > 0, F.struct((-w).alias("by"), F.lit(k).alias("k"), F.lit(d.id).alias("id"), F.coalesce(rounded(s), F.lit(0)).cast("long").alias("score"), w.alias("weight"), s.isNotNull().alias("has_evidence"), F.lit(d.texts[0]).alias("positive"), F.lit(d.texts[1]).alias("negative"), F.lit(d.texts[2]).alias("unknown"))))
    return F.array_sort(F.array_compact(F.array(*entries)))


def match_reasons(pairs: DataFrame, weights: dict[str, Column], toggle: Column | None = None) -> DataFrame:
    """Add positives, tradeoffs (up to 5 each, by weight; judged on rounded scores) and unknowns (up to 5, then up to 6 with those of weight 3 and more). Build them after a limit, not before."""
    out = pairs.withColumn("__d", dimension_scores(pairs, weights, toggle))
    known = F.filter("__d", lambda d: d["has_evidence"])
    missing = F.filter("__d", lambda d: ~d["has_evidence"])
    good = F.transform(F.filter(known, lambda d: d["score"] >= 65), lambda d: d["positive"])
    poor = F.transform(F.filter(known, lambda d: d["score"] < 45), lambda d: d["negative"])
    first = F.slice(F.transform(missing, lambda d: d["unknown"]), 1, 5)
    must = F.transform(F.filter(missing, lambda d: d["weight"] >= 3), lambda d: d["unknown"])
    return out.withColumns({"positives": F.slice(good, 1, 5), "tradeoffs": F.slice(poor, 1, 5), "unknowns": F.slice(F.array_union(first, must), 1, 6)}).drop("__d")


def rank_matches(matches: DataFrame, run_key: str | tuple[str, ...], limit: int | None = None) -> DataFrame:
    keys = (run_key,) if isinstance(run_key, str) else run_key
    order = Window.partitionBy(*keys).orderBy(F.desc("match_score"), F.desc("confidence_score"), F.asc("name"), F.asc("hall_id"))
    ranked = matches.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(c("rank") <= limit)


def match_pairs(profiles: DataFrame, halls: DataFrame) -> DataFrame:
    """Profiles with the halls of their institution. Halls were scored once, so a pair costs a dot product; adaptive execution splits large institutions."""
    own = halls.withColumnRenamed("id", "hall_id")
    return profiles.withColumnRenamed("id", "profile_id").join(own, "college_id")


OUTCOMES = ("eligible", "unverified", "excluded")


def match(profiles: DataFrame, halls: DataFrame, weights: dict[str, Column], *, toggle: Column | None = None, limit: int | None = None, options: Options | None = None, outcomes: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """Every profile and hall of its institution with one of the ``outcomes``: eligible halls ranked, up to ``limit`` a profile, unverified ones scored, excluded ones with reasons and rank 0.

    With a limit eligible rows are ranked apart, so that each task keeps that many a profile before the shuffle; without
    one all outcomes are ranked in one window, over one fan-out."""
    scored = with_dimensions(filter_matchable(halls), options, [k for k in weights])
    judged = match_score(classify_constraints(match_pairs(profiles, scored)), weights, toggle)
    unranked = F.when(c("outcome") == "excluded", 0).otherwise(c("rank"))
    if limit is None:
        return rank_matches(judged.where(c("outcome").isin(*outcomes)), ("profile_id", "outcome")).withColumn("rank", unranked)
    eligible = rank_matches(judged.where(c("outcome") == "eligible"), "profile_id", limit)
    rest = [k for k in outcomes if k != "eligible"]
    if not rest:
        return eligible
    others = rank_matches(judged.where(c("outcome").isin(rest)), ("profile_id", "outcome")).withColumn("rank", unranked)
    return eligible.unionByName(others) if "eligible" in outcomes else others


def match_results(matches: DataFrame) -> DataFrame:
    """The rows that a run stores: ranks from 1, confidence from 0 to 1, rank 0 for excluded halls."""
    return matches.select("profile_id", "hall_id", "outcome", "rank", F.when(c("outcome") != "excluded", c("match_score")).otherwise(0).alias("match_score"), (c("confidence_score") / 100.0).alias("confidence"), "outcome_reasons")


def match_sentence() -> Column:
    score = c("match_score")
    head = F.when(score >= 75, "Strong match").when(score >= 55, "Good fit").otherwise("Moderate fit")
    parts = listed(F.concat(head, F.lit(" ("), score.cast("string"), F.lit("%)")), F.when(F.size("positives") > 0, F.array_join(F.slice("positives", 1, 2), "; ")), F.when(F.size("tradeoffs") > 0, F.concat(F.lit("tradeoff: "), F.try_element_at("tradeoffs", F.lit(1)))))
    return F.concat(c("name"), F.lit(": "), F.array_join(parts, ", "), F.lit("."))


QUIZ = "is_freshman boolean, prefers_social boolean, prefers_quiet boolean, priority_price int, priority_comfort int, priority_privacy int, priority_location int, wants_ac boolean, bathroom string, near_dining boolean, apartment_style boolean, honors_themed boolean, study_lounges boolean, goal string"


def quiz_profile(quiz: DataFrame) -> DataFrame:
    """Quiz answers (columns of QUIZ) as weights w_<dimension>, a hard freshman requirement and the communal toggle."""
    scaled = lambda name: rounded(c(name) / 2.5)
    pick = lambda flag, yes, no: F.when(flag, yes).otherwise(no)
    weights = {
        "affordability": F.when(c("goal") == "cheapest", 4).otherwise(scaled("priority_price")), "airConditioning": pick(c("wants_ac"), 3, 0), "privacy": scaled("priority_privacy"), "location": scaled("priority_location"),
        "proximityDining": pick(c("near_dining"), 2, 1), "socialAtmosphere": pick(c("prefers_social"), 3, 0), "quietAtmosphere": pick(c("prefers_quiet"), 3, 0), "apartmentStyle": pick(c("apartment_style"), 3, 0),
        "livingLearning": pick(c("honors_themed"), 2, 0), "studyEnvironment": pick(c("study_lounges"), 2, 0), "overallSatisfaction": pick(c("goal") == "best_fit", 2, 1), "bathroomPrivacy": F.lit(2),
        "privateBathroom": pick(c("bathroom") == "private", 3, 0), "suiteBathroom": pick(c("bathroom") == "suite", 3, 0), "communalBathroomOk": pick(c("bathroom") == "communal", 2, 0), "cleanliness": scaled("priority_comfort"), "roomSpaciousness": scaled("priority_comfort"),
    }
    return quiz.withColumns({f"w_{k}": v.cast("double") for k, v in weights.items()} | {"require_freshman": F.when(c("is_freshman"), True), "communal_ok": c("bathroom") == "communal"})


def quiz_profile_route(quiz: DataFrame) -> DataFrame:
    """The other mapping of the same answers: weights unrounded, and AC and bathroom as hard requirements. Its weights for cost and comfort name no dimension, so they have no effect and are left out."""
    pick = lambda flag, yes, no: F.when(flag, yes).otherwise(no)
    weights = {
        "privacy": c("priority_privacy") / 2.5, "location": c("priority_location") / 2.5, "socialAtmosphere": pick(c("prefers_social"), 3, 1), "quietAtmosphere": pick(c("prefers_quiet"), 3, 1), "airConditioning": pick(c("wants_ac"), 3, 0),
        "studyEnvironment": pick(c("study_lounges"), 3, 1), "apartmentIndependence": pick(c("apartment_style"), 3, 0), "livingLearning": pick(c("honors_themed"), 3, 0), "value": pick(c("goal") == "cheapest", 4, 2),
    }
    hard = {"require_freshman": c("is_freshman"), "require_ac": c("wants_ac"), "require_private_bath": c("bathroom") == "private", "require_private_or_suite": c("bathroom") == "suite"}
    return quiz.withColumns({f"w_{k}": v.cast("double") for k, v in weights.items()} | {k: F.when(v, True) for k, v in hard.items()})


def quiz_topk(quizzes: DataFrame, halls: DataFrame, n: int = 10) -> DataFrame:
    """The n best halls of each quiz (id, college_id, answers); costs compare with the average over the given halls of the institution."""
    profile = quiz_profile(quizzes)
    weights = {k[2:]: c(k) for k in profile.columns if k.startswith("w_")}
    average = halls.groupBy("college_id").agg(F.avg("yearly_cost").alias("avg_cost"))
    return match(profile, halls.drop("avg_cost").join(average, "college_id", "left"), weights, toggle=c("communal_ok"), limit=n, outcomes=("eligible",))


def compare_pair(pairs: DataFrame, halls: DataFrame) -> DataFrame:
    """Sentences that compare two halls (a_id, b_id) of a scored table."""
    side = lambda p: halls.select(c("id").alias(f"{p}_id"), *[c(k).alias(f"{p}_{k}") for k in ("name", "social", "yearly_cost", "privacy_score", "overall_score")])
    both = pairs.join(side("a"), "a_id").join(side("b"), "b_id")

    def better(field: str, margin: float, text: str) -> Column:
        a, b = c(f"a_{field}"), c(f"b_{field}")
        return F.when(a > b + margin, F.concat(c("a_name"), F.lit(text))).when(b > a + margin, F.concat(c("b_name"), F.lit(text)))

    cheap = F.when(c("a_yearly_cost") < c("b_yearly_cost") * 0.95, F.concat(c("a_name"), F.lit(" costs less."))).when(c("b_yearly_cost") < c("a_yearly_cost") * 0.95, F.concat(c("b_name"), F.lit(" costs less.")))
    lines = listed(better("social", 1, " is more social."), cheap, better("privacy_score", 10, " offers more privacy."), better("overall_score", 5, " scores higher overall."))
    return both.select("a_id", "b_id", F.when(F.size(lines) == 0, "Both halls are fairly similar.").otherwise(F.array_join(lines, " ")).alias("comparison"))
