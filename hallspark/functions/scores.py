"""Quality scores of halls: seven components, none of them invented where evidence is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clamp, listed, rounded

VERSION = "2.0.0"
LEAST_KNOWN = 3
WEIGHTS = {"value": 0.18, "comfort": 0.18, "privacy": 0.14, "social": 0.12, "convenience": 0.12, "freshman": 0.14, "amenity": 0.12}


def bath_class_score(c: Column) -> Column:
    s = F.trim(F.upper(c))
    return F.when((c == "") | (s == "UNKNOWN"), None).when(s.contains("PRIVATE") & ~s.contains("SEMI"), "PRIVATE").when(s.contains("SUITE"), "SUITE").when(s.contains("COMMUNAL") | s.contains("COMMUNITY"), "COMMUNAL").otherwise(s)


def value_score(cost: Column, avg: Column) -> Column:
    relative = clamp(F.lit(100.0) - ((cost - avg * 0.8) / avg) * 80.0)
    absolute = clamp(F.lit(100.0) - ((cost - 8000.0) / 14000.0) * 100.0)
    return F.when(cost.isNotNull(), F.when(avg > 0, relative).otherwise(absolute))


def _mean(*parts: Column) -> Column:
    total, n = F.lit(0.0), F.lit(0)
    for p in parts:
        total, n = total + F.coalesce(p, F.lit(0.0)), n + p.isNotNull().cast("int")
    return F.when(n > 0, total / n)


def comfort_score(ac: Column, bath: Column) -> Column:
    return _mean(F.when(ac, 85.0).when(~ac, 40.0), F.when(bath == "PRIVATE", 95.0).when(bath == "SUITE", 75.0).when(bath == "COMMUNAL", 45.0))


def privacy_score(rating: Column, bath: Column) -> Column:
    return F.coalesce(clamp(rating * 10.0), F.when(bath == "PRIVATE", 90.0).when(bath == "SUITE", 65.0).when(bath == "COMMUNAL", 35.0))


def social_score(social: Column, quiet: Column) -> Column:
    base = clamp(social * 10.0)
    return F.when(base.isNotNull() & (quiet > 7), clamp(base + 10.0)).otherwise(base)


def convenience_score(meters: Column) -> Column:
    return F.when(meters < 300, 85.0).when(meters < 600, 75.0).when(meters < 1000, 55.0).when(meters.isNotNull(), 35.0)


def freshman_fit(c: Column) -> Column:
    return F.when(c, 85.0).when(~c, 45.0)


def amenity_score(n: Column) -> Column:
    return clamp(n / 8.0 * 100.0)


def data_confidence(confidence: Column, completeness: Column) -> Column:
    percent = lambda c: rounded(F.when(c <= 1, c * 100.0).otherwise(c))
    return F.coalesce(percent(confidence), percent(completeness))


def with_scores(halls: DataFrame) -> DataFrame:
    """``halls`` (yearly_cost, avg_cost, has_ac, bathroom_style, privacy, social, quiet, dining_m, freshman, amenity_count, confidence, completeness) with score columns: one per component (rounded), overall_score, scoreable, score_completeness, data_confidence."""
    c = F.col
    bath = bath_class_score(c("bathroom_style"))
    raw = {
        "value": value_score(c("yearly_cost"), c("avg_cost")),
        "comfort": comfort_score(c("has_ac"), bath),
        "privacy": privacy_score(c("privacy"), bath),
        "social": social_score(c("social"), c("quiet")),
        "convenience": convenience_score(c("dining_m")),
        "freshman": freshman_fit(c("freshman")),
        "amenity": amenity_score(c("amenity_count")),
    }
    out = halls.withColumns({f"raw_{k}": v for k, v in raw.items()})
    total, weight, known = F.lit(0.0), F.lit(0.0), F.lit(0)
    for k, w in WEIGHTS.items():
        r = c(f"raw_{k}")
        total = total + F.coalesce(r * w, F.lit(0.0))
        weight = weight + F.when(r.isNotNull(), w).otherwise(0.0)
        known = known + r.isNotNull().cast("int")
    out = out.withColumns({"__t": total, "__w": weight, "__k": known})
    scoreable = c("__k") >= LEAST_KNOWN
    out = out.withColumns({"scoreable": scoreable, "overall_score": F.when(scoreable, rounded(clamp(c("__t") / c("__w")))), "score_completeness": c("__k") / 7.0, "data_confidence": data_confidence(c("confidence"), c("completeness"))})
    return out.withColumns({f"{k}_score": rounded(c(f"raw_{k}")) for k in raw}).drop("__t", "__w", "__k")


def explain_score() -> Column:
    """Lines that explain a row of :func:`with_scores`."""
    c = F.col
    value = c("value_score")
    lines = listed(
        F.when(value >= 70, "Strong value relative to typical costs at this school.").when(value < 45, "Higher cost than many peers."),
        F.when(c("comfort_score") >= 75, "Comfort features boost this score."),
        F.when(c("privacy_score") >= 70, "Better privacy."),
        F.when(c("social_score") >= 75, "Known as a social hall."),
        F.when(c("freshman_score") >= 80, "Especially suitable for first-year students."),
        F.when(c("data_confidence") < 60, "Some data is uncertain."),
        F.when(c("score_completeness") < 0.5, "Limited data available."),
    )
    return F.when(~c("scoreable"), F.array(F.lit("Not enough data to compute a quality score yet."))).otherwise(lines)


def badges() -> Column:
    c = F.col
    conf = F.coalesce(c("confidence"), F.lit(0.0))
    return listed(
        F.when(c("has_ac"), "Has AC"),
        F.when(c("freshman"), "Freshman Friendly"),
        F.when((c("dorm_type") == "SUITE") | (c("bathroom_style") == "SUITE"), "Suite Style"),
        F.when(c("dorm_type") == "APARTMENT", "Apartment Style"),
        F.when(c("honors"), "Honors Housing"),
        F.when(c("social") >= 7, "Social Dorm"),
        F.when(c("quiet") >= 7, "Quiet Dorm"),
        F.when((c("yearly_cost") != 0) & (c("avg_cost") != 0) & (c("yearly_cost") < c("avg_cost") * 0.95), "Best Value"),
        F.when(F.coalesce(c("dining_m"), F.lit(9999.0)) < 400, "Close to Dining"),
        F.when(conf >= 0.85, "High Confidence Data").when(conf < 0.6, "Needs Verification"),
        F.when(~F.coalesce(c("is_verified"), F.lit(False)) & (F.coalesce(c("confidence"), F.lit(1.0)) < 0.7), "Needs Verification"),
    )


def hall_summary() -> Column:
    c = F.col
    lines = listed(
        F.when(c("has_ac") & (c("bathroom_style") == "SUITE") & (F.coalesce(c("yearly_cost"), F.lit(0.0)) > F.coalesce(c("avg_cost"), F.lit(15000.0))), "Likely comfortable (AC and suite bathrooms) but on the expensive side."),
        F.when(c("freshman") & (c("bathroom_style") == "COMMUNAL"), "May be more social with communal bathrooms."),
        F.when((c("dorm_type") == "APARTMENT") & c("kitchen") & c("upperclass"), "Fits students who want independence."),
        F.when(c("honors"), "Honors or themed community."),
        F.when(c("social") >= 8, "Often described as lively and social."),
        F.when(c("quiet") >= 8, "Tends to be quieter."),
        F.when(~F.coalesce(c("has_ac"), F.lit(False)), "May not have air conditioning."),
    )
    return F.when(F.size(lines) == 0, "A solid on-campus option.").otherwise(F.array_join(lines, " "))
