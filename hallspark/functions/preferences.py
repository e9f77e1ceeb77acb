"""Preference dimensions: a registry that generates score columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import clamp
from .dimension_texts import TEXTS

VERSION = "1.0.0"
HALL_TYPES = ("RESIDENCE_HALL", "MIXED", "FRESHMAN_ONLY")
#: Columns that a hall may have; those that a table lacks count as unknown.
EVIDENCE = {
    "social": "double", "quiet": "double", "spaciousness": "double", "room_spaciousness": "double", "privacy": "double", "cleanliness": "double", "natural_light": "double", "storage_rating": "double", "community": "double", "walkability": "double",
    "overall_satisfaction": "double", "overall_rating": "double", "overall_score": "double", "bathroom_style": "string", "dorm_type": "string", "private_bath": "boolean", "suite_bath": "boolean", "communal_bath": "boolean", "has_single": "boolean",
    "has_double": "boolean", "has_storage": "boolean", "has_ac": "boolean", "kitchen": "boolean", "laundry": "boolean", "lounge": "boolean", "study_lounges": "boolean", "freshman": "boolean", "upperclass": "boolean", "gender_inclusive": "boolean",
    "substance_free": "boolean", "is_substance_free": "boolean", "accessible": "boolean", "is_accessible": "boolean", "elevator": "boolean", "living_learning": "boolean", "honors": "boolean", "themed": "boolean", "is_renovated": "boolean",
    "renovation_year": "int", "building_age": "int", "building_capacity": "int", "resident_count": "int", "amenity_count": "bigint", "yearly_cost": "double", "avg_cost": "double", "dining_m": "double", "class_m": "double", "academic_m": "double",
    "gym_m": "double", "library_m": "double", "social_m": "double", "parking_m": "double", "room_types": "array<struct<room_type:string,capacity:int>>",
}


@dataclass(frozen=True)
class Dimension:
    id: str
    label: str
    category: str
    weight: int
    score: Callable[[Options], Column]

    @property
    def texts(self) -> tuple[str, str, str]:
        """What a good, a poor and a missing score say; made from the label for dimensions that were registered without texts."""
        return TEXTS[self.id][3:] if self.id in TEXTS else (f"Good match: {self.label}", f"Weak match: {self.label}", f"{self.label} is unknown")

    @property
    def mode(self) -> str:
        return TEXTS[self.id][0] if self.id in TEXTS else "quality"

    @property
    def may_be_required(self) -> bool:
        return self.id in TEXTS and TEXTS[self.id][1]

    @property
    def description(self) -> str:
        return TEXTS[self.id][2] if self.id in TEXTS else self.label


@dataclass(frozen=True)
class Options:
    current_year: int = 2026
    proximity_max: float = 1200.0
    communal_ok: Column | None = None


c = F.col


def bath_class_rank(style: Column) -> Column:
    s = F.trim(F.upper(style))
    return (
        F.when((style == "") | s.isin("UNKNOWN", "UNKNOWN_BATHROOM"), None)
        .when(s.contains("PRIVATE") & ~s.contains("SEMI"), "PRIVATE")
        .when(s.contains("SEMI"), "SEMI_PRIVATE")
        .when(s.contains("SUITE"), "SUITE")
        .when(s.contains("COMMUNAL") | s.contains("COMMUNITY") | s.contains("SHARED"), "COMMUNAL")
        .otherwise(s)
    )


def _bath() -> Column:
    return bath_class_rank(c("bathroom_style"))


def has_private_bath() -> Column:
    return F.coalesce(c("private_bath"), _bath() == "PRIVATE")


def has_suite_bath() -> Column:
    return F.coalesce(c("suite_bath"), _bath().isin("SUITE", "SEMI_PRIVATE"))


def has_communal_bath() -> Column:
    return F.coalesce(c("communal_bath"), _bath() == "COMMUNAL")


def _has_room(flag: str, word: str, capacity: int) -> Column:
    fits = F.exists("room_types", lambda r: F.coalesce(F.lower(r["room_type"]).contains(word), F.lit(False)) | F.coalesce(r["capacity"] == capacity, F.lit(False)))
    return F.coalesce(c(flag), F.when(F.size("room_types") > 0, fits))


def has_single() -> Column:
    return _has_room("has_single", "single", 1)


def accessibility() -> Column:
    return F.coalesce(c("accessible"), c("is_accessible"), c("elevator"))


def substance_free() -> Column:
    return F.coalesce(c("substance_free"), c("is_substance_free"))


def living_learning() -> Column:
    either = F.when(c("honors").isNotNull() | c("themed").isNotNull(), F.coalesce(c("honors"), F.lit(False)) | F.coalesce(c("themed"), F.lit(False)))
    return F.coalesce(c("living_learning"), either)


def rating(x: Column) -> Column:
    return clamp(x / 10.0 * 100.0)


def quality_dim(*fields: str) -> Column:
    x = F.coalesce(*map(c, fields))
    return F.when(x > 10, clamp(x.cast("double"))).otherwise(rating(x))


def boolean_dim(x: Column, yes: float = 100.0, no: float = 0.0) -> Column:
    return F.when(x, yes).when(~x, no)


def communal_ok(has: Column, toggle: Column | None) -> Column:
    plain = boolean_dim(has, 100.0, 40.0)
    return plain if toggle is None else F.when(toggle == False, boolean_dim(has, 20.0, 80.0)).otherwise(plain)  # noqa: E712


def proximity(meters: Column, most: float) -> Column:
    return F.when(meters >= 0, clamp((F.lit(1.0) - meters / most) * 100.0))


def mean_known(*parts: Column) -> Column:
    total, n = F.lit(0.0), F.lit(0)
    for p in parts:
        total, n = total + F.coalesce(p, F.lit(0.0)), n + p.isNotNull().cast("int")
    return F.when(n > 0, total / n)


def location(o: Options) -> Column:
    return mean_known(proximity(c("dining_m"), o.proximity_max), proximity(F.coalesce(c("class_m"), c("academic_m")), o.proximity_max), proximity(c("gym_m"), o.proximity_max))


def affordability(cost: Column, avg: Column) -> Column:
    return F.when(cost.isNotNull(), F.when(avg > 0, clamp(F.lit(100.0) - ((cost / avg - 0.8) / 0.6) * 100.0)).otherwise(clamp(F.lit(100.0) - ((cost - 8000.0) / 14000.0) * 100.0)))


def value_dim() -> Column:
    own = c("overall_rating")
    quality = F.coalesce(rating(c("overall_satisfaction")), rating(F.when(own > 10, own / 10.0).otherwise(own)), c("overall_score"))
    afford = affordability(c("yearly_cost"), c("avg_cost"))
    return F.when(afford.isNull(), quality).when(quality.isNull(), afford).otherwise(clamp(afford * 0.55 + quality * 0.45))


def bathroom_privacy(x: Column, style: Column) -> Column:
    own, bath = rating(x), bath_class_rank(style)
    by_style = F.when(bath == "PRIVATE", 95.0).when(bath == "SEMI_PRIVATE", 80.0).when(bath == "SUITE", 70.0).when(bath == "COMMUNAL", 30.0)
    return F.when(own.isNull(), by_style).when(by_style.isNull(), own).otherwise(clamp(own * 0.5 + by_style * 0.5))


def renovated(o: Options) -> Column:
    age, building = F.lit(o.current_year) - c("renovation_year"), c("building_age")
    by_year = F.when(age <= 5, 95.0).when(age <= 10, 80.0).when(age <= 20, 55.0).when(age.isNotNull(), 30.0)
    return F.coalesce(boolean_dim(c("is_renovated"), 90.0, 35.0), by_year, F.when(building <= 10, 85.0).when(building <= 25, 55.0).when(building.isNotNull(), 30.0))


def size_dim(small: bool) -> Column:
    large = clamp((F.coalesce(c("building_capacity"), c("resident_count")) - 50) / 750.0 * 100.0)
    return F.lit(100.0) - large if small else large


def categorical(kind: Column, preferred: tuple[str, ...]) -> Column:
    k = F.upper(kind)
    hit = F.lit(False)
    for p in preferred:
        hit = hit | k.contains(p)
    return F.when((k != "") & (k != "UNKNOWN"), boolean_dim(hit))


def traditional() -> Column:
    by_type, bath = categorical(c("dorm_type"), HALL_TYPES), _bath()
    score = F.coalesce(by_type, F.lit(50.0))
    return F.when(by_type.isNotNull() | bath.isNotNull(), F.when(bath == "COMMUNAL", clamp(score + 15.0)).otherwise(score))


def study_env() -> Column:
    return mean_known(boolean_dim(c("study_lounges"), 100.0, 20.0), rating(c("quiet")))


def apartment_indep() -> Column:
    k = F.upper("dorm_type")
    by_type = F.when((k != "") & (k != "UNKNOWN"), boolean_dim(k.contains("APARTMENT") | k.contains("TOWNHOUSE"), 100.0, 20.0))
    return mean_known(by_type, boolean_dim(c("kitchen"), 100.0, 30.0))


def overall_satisfaction() -> Column:
    own = c("overall_rating")
    return F.coalesce(rating(c("overall_satisfaction")), F.when(own <= 10, rating(own)).otherwise(own), c("overall_score"))


def spectrum(x: Column, wanted: Column) -> Column:
    """Closeness of a hall's and a user's position; both from 0 to 1, or to 10."""
    unit = lambda v: F.when(v > 1, v / 10.0).otherwise(v)
    return clamp((F.lit(1.0) - F.abs(unit(x) - unit(wanted))) * 100.0)


def _near(*fields: str):
    return lambda o: proximity(F.coalesce(*map(c, fields)), o.proximity_max)


def _yes(make):
    return lambda o: boolean_dim(make())


_registry: dict[str, Dimension] = {}


def register_dimension(id: str, label: str, category: str, weight: int, score: Callable[[Options], Column]) -> None:
    """Add a dimension; match scores contain it from then on."""
    _registry[id] = Dimension(id, label, category, weight, score)


for _args in (
    ("socialAtmosphere", "Social atmosphere", "atmosphere", 2, lambda o: quality_dim("social")),
    ("quietAtmosphere", "Quiet atmosphere", "atmosphere", 2, lambda o: quality_dim("quiet")),
    ("roomSpaciousness", "Room spaciousness", "room", 2, lambda o: F.coalesce(rating(c("spaciousness")), rating(c("room_spaciousness")))),
    ("privacy", "Privacy", "room", 2, lambda o: quality_dim("privacy")),
    ("bathroomPrivacy", "Bathroom privacy", "bathroom", 2, lambda o: bathroom_privacy(c("privacy"), c("bathroom_style"))),
    ("privateBathroom", "Private bathroom", "bathroom", 0, _yes(has_private_bath)),
    ("suiteBathroom", "Suite bathroom", "bathroom", 0, _yes(has_suite_bath)),
    ("communalBathroomOk", "Communal bathroom OK", "bathroom", 0, lambda o: communal_ok(has_communal_bath(), o.communal_ok)),
    ("roomTypeSingle", "Single room", "room", 0, _yes(has_single)),
    ("roomTypeDouble", "Double room", "room", 0, _yes(lambda: _has_room("has_double", "double", 2))),
    ("suiteStyle", "Suite-style living", "building", 0, lambda o: categorical(c("dorm_type"), ("SUITE",))),
    ("apartmentStyle", "Apartment-style living", "building", 0, lambda o: categorical(c("dorm_type"), ("APARTMENT", "TOWNHOUSE"))),
    ("corridorStyle", "Corridor/traditional hall", "building", 0, lambda o: categorical(c("dorm_type"), HALL_TYPES)),
    ("renovatedNewer", "Renovated/newer building", "building", 1, renovated),
    ("cleanliness", "Cleanliness", "amenities", 2, lambda o: quality_dim("cleanliness")),
    ("airConditioning", "Air conditioning", "amenities", 2, _yes(lambda: c("has_ac"))),
    ("naturalLight", "Natural light", "room", 1, lambda o: quality_dim("natural_light")),
    ("storage", "Storage", "room", 1, lambda o: F.coalesce(rating(c("storage_rating")), boolean_dim(c("has_storage"), 75.0, 25.0))),
    ("studyEnvironment", "Study environment", "amenities", 2, lambda o: study_env()),
    ("commonLounges", "Common lounges", "amenities", 1, _yes(lambda: F.coalesce(c("lounge"), c("study_lounges")))),
    ("kitchens", "Kitchen access", "amenities", 1, _yes(lambda: c("kitchen"))),
    ("laundry", "Laundry", "amenities", 2, _yes(lambda: c("laundry"))),
    ("buildingAmenities", "Building amenities", "amenities", 1, lambda o: clamp(c("amenity_count") / 8.0 * 100.0)),
    ("freshmanFriendly", "Freshman-friendly", "eligibility", 0, _yes(lambda: c("freshman"))),
    ("upperclassFriendly", "Upperclass-friendly", "eligibility", 0, _yes(lambda: c("upperclass"))),
    ("communityAtmosphere", "Community atmosphere", "community", 1, lambda o: F.coalesce(rating(c("community")), rating(c("social")))),
    ("livingLearning", "Living-learning/themed", "community", 0, _yes(living_learning)),
    ("genderInclusive", "Gender-inclusive", "community", 0, _yes(lambda: c("gender_inclusive"))),
    ("substanceFree", "Substance-free", "community", 0, _yes(substance_free)),
    ("accessibility", "Accessibility", "building", 0, _yes(accessibility)),
    ("proximityAcademic", "Near classes", "location", 2, _near("class_m", "academic_m")),
    ("proximityDining", "Near dining", "location", 2, _near("dining_m")),
    ("proximityGym", "Near gym", "location", 1, _near("gym_m")),
    ("proximityLibrary", "Near library", "location", 1, _near("library_m")),
    ("proximitySocial", "Near social hubs", "location", 1, _near("social_m")),
    ("proximityParking", "Near parking", "location", 0, _near("parking_m")),
    ("walkability", "Walkability", "location", 1, lambda o: quality_dim("walkability")),
    ("location", "Overall location", "location", 2, location),
    ("affordability", "Affordability", "cost", 2, lambda o: affordability(c("yearly_cost"), c("avg_cost"))),
    ("value", "Value", "cost", 2, lambda o: value_dim()),
    ("buildingSizeSmall", "Smaller building", "building", 0, lambda o: size_dim(True)),
    ("buildingSizeLarge", "Larger building", "building", 0, lambda o: size_dim(False)),
    ("elevator", "Elevator", "building", 0, _yes(lambda: c("elevator"))),
    ("traditionalDormExperience", "Traditional dorm experience", "atmosphere", 0, lambda o: traditional()),
    ("apartmentIndependence", "Apartment independence", "building", 0, lambda o: apartment_indep()),
    ("overallSatisfaction", "Overall satisfaction", "overall", 2, lambda o: overall_satisfaction()),
):
    register_dimension(*_args)


def dimensions(category: str | None = None) -> list[Dimension]:
    return [d for d in _registry.values() if category in (None, d.category)]


def default_weights() -> dict[str, int]:
    return {d.id: d.weight for d in _registry.values()}
