"""Text normalisers of hall and institution fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import clamp, collapse, first_contained, listed, lookup

# The vocabularies below must equal those of the source data.
DORM_TYPES = {"residence hall": "residence_hall", "res hall": "residence_hall", "dormitory": "residence_hall", "dorm": "residence_hall", "suite": "suite", "apartment": "apartment", "townhouse": "townhouse"}
BATHROOMS = [("community bathroom", "communal"), ("shared bathroom", "communal"), ("communal bathroom", "communal"), ("communal", "communal"), ("suite bathroom", "suite"), ("suite-style", "suite"), ("private bathroom", "private"), ("in-room bathroom", "private")]
AC_TERMS = ("a/c", "ac", "air conditioning", "air-conditioned", "central air")
ROOM_TYPES = {"single room": "single", "single": "single", "1-person room": "single", "double room": "double", "traditional double": "double", "2-person room": "double", "triple": "triple", "quad": "quad"}
REGION_OF_STATE = {
    "CT": "NORTHEAST",
    "ME": "NORTHEAST",
    "MA": "NORTHEAST",
    "NH": "NORTHEAST",
    "NJ": "NORTHEAST",
    "NY": "NORTHEAST",
    "PA": "NORTHEAST",
    "RI": "NORTHEAST",
    "VT": "NORTHEAST",
    "DE": "NORTHEAST",
    "MD": "NORTHEAST",
    "DC": "NORTHEAST",
    "AL": "SOUTHEAST",
    "AR": "SOUTHEAST",
    "FL": "SOUTHEAST",
    "GA": "SOUTHEAST",
    "KY": "SOUTHEAST",
    "LA": "SOUTHEAST",
    "MS": "SOUTHEAST",
    "NC": "SOUTHEAST",
    "SC": "SOUTHEAST",
    "TN": "SOUTHEAST",
    "VA": "SOUTHEAST",
    "WV": "SOUTHEAST",
    "IL": "MIDWEST",
    "IN": "MIDWEST",
    "IA": "MIDWEST",
    "KS": "MIDWEST",
    "MI": "MIDWEST",
    "MN": "MIDWEST",
    "MO": "MIDWEST",
    "NE": "MIDWEST",
    "ND": "MIDWEST",
    "OH": "MIDWEST",
    "SD": "MIDWEST",
    "WI": "MIDWEST",
    "AZ": "SOUTHWEST",
    "NM": "SOUTHWEST",
    "OK": "SOUTHWEST",
    "TX": "SOUTHWEST",
    "CA": "WEST",
    "HI": "WEST",
    "NV": "WEST",
    "UT": "WEST",
    "CO": "WEST",
    "AK": "NORTHWEST",
    "ID": "NORTHWEST",
    "MT": "NORTHWEST",
    "OR": "NORTHWEST",
    "WA": "NORTHWEST",
    "WY": "NORTHWEST",
}
SOURCE_CONFIDENCE = {"OFFICIAL_WEBSITE": 0.95, "OFFICIAL_PDF": 0.92, "HOUSING_RATES": 0.9, "CAMPUS_MAP": 0.75, "RESIDENCE_LIFE": 0.88, "PUBLIC_REVIEW": 0.45, "STUDENT_FORUM": 0.35, "OTHER": 0.5}


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def school_type(c: Column) -> Column:
    return F.when(c == 1, "PUBLIC").otherwise("PRIVATE")


def region_for_state(c: Column) -> Column:
    regions = F.create_map(*[F.lit(x) for entry in REGION_OF_STATE.items() for x in entry])
    return F.coalesce(F.try_element_at(regions, F.upper(c)), F.lit("OTHER"))


def normalize_website(c: Column) -> Column:
    bare = F.trim(c)
    return F.when(bare == "", None).when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def parse_aliases(c: Column) -> Column:
    parts = F.transform(F.split(c, r"[,|]"), lambda p: F.trim(p))
    return F.coalesce(F.filter(parts, lambda p: F.length(p).between(1, 120)), F.array().cast("array<string>"))


def as_number(c: Column) -> Column:
    value = F.trim(c).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def enrollment(c: Column) -> Column:
    return as_number(c).try_cast("int")


def normalize_dorm_type(c: Column) -> Column:
    return F.when(c.isNotNull(), lookup(F.trim(F.lower(c)), DORM_TYPES, F.lit("unknown")))


def normalize_bathroom_text(c: Column) -> Column:
    return first_contained(F.lower(c), BATHROOMS, "unknown")


def normalize_ac(c: Column, strict: bool = False) -> Column:
    """Air conditioning said by a text: true, false or unknown. The terms match within words, as in the source data; ``strict`` asks for whole words."""
    low = F.lower(c)
    if strict:
        return F.when(low.rlike(r"\bno (ac|a/c|air conditioning)\b"), False).when(low.rlike(r"\b(a/c|ac|air conditioning|air-conditioned|central air)\b"), True)
    hit = F.lit(False)
    for term in AC_TERMS:
        hit = hit | low.contains(term)
    return F.when(low.contains("no ac") | low.contains("no air conditioning"), False).when(hit, True)


def normalize_room_type(c: Column) -> Column:
    key = F.trim(F.lower(c))
    return F.when(c.isNotNull(), lookup(key, ROOM_TYPES, F.regexp_replace(key, r"\s+", "_")))


def parse_price(c: Column) -> Column:
    """The first amount of a text with its period, or null below 100."""
    low = F.lower(c)
    amount = F.regexp_replace(F.regexp_extract(c, r"\$?\s*([\d,]+(?:\.\d{2})?)", 1), ",", "").try_cast("double")
    period = F.when(low.contains("per month") | low.contains("/month"), "monthly").when(low.contains("semester") | low.contains("per term"), "semester").when(low.contains("year") | low.contains("annual"), "yearly").when(low.contains("room and board") | low.contains("room & board"), "room_board").otherwise("unknown")
    return F.when(amount >= 100, F.struct(amount.alias("amount"), period.alias("period"), (period == "unknown").alias("uncertain")))


def costs_from_text(c: Column, n: int = 3, width: int = 40) -> Column:
    found = F.slice(F.regexp_extract_all(c, F.lit(r"(\$[\d,]+(?:\.\d{2})?[^.]{0,%d})" % width), F.lit(1)), 1, n)
    return F.filter(F.transform(found, parse_price), lambda p: p.isNotNull())


def amenities_from_text(c: Column) -> Column:
    ac = normalize_ac(c)
    no_ac = (ac == False) | c.rlike(r"(?i)no\s+(?:in[- ]?unit\s+)?(?:air conditioning|a/?c)\b")  # noqa: E712

    def flag(no: str, yes: str, name: str) -> Column:
        return F.when(c.rlike(no), f"no_{name}").when(c.rlike(yes), name)

    return listed(F.when(ac == True, "ac"), F.when(no_ac, "no_ac"), flag(r"(?i)\bno elevator\b", r"(?i)\belevator\b", "elevator"), flag(r"(?i)\bno (?:in[- ]?unit )?kitchen\b", "(?i)kitchen", "kitchen"), flag(r"(?i)\bno laundry\b", "(?i)laundry", "laundry"), F.when(c.rlike("(?i)study lounge"), "study_lounge"))  # noqa: E712


#: Fixed values: (negative, positive) patterns of the facts a detail page states; the negative wins.
FACTS = {
    "elevator_access": (r"\bno elevators?\b", r"\belevators?\b"),
    "kitchen_access": (r"\bno (?:in[- ]unit )?kitchens?\b", r"\b(?:full |in[- ]unit )?kitchens?\b"),
    "laundry_access": (r"\bno laundry\b", r"\blaundry\b"),
    "freshman_eligible": (r"\b(?:not|no)\s+(?:available|open)\s+(?:to\s+)?(?:first[- ]year|freshman)", r"\b(?:first[- ]year|freshman)\s+(?:students?\s+)?(?:eligible|welcome|priority|housing)\b"),
    "upperclass_eligible": (r"\b(?:first[- ]year|freshman)\s+only\b", r"\b(?:upper[- ]?class|continuing|sophomore|junior|senior)\s+(?:students?\s+)?(?:eligible|welcome|housing)\b"),
    "graduate_eligible": (r"\bundergraduate\s+only\b", r"\bgraduate\s+(?:students?\s+)?(?:eligible|housing|apartments?)\b"),
    "meal_plan_required": (r"\bmeal plan(?:s)?\s+(?:optional|not required)\b", r"\bmeal plan(?:s)?\s+(?:required|mandatory)\b"),
    "wheelchair_accessible": (r"\bnot\s+wheelchair\s+accessible\b", r"\bwheelchair\s+access|\bADA\s+access|\baccessible\s+(?:rooms?|units?|housing)\b"),
    "gender_inclusive": (r"\bgender[- ]specific\s+only\b", r"\bgender[- ]inclusive\b|\ball[- ]gender\b"),
}
ROOM_WORDS = {"single": r"\bsingle\s+rooms?\b", "double": r"\bdouble\s+rooms?\b", "triple": r"\btriple\s+rooms?\b", "quad": r"\bquad\s+rooms?\b", "suite": r"\bsuites?\b", "apartment": r"\bapartments?\b"}
ADDRESS = r"\b\d{1,5}\s+[A-Z][A-Za-z0-9 .'#-]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Way|Lane|Ln)\b"


def tri_state_facts(c: Column) -> dict[str, Column]:
    return {"has_ac": normalize_ac(c)} | {name: F.when(c.rlike("(?i)" + no), False).when(c.rlike("(?i)" + yes), True) for name, (no, yes) in FACTS.items()}


def detail_facts(c: Column) -> dict[str, Column]:
    """Floors, years, room types, costs and address; of several costs with one period the last counts."""
    some = lambda x: F.when(x != "", x)
    costs = costs_from_text(c, 5, 50)
    costs_of = lambda period: F.when(F.exists(costs, lambda p: p["period"] == period), F.try_element_at(F.filter(costs, lambda p: p["period"] == period), F.lit(-1))["amount"])
    return {
        "floors": some(F.regexp_extract(c, r"(?i)\b(\d{1,2})\s*(?:floors?|stories)\b", 1)).cast("int"),
        "constructed_year": some(F.regexp_extract(c, r"(?i)\b(?:built|constructed)\s+(?:in\s+)?((?:19|20)\d{2})\b", 1)).cast("int"),
        "renovation_year": some(F.regexp_extract(c, r"(?i)\brenovat(?:ed|ion)\s+(?:in\s+)?((?:19|20)\d{2})\b", 1)).cast("int"),
        "room_types": listed(*[F.when(c.rlike("(?i)" + p), name) for name, p in ROOM_WORDS.items()]),
        "yearly_cost": costs_of("yearly"),
        "semester_cost": costs_of("semester"),
        "address": some(F.regexp_extract(c, ADDRESS, 0)),
    }


def bathroom_from_text(c: Column, fixed: bool = False) -> Column:
    """The lower-case word, as in the source data; ``fixed`` gives the enum, with a looser pattern where no word hits."""
    word = normalize_bathroom_text(c)
    if not fixed:
        return word
    return F.when(word != "unknown", F.upper(word)).when(c.rlike(r"(?i)\bprivate bath"), "PRIVATE").when(c.rlike(r"(?i)\bsuite bath"), "SUITE").when(c.rlike(r"(?i)\bcommunal bath|community bath|shared bath"), "COMMUNAL")


def content_hash(c: Column, n: int = 32) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def normalize_query(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(c), r"[^\w\s&'-]", " "))


def source_confidence(kind: Column, age_days: Column) -> Column:
    base = F.lit(0.5)
    for name, value in SOURCE_CONFIDENCE.items():
        base = F.when(kind == name, value).otherwise(base)
    late = F.when(age_days > 730, 0.15).otherwise(0.0)
    later = F.when(age_days > 1095, 0.1).otherwise(0.0)
    return clamp(base - late - later, 0.2, 1.0)


def field_confidence(n_sources: Column, official: Column) -> Column:
    base = F.when(official, 0.85).otherwise(0.5)
    return F.when(n_sources == 0, 0.0).otherwise(F.least(F.lit(1.0), base + n_sources * 0.05))


def completeness(*columns: Column) -> Column:
    filled = F.lit(0)
    for c in columns:
        filled = filled + F.when(c.isNotNull() & (c.cast("string") != ""), 1).otherwise(0)
    return filled / F.lit(float(max(1, len(columns))))


def fact_label(c: Column) -> Column:
    return F.when(c, "Yes").when(~c, "No").otherwise("Unknown")


def money_label(c: Column) -> Column:
    return F.when(c.isNull(), "Unknown").otherwise(F.concat(F.lit("$"), F.format_number(c, 0)))
