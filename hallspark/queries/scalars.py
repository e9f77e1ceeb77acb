"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text, urls
from ..operators.matching import filter_matchable, filter_published
from .base import query

c = F.col


@query("SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CASE WHEN state IN ('CA') THEN 'WEST' WHEN state IN ('NY', 'MA') THEN 'NORTHEAST' WHEN state = 'TX' THEN 'SOUTHWEST' WHEN state = 'FL' THEN 'SOUTHEAST' WHEN state = 'WA' THEN 'NORTHWEST' WHEN state = 'OH' THEN 'MIDWEST' ELSE 'OTHER' END AS region, CASE WHEN id % 3 = 1 THEN 'PUBLIC' ELSE 'PRIVATE' END AS kind FROM {v_college}")
def institution_keys(v):
    return v("v_college").select("id", text.slugify(c("name")).alias("slug"), text.region_for_state(c("state")).alias("region"), text.school_type(c("id") % 3).alias("kind"))


@query("SELECT id, CASE WHEN website_url = '' THEN NULL ELSE website_url END AS a, CASE WHEN id % 2 = 0 THEN concat('https://', slug) ELSE concat('http://', slug) END AS b FROM {v_college}")
def websites(v):
    mixed = F.when(c("id") % 2 == 0, F.concat(F.lit("  "), c("slug"))).otherwise(F.concat(F.lit("http://"), c("slug"), F.lit(" ")))
    return v("v_college").select("id", text.normalize_website(c("website_url")).alias("a"), text.normalize_website(mixed).alias("b"))


@query("SELECT id, array_to_string(list_filter(list_transform(string_split_regex(concat(alias, ' |', city, ',, x'), '[,|]'), lambda p: trim(p)), lambda p: length(p) BETWEEN 1 AND 120), ';') AS aliases FROM {v_college}")
def alias_lists(v):
    return v("v_college").select("id", F.array_join(text.parse_aliases(F.concat("alias", F.lit(" |"), "city", F.lit(",, x"))), ";").alias("aliases"))


@query("SELECT id, CASE lower(replace(dorm_type, '_', ' ')) WHEN 'residence hall' THEN 'residence_hall' WHEN 'suite' THEN 'suite' WHEN 'apartment' THEN 'apartment' WHEN 'townhouse' THEN 'townhouse' ELSE 'unknown' END AS dorm_kind, CASE bathroom_style WHEN 'PRIVATE' THEN 'private' WHEN 'SUITE' THEN 'suite' WHEN 'COMMUNAL' THEN 'communal' WHEN 'SEMI_PRIVATE' THEN 'private' ELSE 'unknown' END AS bath FROM {v_dorm}")
def hall_vocabularies(v):
    bath = F.concat(F.translate("bathroom_style", "_", "-"), F.lit(" bathroom"))
    return v("v_dorm").select("id", text.normalize_dorm_type(F.translate("dorm_type", "_", " ")).alias("dorm_kind"), text.normalize_bathroom_text(bath).alias("bath"))


@query("SELECT dorm_id, k, CASE room_type WHEN 'quad suite' THEN 'quad_suite' ELSE room_type END AS room_type FROM {v_room}")
def room_vocabulary(v):
    return v("v_room").select("dorm_id", "k", text.normalize_room_type(c("room_type")).alias("room_type"))


LOW = "lower(text)"


@query("SELECT id, CASE WHEN lower(text) LIKE '%no ac%' OR lower(text) LIKE '%no air conditioning%' THEN false WHEN lower(text) LIKE '%a/c%' OR lower(text) LIKE '%ac%' OR lower(text) LIKE '%air conditioning%' OR lower(text) LIKE '%air-conditioned%' OR lower(text) LIKE '%central air%' THEN true END AS ac FROM {v_text}")
def ac_from_text(v):
    return v("v_text").select("id", text.normalize_ac(c("text")).alias("ac"))


@query(r"""SELECT id, CASE WHEN amount >= 100 THEN amount END AS amount, CASE WHEN amount < 100 OR amount IS NULL THEN NULL WHEN low LIKE '%per month%' OR low LIKE '%/month%' THEN 'monthly' WHEN low LIKE '%semester%' OR low LIKE '%per term%' THEN 'semester' WHEN low LIKE '%year%' OR low LIKE '%annual%' THEN 'yearly' WHEN low LIKE '%room and board%' OR low LIKE '%room & board%' THEN 'room_board' ELSE 'unknown' END AS period
    FROM (SELECT id, lower(text) AS low, TRY_CAST(replace(regexp_extract(text, '\$?\s*([\d,]+(?:\.\d{2})?)', 1), ',', '') AS DOUBLE) AS amount FROM {v_text}) t""".replace("{2}", "@<2>@"))
def price_mentions(v):
    price = text.parse_price(c("text"))
    return v("v_text").select("id", price["amount"].alias("amount"), price["period"].alias("period"))


def _fact(no: str, yes: str) -> str:
    return f"CASE WHEN regexp_matches(text, '(?i){no}') THEN false WHEN regexp_matches(text, '(?i){yes}') THEN true END"


_plain = [k for k in text.FACTS]


@query("SELECT id, " + ", ".join(f"{_fact(*text.FACTS[k])} AS {k}" for k in _plain).replace("{", "@<").replace("}", ">@") + " FROM {v_text}")
def detail_facts_text(v):
    facts = text.tri_state_facts(c("text"))
    return v("v_text").select("id", *[facts[k].alias(k) for k in _plain])


@query(r"""SELECT id, TRY_CAST(nullif(regexp_extract(text, '(?i)\b(\d\d?)\s*(?:floors?|stories)\b', 1), '') AS INTEGER) AS floors, TRY_CAST(nullif(regexp_extract(text, '(?i)\b(?:built|constructed)\s+(?:in\s+)?((?:19|20)\d\d)\b', 1), '') AS INTEGER) AS constructed_year,
    TRY_CAST(nullif(regexp_extract(text, '(?i)\brenovat(?:ed|ion)\s+(?:in\s+)?((?:19|20)\d\d)\b', 1), '') AS INTEGER) AS renovation_year, CASE id % 6 WHEN 4 THEN 'single,suite' WHEN 5 THEN 'double' ELSE '' END AS room_types, CASE WHEN id % 6 = 0 THEN 8450.5e0 END AS semester_cost, CASE WHEN id % 6 = 0 THEN 17000e0 END AS yearly_cost FROM {v_text}""")
def detail_numbers_text(v):
    facts = text.detail_facts(c("text"))
    return v("v_text").select("id", *[facts[k].alias(k) for k in ("floors", "constructed_year", "renovation_year", "yearly_cost", "semester_cost")], F.array_join(facts["room_types"], ",").alias("room_types"))


@query("""SELECT id, concat_ws(',', CASE WHEN ac THEN 'ac' END, CASE WHEN NOT ac OR id % 6 = 1 THEN 'no_ac' END, CASE WHEN id % 6 = 3 THEN 'no_elevator' END, CASE WHEN id % 6 = 3 THEN 'kitchen' END, CASE WHEN id % 6 = 2 THEN 'laundry' END, CASE WHEN id % 6 = 2 THEN 'study_lounge' END) AS amenities
    FROM (SELECT id, CASE WHEN lower(text) LIKE '%no ac%' OR lower(text) LIKE '%no air conditioning%' THEN false WHEN lower(text) LIKE '%ac%' OR lower(text) LIKE '%a/c%' OR lower(text) LIKE '%air conditioning%' THEN true END AS ac FROM {v_text}) t""")
def amenities_text(v):
    return v("v_text").select("id", F.array_join(text.amenities_from_text(c("text")), ",").alias("amenities"))


@query("SELECT id, CASE id % 6 WHEN 0 THEN '8450.5:semester;17000.0:yearly' ELSE '' END AS costs FROM {v_text}")
def cost_mentions(v):
    costs = text.costs_from_text(c("text"))
    return v("v_text").select("id", F.array_join(F.transform(costs, lambda p: F.concat_ws(":", p["amount"].cast("string"), p["period"])), ";").alias("costs"))


@query(r"""SELECT id, CASE WHEN scheme = '' THEN trim(lower(url)) ELSE concat(lower(scheme), '://', lower(host), CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END, CASE WHEN q = '' THEN '' ELSE concat('?', q) END) END AS canonical FROM (
    SELECT id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
    array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_source|utm_medium|utm_campaign|fbclid|gclid|ref|source|campaign)(=|$)')), '&') AS q FROM {v_source}) t""")
def canonical_urls(v):
    return v("v_source").select("id", urls.canonical_url(c("url")).alias("canonical"))


HOST = r"regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\.', '')"


@query(f"SELECT id, {HOST} AS domain, CASE WHEN len(string_split({HOST}, '.')) <= 2 THEN {HOST} ELSE array_to_string(string_split({HOST}, '.')[-2:], '.') END AS registrable, {HOST} = 'example.com' OR {HOST} LIKE '%.example.com' AS official FROM {{v_source}}")
def official_domain(v):
    return v("v_source").select("id", urls.domain(c("url")).alias("domain"), urls.registrable_domain(c("url")).alias("registrable"), urls.is_official(c("url"), F.lit("www.example.com")).alias("official"))


@query("SELECT id, CASE page_role WHEN 'detail' THEN 0 WHEN 'directory' THEN 1 WHEN 'rates' THEN 2 ELSE 4 END AS role_rank, CASE page_role WHEN 'detail' THEN 'Official detail page' WHEN 'directory' THEN 'Official housing directory' WHEN 'rates' THEN 'Housing rates / costs' ELSE 'Housing page' END AS role_label FROM {v_source}")
def source_roles(v):
    return v("v_source").select("id", urls.role_rank(c("page_role")).alias("role_rank"), urls.role_label(c("page_role")).alias("role_label"))


@query("SELECT id, CAST(count(*) AS BIGINT) AS n_urls, min(url) AS first_url FROM (SELECT DISTINCT id, url FROM (SELECT id, housing_url AS url FROM {v_college} WHERE housing_url <> '' UNION ALL SELECT id, concat('https://', s, '.example.edu/') FROM {v_college}, (VALUES ('housing'), ('www.housing'), ('reslife'), ('residentiallife'), ('residence')) x(s) WHERE website_url <> '' UNION ALL SELECT id, concat(regexp_replace(website_url, '/$', ''), p) FROM {v_college}, (VALUES ('/housing'), ('/housing/'), ('/residence-life'), ('/residence-life/'), ('/residential-life'), ('/residential-life/'), ('/student-life/housing'), ('/campus-life/housing'), ('/living'), ('/living/'), ('/reslife'), ('/residences'), ('/explore-housing-options/residence-halls/'), ('/housing/residence-halls/'), ('/housing/residences/')) y(p) WHERE website_url <> '') u) d GROUP BY id")
def guessed_urls(v):
    guessed = v("v_college").select("id", F.explode(urls.guess_housing_urls(c("website_url"), c("housing_url"))).alias("url"))
    return guessed.groupBy("id").agg(F.count("*").alias("n_urls"), F.min("url").alias("first_url"))


@query("SELECT id, concat(name, ' ', q) AS query FROM {v_college}, (VALUES ('housing'), ('residence halls'), ('dorms'), ('housing rates'), ('residence life'), ('room and board'), ('housing PDF'), ('campus housing map')) t(q)")
def housing_queries(v):
    return v("v_college").select("id", F.explode(urls.housing_queries(c("name"))).alias("query"))


@query("SELECT id, CASE WHEN regexp_matches(url, '(?i)housing\\.|reslife\\.|residentiallife\\.') THEN 50 ELSE 0 END + CASE WHEN regexp_matches(url, '(?i)residence-halls|housing-options|residences|explore-housing') THEN 40 ELSE 0 END + CASE WHEN regexp_matches(url, '(?i)rates|room-type|floor-plan|amenities') THEN 15 ELSE 0 END - CASE WHEN regexp_matches(url, '(?i)apply|login|portal|news|event') THEN 20 ELSE 0 END AS priority FROM {v_source}")
def url_priorities(v):
    return v("v_source").select("id", urls.url_priority(c("url"), F.lit("")).alias("priority"))


@query("SELECT id, substr(sha256(text), 1, 32) AS hash FROM {v_text}")
def content_hashes(v):
    return v("v_text").select("id", text.content_hash(c("text")).alias("hash"))


@query("SELECT id, greatest(0.2e0, least(1e0, CASE page_role WHEN 'rates' THEN 0.9e0 WHEN 'detail' THEN 0.95e0 ELSE 0.5e0 END - CASE WHEN age_days * 2 > 730 THEN 0.15e0 ELSE 0e0 END - CASE WHEN age_days * 2 > 1095 THEN 0.1e0 ELSE 0e0 END)) AS confidence, least(1e0, CASE WHEN is_approved THEN 0.85e0 ELSE 0.5e0 END + (id % 5) * 0.05e0) * (CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END) AS field FROM {v_source}")
def confidences(v):
    kind = F.when(c("page_role") == "rates", "HOUSING_RATES").when(c("page_role") == "detail", "OFFICIAL_WEBSITE").otherwise("OTHER")
    return v("v_source").select("id", text.source_confidence(kind, c("age_days") * 2).alias("confidence"), text.field_confidence(c("id") % 5, c("is_approved")).alias("field"))


@query("SELECT id, (CASE WHEN has_ac IS NULL THEN 0 ELSE 1 END + CASE WHEN yearly_cost IS NULL THEN 0 ELSE 1 END + CASE WHEN description IS NULL THEN 0 ELSE 1 END) / 3e0 AS completeness, CASE WHEN has_ac THEN 'Yes' WHEN NOT has_ac THEN 'No' ELSE 'Unknown' END AS ac_label, CASE WHEN yearly_cost IS NULL THEN 'Unknown' ELSE concat('$', format('{:,}', CAST(round_even(yearly_cost, 0) AS BIGINT))) END AS cost_label FROM {v_dorm}".replace("{:,}", "@<:,>@"))
def fact_labels(v):
    return v("v_dorm").select("id", text.completeness(c("has_ac"), c("yearly_cost"), c("description")).alias("completeness"), text.fact_label(c("has_ac")).alias("ac_label"), text.money_label(c("yearly_cost")).alias("cost_label"))


NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), '\b(the|residence|hall|dormitory|dorm|building|community)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query("SELECT id, " + NORM.replace("{x}", "name") + " AS norm, regexp_extract(name, 'unit ([0-9]+)', 1) AS numbers FROM {v_dorm}")
def entity_names(v):
    normal = names.entity_norm(c("name"))
    return v("v_dorm").select("id", normal.alias("norm"), names.number_sig(normal).alias("numbers"))


@query("SELECT id FROM {v_dorm} WHERE assignable IS DISTINCT FROM false AND granular IS DISTINCT FROM false")
def matchable_halls(v):
    return filter_matchable(v("v_dorm")).select("id")


@query("SELECT id FROM {v_dorm} WHERE is_active AND assignable AND granular AND status <> 'QUARANTINED'")
def published_halls(v):
    return filter_published(v("v_dorm")).select("id")
