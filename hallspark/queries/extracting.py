"""Pages to candidates and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators import extraction as x
from ..operators.windows import accept_once
from .base import query

c = F.col


@query()
def page_candidates(v):
    """Every candidate of every page with its verdict."""
    return x.page_candidates(v("pages")).select("page_id", "position", "name", "accepted", "reject_reason", "kind", F.round("score_confidence", 6).alias("confidence"))


@query()
def accepted_candidates(v):
    return accept_once(x.extract(v("pages"))).select("page_id", "position", "name", "accepted")


@query()
def page_roles(v):
    return x.page_roles(x.page_signals(v("pages"), *x.SAYS)).select("page_id", F.array_join("roles", ",").alias("roles"))


@query()
def page_metadata(v):
    return x.page_metadata(x.page_signals(v("pages"), *x.SAYS, "links")).select("page_id", "title", F.size("housing_links").alias("n_links"))


@query()
def detail_links(v):
    return x.detail_links(x.page_signals(v("pages"), "image", "links"))


@query("SELECT page_id, regexp_matches(html, '(?i)__NEXT_DATA__|__NUXT__|ng-version|data-reactroot') AS spa FROM {pages}")
def spa_signals(v):
    return v("pages").select("page_id", x.spa_signals(c("html"), F.lit("x" * 900)).alias("spa"))


@query("SELECT page_id, substr(sha256(html), 1, 32) AS hash FROM {pages}")
def page_hashes(v):
    return v("pages").select("page_id", content_hash(c("html")).alias("hash"))


@query("SELECT id, kind NOT IN ('COMPLEX', 'VILLAGE', 'OTHER') AS assignable, kind IN ('BUILDING', 'HOUSE', 'RESIDENCE', 'UNIT') AS physical, kind NOT IN ('COMPLEX', 'VILLAGE') AS granular FROM {v_dorm}")
def kind_flags(v):
    return v("v_dorm").select("id", *[f.alias(k) for k, f in x.housing_flags(c("kind")).items()])


@query("SELECT id, CASE WHEN regexp_matches(name, '(?i)\\bunit\\s*\\d') THEN 'UNIT' WHEN regexp_matches(name, '(?i)\\bvillage\\b') THEN 'VILLAGE' WHEN regexp_matches(name, '(?i)\\bapartments?\\b') THEN 'APARTMENT_COMMUNITY' WHEN regexp_matches(name, '(?i)\\bhouses?\\b') THEN 'HOUSE' WHEN regexp_matches(name, '(?i)\\bhall\\b') THEN 'BUILDING' END AS kind FROM {v_dorm}")
def entity_kinds(v):
    return v("v_dorm").select("id", x.entity_kind(c("name")).alias("kind"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'no_ac,elevator,laundry' WHEN id % 4 = 1 THEN 'laundry,no_elevator,no_ac' ELSE 'ac,kitchen' END AS amenities, id % 4 > 1 AS ac FROM {v_dorm}")
def merged_amenities(v):
    words = lambda s: F.split(F.lit(s), ",")
    k = c("id") % 4
    card = F.when(k == 0, words("ac,no_elevator")).when(k == 1, words("ac,elevator,laundry")).otherwise(words("ac"))
    detail = F.when(k == 0, words("no_ac,elevator,laundry")).when(k == 1, words("no_elevator,no_ac")).otherwise(words("kitchen"))
    merged = x.merge_amenities(card, detail)
    return v("v_dorm").select("id", F.array_join(merged, ",").alias("amenities"), x.resolve_tri_state(merged, "ac").alias("ac"))


@query("SELECT id, CASE WHEN confidence >= 0.55e0 AND (is_verified OR confidence >= 0.7e0) THEN 'ACTIVE' ELSE 'REVIEW' END AS status FROM {v_dorm}")
def activation(v):
    return x.activate(v("v_dorm").select("id", c("confidence").alias("score_confidence"), c("is_verified").alias("official"))).select("id", "status")


def _housing(name: str) -> str:
    matches = lambda p: f"regexp_matches({name}, '{p.replace(chr(39), chr(39) * 2)}')"
    return f"{matches(x.STRONG_NAME)} AND NOT {matches(x.NEGATIVE_EXACT)} AND NOT {matches(x.NEGATIVE_NAME)} AND length({name}) BETWEEN 3 AND 80"


@query(f"SELECT id, concat_ws(';', CASE WHEN {_housing('name')} THEN name END, CASE WHEN {_housing('category_label')} AND category_label <> name THEN category_label END) AS names FROM {{v_dorm}}")
def embedded_names(v):
    """Names in the data that a page's script embeds: the hall's, twice, its category's and one that is no hall."""
    entry = lambda k: F.concat(F.lit('{"name": "'), k, F.lit('"},'))
    data = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">['), entry(c("name")), entry(c("name")), entry(F.lit("Housing Application")), entry(F.coalesce("category_label", F.lit("Dean"))), F.lit("{}]</script></html>"))
    return v("v_dorm").select("id", F.array_join(x.embedded_names(data), ";").alias("names"))


@query("SELECT d.id, coalesce(d.yearly_cost, f.cost) AS yearly_cost, coalesce(d.has_ac, f.ac) AS has_ac, f.n AS n_reviews FROM {v_dorm} d LEFT JOIN (SELECT dorm_id, max(price) AS cost, bool_or(flag = 'R') AS ac, count(*) AS n FROM {v_review} WHERE status = 'APPROVED' GROUP BY dorm_id) f ON f.dorm_id = d.id")
def detail_merge(v):
    """What cards don't know comes from the facts of their page; a fact that cards have no column for is added."""
    facts = v("v_review").where("status = 'APPROVED'").groupBy(c("dorm_id").alias("page_id")).agg(F.max("price").alias("f_yearly_cost"), F.bool_or(c("flag") == "R").alias("f_has_ac"), F.count("*").alias("f_n_reviews"))
    return x.merge_detail_facts(v("v_dorm").select(c("id").alias("page_id"), "yearly_cost", "has_ac"), facts).withColumnRenamed("page_id", "id")
