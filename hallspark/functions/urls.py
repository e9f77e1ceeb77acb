"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that don't tell pages apart.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "msclkid", "mc_eid", "mc_cid", "_ga", "_gl", "ref", "source", "campaign", "yclid", "dclid", "gbraid", "wbraid", "twclid", "li_fat_id", "igshid", "ttclid", "rdt_cid", "scclid")
CRAWL_TRACKING = r"^(utm_|fbclid|gclid|mc_)"
ROLE_RANK = {"detail": 0, "directory": 1, "rates": 2, "eligibility": 3}
ROLE_LABEL = {"detail": "Official detail page", "directory": "Official housing directory", "rates": "Housing rates / costs", "eligibility": "Eligibility information"}
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _canonical(c: Column, tracked) -> Column:
    part = lambda k: F.regexp_extract(c, PARTS, k)
    host = F.regexp_replace(F.lower(part(2)), "^(.*):(?:80|443)$", "$1")
    path = F.when(part(3) == "", "/").when((F.length(part(3)) > 1) & part(3).endswith("/"), F.regexp_replace(part(3), "/+$", "")).otherwise(part(3))
    kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~tracked(F.lower(F.substring_index(p, "=", 1))))
    query = F.array_join(kept, "&")
    built = F.concat(F.lower(part(1)), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(c.rlike(PARTS) & (part(2) != ""), built).otherwise(F.trim(F.lower(c)))


def canonical_url(c: Column) -> Column:
    """Host in lower case, no fragment, no tracking parameters, no slash at the end of a path; what is no URL only in lower case."""
    return _canonical(c, lambda key: key.isin(*TRACKING))


def canonical_url_crawl(c: Column) -> Column:
    return _canonical(c, lambda key: key.rlike(CRAWL_TRACKING))


def canonicalize_or_empty(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "").otherwise(canonical_url(F.trim(c)))


def resolved_url(raw: Column, final: Column, canonical: Column) -> Column:
    return F.when((final != "") & (final != raw), final).when((canonical != "") & (canonical != raw), canonical).otherwise(raw)


def role_rank(c: Column) -> Column:
    out = F.lit(4)
    for role, rank in ROLE_RANK.items():
        out = F.when(c == role, rank).otherwise(out)
    return out


def role_label(c: Column) -> Column:
    out = F.lit("Housing page")
    for role, label in ROLE_LABEL.items():
        out = F.when(c == role, label).otherwise(out)
    return out


def domain(c: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def registrable_domain(c: Column) -> Column:
    parts = F.split(domain(c), r"\.")
    return F.when(F.size(parts) <= 2, domain(c)).otherwise(F.array_join(F.slice(parts, -2, 2), "."))


def is_official(url: Column, college_domain: Column) -> Column:
    host, official = domain(url), F.regexp_replace(college_domain, r"^www\.", "")
    root = F.substring_index(official, ".", -2)
    within = lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d))
    return F.coalesce((host != "") & (within(official) | ((root != "") & within(root))), F.lit(False))


def path_slug(c: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(c, PARTS, 3), "/+$", "")
    return F.when(path != "", F.substring_index(path, "/", -1))


def title_from_slug(c: Column) -> Column:
    return F.initcap(F.regexp_replace(path_slug(c), "[-_]+", " "))


def url_priority(url: Column, housing_url: Column) -> Column:
    def points(pattern: str, n: int) -> Column:
        return F.when(url.rlike("(?i)" + pattern), n).otherwise(0)

    own = F.when((housing_url != "") & (url == housing_url), 100).otherwise(0)
    return own + points(r"housing\.|reslife\.|residentiallife\.", 50) + points("residence-halls|housing-options|residences|explore-housing", 40) + points("rates|room-type|floor-plan|amenities", 15) + points("apply|login|portal|news|event", -20)


PATHS = ("/housing", "/housing/", "/residence-life", "/residence-life/", "/residential-life", "/residential-life/", "/student-life/housing", "/campus-life/housing", "/living", "/living/", "/reslife", "/residences", "/explore-housing-options/residence-halls/", "/housing/residence-halls/", "/housing/residences/")
SUBDOMAINS = ("housing", "www.housing", "reslife", "residentiallife", "residence")
QUERIES = ("housing", "residence halls", "dorms", "housing rates", "residence life", "room and board", "housing PDF", "campus housing map")


def guess_housing_urls(website: Column, housing_url: Column) -> Column:
    root = registrable_domain(website)
    own = F.array(F.when(housing_url != "", housing_url))
    subs = F.array(*[F.when(root != "", F.concat(F.lit(f"https://{s}."), root, F.lit("/"))) for s in SUBDOMAINS])
    base = F.regexp_replace(website, "/$", "")
    paths = F.array(*[F.when(website != "", F.concat(base, F.lit(p))) for p in PATHS])
    return F.array_distinct(F.array_compact(F.concat(own, subs, paths)))


def housing_queries(name: Column) -> Column:
    return F.array(*[F.concat(name, F.lit(f" {q}")) for q in QUERIES])
