"""Domain tables derived from the driver's tables, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def _tri(key: str, m: int) -> str:
    return f"CASE WHEN {key} % {m} = 0 THEN NULL WHEN {key} % 2 = 0 THEN true ELSE false END"


def _rating(c: int) -> str:
    return f"CASE WHEN u % 4 = 1 THEN NULL ELSE CAST((u * {c}) % 11 AS DOUBLE) END"


def _meters(c: int) -> str:
    return f"CASE WHEN u % 6 = 2 THEN NULL ELSE CAST((id * {c}) % 1500 AS DOUBLE) END"


STATES = "CASE s_suppkey % 8 WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' WHEN 2 THEN 'TX' WHEN 3 THEN 'MA' WHEN 4 THEN 'FL' WHEN 5 THEN 'WA' WHEN 6 THEN 'OH' ELSE 'PR' END"
COVERAGE = "CASE s_suppkey % 10 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'SITE_FOUND' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'COMPLETE' WHEN 4 THEN 'BLOCKED' WHEN 5 THEN 'RETRYABLE' WHEN 6 THEN 'NO_HOUSING' WHEN 7 THEN 'COMPLETE' WHEN 8 THEN 'PARTIAL' ELSE 'DIRECTORY_PENDING' END"

VIEWS: dict[str, str] = {
    "v_college": f"""
        SELECT s_suppkey AS id, concat(CASE s_suppkey % 3 WHEN 0 THEN 'University of ' WHEN 1 THEN 'College ' ELSE 'Institute ' END, s_name) AS name,
            concat('college-', CAST(s_suppkey AS VARCHAR(9))) AS slug, CASE WHEN s_suppkey % 4 = 0 THEN concat('C', CAST(s_suppkey AS VARCHAR(9))) END AS short_name,
            concat('A', CAST(s_suppkey % 50 AS VARCHAR(9))) AS alias, n_name AS city, {STATES} AS state, CASE s_suppkey % 3 WHEN 0 THEN 'PUBLIC' ELSE 'PRIVATE' END AS school_type,
            CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 100000 + s_suppkey END AS ipeds_id, {COVERAGE} AS coverage_status,
            CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST((s_suppkey * 1371) % 40000 AS INTEGER) END AS population,
            CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('https://www.c', CAST(s_suppkey AS VARCHAR(9)), '.example.edu/') END AS website_url,
            CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('https://housing.c', CAST(s_suppkey AS VARCHAR(9)), '.example.edu/') END AS housing_url,
            CASE WHEN s_suppkey % 6 = 1 THEN NULL WHEN s_suppkey % 6 = 2 THEN false ELSE true END AS has_housing,
            CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 30e0 + s_suppkey % 20 END AS latitude, CASE WHEN s_suppkey % 6 = 3 THEN NULL ELSE -70e0 - s_suppkey % 50 END AS longitude,
            CASE WHEN s_suppkey % 4 = 2 THEN NULL ELSE s_suppkey % 200 END AS inventory_days
        FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    "v_dorm_base": """
        SELECT p_partkey AS id, p_partkey % ns AS college_id, 13 * CAST(floor(p_partkey / ns) AS BIGINT) + 7 * (p_partkey % ns) AS u, ns, p_name, p_brand, p_type, p_size, p_retailprice
        FROM {part} CROSS JOIN (SELECT count(*) AS ns FROM {supplier}) n""",
    "v_dorm": f"""
        SELECT id, college_id, concat(p_name, CASE p_size % 6 WHEN 0 THEN ' hall' WHEN 1 THEN ' house' WHEN 2 THEN ' village' WHEN 3 THEN ' residence hall' WHEN 4 THEN ' apartments' ELSE concat(' unit ', CAST(p_size % 4 + 1 AS VARCHAR(9))) END) AS name,
            concat('hall-', CAST(id AS VARCHAR(9))) AS slug,
            {_tri('u', 3)} AS has_ac, {_tri('u', 5)} AS elevator, {_tri('u', 7)} AS kitchen, {_tri('u', 11)} AS laundry, {_tri('u', 17)} AS lounge,
            {_tri('p_size', 3)} AS freshman, {_tri('p_size', 5)} AS upperclass, {_tri('p_size', 7)} AS gender_inclusive, {_tri('p_size', 11)} AS substance_free, {_tri('id', 13)} AS honors,
            CASE u % 5 WHEN 0 THEN 'PRIVATE' WHEN 1 THEN 'SUITE' WHEN 2 THEN 'COMMUNAL' WHEN 3 THEN 'SEMI_PRIVATE' ELSE 'UNKNOWN' END AS bathroom_style,
            CASE p_type WHEN 'ECONOMY' THEN 'RESIDENCE_HALL' WHEN 'SMALL' THEN 'SUITE' WHEN 'MEDIUM' THEN 'MIXED' WHEN 'PROMO' THEN 'APARTMENT' WHEN 'STANDARD' THEN 'FRESHMAN_ONLY' ELSE 'TOWNHOUSE' END AS dorm_type,
            CASE WHEN u % 7 = 3 THEN NULL ELSE p_retailprice * 10 END AS yearly_cost,
            {_rating(3)} AS social, {_rating(5)} AS quiet, {_rating(7)} AS privacy, {_rating(9)} AS cleanliness,
            {_meters(37)} AS dining_m, {_meters(53)} AS gym_m, {_meters(71)} AS class_m,
            CAST(id % 101 AS DOUBLE) / 100e0 AS confidence, CAST(p_size % 11 AS DOUBLE) / 10e0 AS completeness, id % 1000 AS age_days,
            CASE WHEN p_size % 9 = 0 THEN id - ns ELSE NULL END AS parent_id,
            CASE u % 19 WHEN 0 THEN 'QUARANTINED' WHEN 1 THEN 'REVIEW' WHEN 2 THEN 'DUPLICATE' ELSE 'ACTIVE' END AS status,
            u % 23 <> 0 AS is_active, CASE WHEN u % 29 = 0 THEN NULL WHEN u % 29 = 1 THEN false ELSE true END AS assignable, CASE WHEN u % 31 = 0 THEN false ELSE true END AS granular,
            u % 37 = 0 AS is_verified,
            CASE p_size % 6 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'HOUSE' WHEN 2 THEN 'VILLAGE' WHEN 3 THEN 'RESIDENCE' WHEN 4 THEN 'APARTMENT_COMMUNITY' ELSE 'UNIT' END AS kind,
            CASE WHEN u % 3 = 0 THEN concat('This hall is part of ', p_name, ' village') WHEN u % 3 = 1 THEN 'Near Unit 1 and the library' ELSE NULL END AS description,
            CASE WHEN u % 8 = 0 THEN concat(p_name, ' village') ELSE NULL END AS category_label
        FROM {{v_dorm_base}}""",
    "v_room": """
        SELECT id AS dorm_id, k, CASE (u + k) % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'triple' ELSE 'quad suite' END AS room_type, CAST((u + k) % 4 + 1 AS INTEGER) AS capacity
        FROM {v_dorm_base} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) r WHERE k < p_size % 4""",
    "v_amenity": "SELECT DISTINCT l_partkey AS dorm_id, concat('amenity ', CAST(l_linenumber AS VARCHAR(9))) AS amenity FROM {lineitem}",
    "v_amenity_count": "SELECT dorm_id, CAST(count(*) AS BIGINT) AS amenity_count FROM {v_amenity} GROUP BY dorm_id",
    "v_cost_avg": "SELECT college_id, floor(avg(yearly_cost) * 100 + 0.5e0) / 100e0 AS avg_cost FROM {v_dorm} GROUP BY college_id",
    "v_hall": """
        SELECT d.*, amenity_count, avg_cost FROM {v_dorm} d LEFT JOIN {v_amenity_count} a ON d.id = a.dorm_id LEFT JOIN {v_cost_avg} c ON d.college_id = c.college_id""",
    "v_evidence": """
        SELECT h.*, CASE WHEN id % 3 <> 0 THEN 2026 - age_days % 40 END AS renovation_year, CASE WHEN id % 4 <> 0 THEN age_days % 60 END AS building_age, CASE age_days % 5 WHEN 0 THEN true WHEN 1 THEN false END AS is_renovated,
            CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN confidence * 100e0 ELSE confidence * 10e0 END AS overall_rating, CASE WHEN id % 7 > 3 THEN cleanliness END AS overall_satisfaction, CASE WHEN id % 2 = 0 THEN cleanliness END AS spaciousness, privacy AS room_spaciousness,
            CASE WHEN id % 3 = 1 THEN social END AS storage_rating, elevator AS has_storage, lounge AS study_lounges, CASE WHEN id % 2 = 1 THEN quiet END AS community, CASE WHEN id % 3 = 0 THEN age_days END AS building_capacity, CASE WHEN id % 4 <> 0 THEN age_days * 2 END AS resident_count
        FROM {v_hall} h""",
    "v_review": """
        SELECT l_partkey AS dorm_id, l_orderkey AS user_id, l_linenumber AS n, CAST(l_quantity AS INTEGER) % 5 + 1 AS rating, l_shipdate AS created_at,
            CASE l_linestatus WHEN 'O' THEN 'APPROVED' ELSE 'PENDING' END AS status, l_extendedprice AS price, l_tax AS tax, l_suppkey AS s, l_discount AS disc, l_returnflag AS flag
        FROM {lineitem}""",
    "v_dorm_source": "SELECT DISTINCT l_partkey AS dorm_id, l_suppkey AS source_id FROM {lineitem}",
    "v_source": """
        SELECT page_id AS id, page_id % (SELECT count(*) FROM {supplier}) AS college_id, url, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Page ', CAST(page_id AS VARCHAR(9))) END AS title,
            CASE page_id % 5 WHEN 0 THEN 'housing_directory' WHEN 1 THEN 'detail' WHEN 2 THEN 'rates' WHEN 3 THEN NULL ELSE 'directory' END AS page_role, page_id % 3 <> 0 AS is_approved, page_id % 900 AS age_days
        FROM {pages}""",
    "v_provenance": """
        SELECT l_partkey AS dorm_id, CASE l_linenumber % 4 WHEN 0 THEN 'hasAC' WHEN 1 THEN 'yearlyCost' WHEN 2 THEN 'bathroomStyle' ELSE 'laundry' END AS field, l_returnflag AS value, l_suppkey AS source_id,
            l_shipdate AS ts, 1e0 - l_discount AS confidence, l_orderkey AS k, l_linenumber AS n, l_extendedprice AS price, l_quantity AS qty, l_tax AS tax, l_linestatus AS ls
        FROM {lineitem}""",
    "v_profile": """
        SELECT c_custkey AS id, c_custkey % ns AS college_id, CAST(c_custkey % 5 AS DOUBLE) AS w_social, CAST(c_custkey % 4 AS DOUBLE) AS w_quiet, CAST(c_custkey % 3 AS DOUBLE) AS w_affordability,
            CAST((c_custkey + 1) % 4 AS DOUBLE) AS w_ac, CAST((c_custkey + 2) % 5 AS DOUBLE) AS w_bath, CAST((c_custkey + 1) % 3 AS DOUBLE) AS w_dining, CAST(c_custkey % 2 AS DOUBLE) AS w_amenities, CAST((c_custkey * 7) % 5 AS DOUBLE) AS w_laundry,
            CASE WHEN c_custkey % 3 = 0 THEN true END AS require_freshman, CASE WHEN c_custkey % 5 = 0 THEN true END AS require_ac, CASE WHEN c_custkey % 7 = 0 THEN true END AS require_private_or_suite,
            CASE WHEN c_custkey % 4 = 0 THEN 9500e0 + c_custkey % 3000 END AS max_budget, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS communal_ok
        FROM {customer} CROSS JOIN (SELECT count(*) AS ns FROM {supplier}) n""",
    "v_job": "SELECT o_orderkey AS id, o_custkey AS college_id, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS status, o_orderdate AS created_at FROM {orders}",
    "v_log": "SELECT event_id AS id, user_id AS job_id, event_type AS level, ts, value FROM {events}",
    "v_text": """
        SELECT doc_id AS id, concat(text, CASE doc_id % 6 WHEN 0 THEN ' Rates: $8,450.50 per semester. Room and board $17,000 per year' WHEN 1 THEN ' No air conditioning here. Built in 1964, renovated 2011, 6 floors' WHEN 2 THEN ' Air conditioning, laundry and study lounge. Wheelchair accessible rooms' WHEN 3 THEN ' No elevator. Full kitchens. Freshman housing. $99 deposit and $640 /month' WHEN 4 THEN ' Single rooms and suites, private bathroom, gender-inclusive' ELSE ' Double rooms. Meal plan required. Located at 123 Oak Street' END) AS text
        FROM {documents}""",
    "v_checkpoint": """
        SELECT s_suppkey AS college_id, CASE s_suppkey % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RETRYABLE' WHEN 2 THEN 'COMPLETED' WHEN 3 THEN 'RUNNING' WHEN 4 THEN 'BLOCKED' ELSE 'PARTIAL' END AS status,
            s_suppkey % 60 - 30 AS locked_minutes_ago, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 50 - 25 END AS retry_due_minutes, s_suppkey % 4 AS retry_count, s_suppkey % 12 AS candidate_urls,
            CASE s_suppkey % 3 WHEN 0 THEN '{"directoryExhausted":true}' WHEN 1 THEN '{"coverageDecision":"PARTIAL"}' ELSE NULL END AS metadata
        FROM {supplier}""",
}


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view over driver tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    given = {n: view(spark, sf_dir, n) for n in _needs(sql) if n in VIEWS or n in TABLES}
    return spark.sql(sql.replace('{"', '{{"').replace('"}', '"}}').replace(":true}", ":true}}"), **given)


def oracle(sql: str) -> str:
    """The DuckDB text of a query over views: names in braces become tables and the views their CTEs."""
    ctes: dict[str, str] = {}

    def add(text: str) -> str:
        for n in _needs(text):
            if n in VIEWS and n not in ctes:
                body = add(VIEWS[n])
                ctes[n] = body
        return re.sub(r"\{(\w+)\}", lambda m: m[1], text)

    body = add(sql)
    return ("WITH " + ",\n".join(f"{n} AS ({t})" for n, t in ctes.items()) + "\n" if ctes else "") + body
