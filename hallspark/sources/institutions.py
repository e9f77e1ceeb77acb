"""Institution catalogs from CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_number, enrollment, normalize_website, parse_aliases, region_for_state, school_type, slugify

#: Column names that mean a field, in order of preference.
NAMES = {"ipeds_id": ("UNITID",), "name": ("INSTNM",), "city": ("CITY",), "state": ("STABBR",), "website": ("INSTURL", "WEBADDR"), "population": ("UGDS", "ENRTOT"), "control": ("CONTROL",), "latitude": ("LATITUDE",), "longitude": ("LONGITUDE", "LONGITUD"), "aliases": ("ALIAS", "INSTALIAS", "IALIAS"), "operating": ("CURROPER", "CYACTIVE")}
JSON_NAMES = {"ipeds_id": "id", "name": "school.name", "city": "school.city", "state": "school.state", "website": "school.school_url", "population": "latest.student.size", "control": "school.ownership", "latitude": "location.lat", "longitude": "location.lon", "aliases": "school.alias", "operating": "school.operating"}


def _known(x: Column) -> Column:
    return F.when(~F.trim(x).isin("", "NULL", "PrivacySuppressed"), F.trim(x))


def _typed(rows: DataFrame) -> DataFrame:
    c = F.col
    out = rows.select(
        enrollment(c("ipeds_id")).cast("long").alias("ipeds_id"), "name", slugify(c("name")).alias("slug"), "city", F.upper("state").alias("state"), region_for_state(F.upper("state")).alias("region"), normalize_website(c("website")).alias("website_url"),
        enrollment(c("population")).alias("population"), school_type(as_number(c("control"))).alias("school_type"), as_number(c("latitude")).alias("latitude"), as_number(c("longitude")).alias("longitude"), parse_aliases(c("aliases")).alias("aliases"), enrollment(c("operating")).alias("operating"),
    )
    return out.where("name IS NOT NULL AND state IS NOT NULL")


def read_institutions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Institutions of a CSV file; header names in any case, alternatives per field."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    by_name = {k.strip().upper(): k for k in raw.columns}
    pick = lambda names: F.coalesce(*[_known(F.col(f"`{by_name[n]}`")) for n in names if n in by_name], F.lit(None).cast("string"))
    return _typed(raw.select(*[pick(names).alias(field) for field, names in NAMES.items()]))


def read_institutions_json(spark: SparkSession, path: str) -> DataFrame:
    """Institutions of stored API pages: a list of results with dotted keys."""
    raw = spark.read.json(path, multiLine=True).select(F.explode("results").alias("r"))
    fields = set(raw.schema["r"].dataType.fieldNames())
    pick = lambda key: _known(F.col("r").getField(key).cast("string")) if key in fields else F.lit(None).cast("string")
    return _typed(raw.select(*[pick(key).alias(field) for field, key in JSON_NAMES.items()]))
