"""All registered queries of the library."""

from . import extracting, importing, joining, maintaining, matching, ranking, reporting, resolving, scalars, streaming  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
