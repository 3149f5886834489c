"""All registered queries of the recommendation operators with the SQL that defines their results."""

from __future__ import annotations

from feedloom.plans import analysis, checks, daily, encoders, evaluation, extensions, features, guards, preprocessing, ranking, retrieval, samples, tools, towers, whole  # noqa: F401  (they register their queries)
from feedloom.plans.common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
