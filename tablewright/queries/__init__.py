"""Queries over the sample tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from tablewright.queries import features, metrics, models, preparation, profiles, sources
from tablewright.queries.base import Query

ALL: dict[str, Query] = {}
for module in (features, sources, profiles, preparation, metrics, models):
    ALL.update(module.QUERIES)
