"""Feature tables, screening and batch scoring as Spark jobs."""

from tablewright.plans.compile import build_wide_table
from tablewright.plans.spec import FeaturePlan, FeatureSpec, MainSpec, Relationship
from tablewright.session import build_session

__all__ = [
    "FeaturePlan",
    "FeatureSpec",
    "MainSpec",
    "Relationship",
    "build_session",
    "build_wide_table",
]
