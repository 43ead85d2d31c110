"""All registered queries."""

from tabloom.plans import (  # noqa: F401
    queries_cleaning, queries_features, queries_profile, queries_relations, queries_sentiment,
)
from tabloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
