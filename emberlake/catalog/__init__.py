"""Registered queries over the star-schema tables, with an independent SQL text where one exists."""

from emberlake.catalog import (  # noqa: F401  (imported for their registrations)
    cleaning,
    combining,
    logs,
    profiles,
    questions,
    reports,
    retrieval,
    shaping,
    storage,
    streams,
)
from emberlake.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
