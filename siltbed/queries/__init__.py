"""Registered queries, each next to the SQL that must give the same rows."""

from siltbed.queries import ingest, landing, masking_schema, runs, sinks, upkeep  # noqa: F401
from siltbed.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
