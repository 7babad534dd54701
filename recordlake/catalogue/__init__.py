"""Registered queries, each next to the SQL that states its expected result."""

from . import details, events, frontier, pages, records, replies, sinks  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
