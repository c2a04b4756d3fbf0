"""Queries over the tables, and flows of several operators."""

from . import contracts, events, flows, history, lookups, records, reports, samples, scoring, streams, training, toolcalls, trees  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
