"""Registered queries: importing this package fills ``QUERIES`` and ``ORACLES``."""

from tidemark.plans import corpus, events, extend, ledger, sessions, sources, streams  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
