"""Collects the registered queries of the engine."""

from __future__ import annotations

from tidelog.plans import storage, surface, versioned
from tidelog.plans.base import ORACLES, QUERIES

MODULES = (versioned, surface, storage)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
