"""Registered queries: each operator on the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from checks.registry import ORACLE, QUERIES
from checks import (  # noqa: F401
    dispatch, facts, features, landed, models, profiles, reports, rollups, shapes)

__all__ = ["ORACLE", "QUERIES"]
