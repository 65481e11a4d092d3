"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import alignment, evaluations, features, scalars, shapes, sources  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
