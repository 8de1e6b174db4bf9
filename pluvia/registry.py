"""All registered queries of the library, and SQL for the same rows."""

from __future__ import annotations

from .plans import checks, descriptive, features, filters, joins, linking, models, scans, series, streams, verification  # noqa: F401
from .plans.base import ON_DOMAIN, ORACLES, QUERIES

__all__ = ["ON_DOMAIN", "ORACLES", "QUERIES"]
