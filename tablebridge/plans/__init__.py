"""Registered queries with their SQL."""

from . import catalogs, changes, checks, exports, jobs, loads, outcomes, relations, scans, stores  # noqa: F401  they register themselves
from .registry import QUERIES, SQL  # noqa: F401
