"""All queries over the engine's own operators, with their SQL for DuckDB."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}

from braidwork.catalog import texts  # noqa: E402,F401
from braidwork.catalog import ranks  # noqa: E402,F401
from braidwork.catalog import matches  # noqa: E402,F401
from braidwork.catalog import periods  # noqa: E402,F401
