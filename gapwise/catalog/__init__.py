"""The driver's query catalogue: one entry per operator, with SQL for DuckDB."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

from . import cleaning, files, spatial, survey, tables  # noqa: E402, F401
