"""Every registered query of the stream operators with its DuckDB equivalent."""

from __future__ import annotations

from . import queries_functions, queries_timeline

QUERIES = queries_timeline.QUERIES | queries_functions.QUERIES
ORACLES = queries_timeline.ORACLES | queries_functions.ORACLES
