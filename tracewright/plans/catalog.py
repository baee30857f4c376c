"""All queries of the reference operators, by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("log_queries", "text_queries", "session_queries", "document_queries", "structure_queries", "stream_queries", "source_queries", "scalar_queries", "api_queries")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"tracewright.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
