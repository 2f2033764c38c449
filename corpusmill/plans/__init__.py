"""Registered queries and their reference SQL."""

import importlib

from corpusmill.plans.catalog import OPERATORS, ORACLES, QUERIES

_MODULE_OF: dict[str, str] = {}
for _m in ("views", "text_queries", "retrieval_queries", "ingest_queries", "chunk_queries", "evaluation_queries",
           "usage_queries", "source_queries", "stream_queries"):
    _before = set(QUERIES)
    importlib.import_module(f"corpusmill.plans.{_m}")
    _MODULE_OF.update({k: _m for k in QUERIES if k not in _before})


def module_of(name: str) -> str:
    return _MODULE_OF[name]


__all__ = ["OPERATORS", "ORACLES", "QUERIES", "module_of"]
