"""All named queries of the engine, and SQL that says the same."""

from __future__ import annotations

from . import code_queries, data_queries, eval_queries, process_queries, record_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
