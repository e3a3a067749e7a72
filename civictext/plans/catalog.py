"""All registered queries (importing this module registers them)."""

from __future__ import annotations

from . import job_queries, model_queries, stream_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
