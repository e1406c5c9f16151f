"""All registered queries over the test tables, with their SQL counterparts."""

from __future__ import annotations

from . import q_answers, q_corpus, q_evaluate, q_retrieval  # noqa: F401  registration
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
