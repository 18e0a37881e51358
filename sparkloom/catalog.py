"""The queries and their SQL."""

from __future__ import annotations

from .plans import archives, attention, evaluation, retrieval

QUERIES: dict = retrieval.QUERIES | attention.QUERIES | evaluation.QUERIES | archives.QUERIES
ORACLES: dict[str, str] = retrieval.ORACLES | attention.ORACLES | evaluation.ORACLES | archives.ORACLES
