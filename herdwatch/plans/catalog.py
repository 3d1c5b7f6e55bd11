"""All registered queries and their SQL checks."""

from __future__ import annotations

from . import (  # noqa: F401
    q_clean,
    q_contracts,
    q_detection,
    q_logs,
    q_models,
    q_more,
    q_quality,
    q_reports,
    q_rollups,
    q_storage,
    q_stored,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
