"""All registered queries and their SQL."""

from __future__ import annotations

from . import q_account, q_features, q_metrics, q_more, q_search, q_tape  # noqa: F401
from .q_tape import flagship
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
