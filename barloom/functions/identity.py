"""Identities: canonical JSON and truncated hashes."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def identity(value, length: int = 16) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:length]


def row_identity(length: int, **cols: Column) -> Column:
    """The same of a row's columns, whose values are strings or whole numbers."""
    return F.substring(F.sha2(F.to_json(F.struct(*(cols[k].alias(k) for k in sorted(cols)))), 256), 1, length)
