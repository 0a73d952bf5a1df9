"""Canonical JSON and ids derived from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with keys in sorted order."""
    return F.to_json(
        F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"}
    )


def stable_id(prefix: str, fields: dict[str, Column]) -> Column:
    """``prefix`` and the first 24 hex digits of the content's SHA-256."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(canonical_json(fields), 256), 1, 24))
