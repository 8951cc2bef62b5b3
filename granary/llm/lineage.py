"""Where intermediate tables go, so that a lost executor costs no recomputation and no lineage grows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.shared import dropped, shared_folder, stored, stored_alone


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column of df begins with: names that begin so, and no column's, may stand beside its own."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


__all__ = ["dropped", "free_prefix", "shared_folder", "stored", "stored_alone"]
