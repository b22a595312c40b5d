"""Names for helper columns that no given column has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores put after it until no column of ``df`` is called so; case doesn't count, as in Spark."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
