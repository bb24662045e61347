"""Names for columns that an operator needs for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with as many _ before it as make it no column of the frames (Spark's names have no case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
