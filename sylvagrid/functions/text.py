"""Small column helpers for result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(col: str | Column, digits: int, name: str | None = None) -> Column:
    """Rounded column, named like its input column unless `name` is given."""
    if isinstance(col, str):
        return F.round(F.col(col), digits).alias(name or col)
    rounded = F.round(col, digits)
    return rounded.alias(name) if name else rounded
