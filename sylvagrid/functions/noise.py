"""Reproducible random numbers as column expressions.

Every stream is a function of (seed, row identity), so a recomputed task draws
the same numbers as the lost one and no generator state has to be kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps of the two-dimensional additive recurrence built on the
# plastic number p (p**3 = p + 1): 1/p and 1/p**2.
STEP_U = 0.7548776662466927
STEP_V = 0.5698402909980532


def digest(seed: int, *ids) -> Column:
    """128-bit digest of the seed and the identifying columns."""
    parts = [F.lit(str(seed))] + [F.col(c) if isinstance(c, str) else c for c in ids]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def uniform_from(hashed: Column, word: int = 0) -> Column:
    """Uniform in (0, 1) from the 32-bit word number `word` (0-3) of a digest."""
    hexed = F.substring(hashed, 1 + 8 * word, 8)
    return (F.conv(hexed, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def uniform(seed: int, *ids, word: int = 0) -> Column:
    return uniform_from(digest(seed, *ids), word)


def box_muller(u: Column, v: Column) -> tuple[Column, Column]:
    """Two independent standard normals from two independent uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(u))
    angle = F.lit(2.0 * math.pi) * v
    return radius * F.cos(angle), radius * F.sin(angle)


def normal(seed: int, *ids) -> Column:
    hashed = digest(seed, *ids)
    return box_muller(uniform_from(hashed, 0), uniform_from(hashed, 1))[0]


def rotate(start: Column, draw: Column, step: float) -> Column:
    """Draw number `draw` of the additive recurrence that begins at `start`.

    One digest per row is enough for any number of draws: the draws of a row are
    a randomly shifted lattice (evenly spread, hence a lower variance than
    independent draws), and rows are independent because their shifts are.
    """
    moved = start + draw * F.lit(step)
    return F.greatest(moved - F.floor(moved), F.lit(1e-12))
