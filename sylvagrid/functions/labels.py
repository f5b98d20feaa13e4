"""Display names of climate variables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names.
NAMES = {
    "bio1": "Annual mean temperature",
    "bio5": "Max temperature of warmest month",
    "bio12": "Annual precipitation",
}


def format_variable(name: str) -> Column:
    """`bio12_3yr` to `Annual precipitation (3yr)`; unknown variables are capitalised."""
    parts = F.split(name, "_")
    base, suffix = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
    has_period = (F.size(parts) > 1) & suffix.rlike("yr|month|day|season")
    stem = F.when(has_period, base).otherwise(F.col(name))
    known = F.create_map(*[x for pair in NAMES.items() for x in map(F.lit, pair)])
    spaced = F.regexp_replace(stem, "_", " ")
    plain = F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, 2, 100)))
    period = F.when(has_period, F.concat(F.lit(" ("), suffix, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.coalesce(F.try_element_at(known, base), plain), period)
