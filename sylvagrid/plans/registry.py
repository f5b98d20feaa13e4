"""Registry of the runnable queries and of the SQL that checks them.

A query is a function of `Views` (the input tables and the layers derived from
them). Its check is one SQL text; the derived layers it names are prepended as
common table expressions, so the text runs on the raw tables alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sylvagrid.plans.views import VIEW_SQL, Views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        if key in _QUERIES:
            raise ValueError(f"query {key} registered twice")
        _QUERIES[key] = fn
        if sql is not None:
            _CHECKS[key] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Prepend the derived layers that the text names, inner ones first."""
    body = sql.strip()
    used = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", body)]
    grown = True
    while grown:
        grown = False
        for outer in list(used):
            for v in VIEW_SQL:
                if v not in used and re.search(rf"\b{v}\b", VIEW_SQL[outer]):
                    used.append(v)
                    grown = True
    ctes = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in VIEW_SQL if v in used)
    if not ctes:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{ctes}, {body[len(start):]}"
    return f"WITH {ctes} {body}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Views(spark, sf_dir))

    return {key: bind(fn) for key, fn in _QUERIES.items()}


def checks() -> dict[str, str]:
    return dict(_CHECKS)


def uniform_sql(seed: int, ids: str, word: int = 0) -> str:
    """SQL text of functions.noise.uniform."""
    return (
        f"((CAST('0x' || substr(md5(concat_ws('|', '{seed}', {ids})), {1 + 8 * word}, 8) AS BIGINT) + 5e-1)"
        " / 4294967296e0)"
    )


def normal_sql(seed: int, ids: str) -> str:
    """SQL text of functions.noise.normal."""
    u, v = uniform_sql(seed, ids, 0), uniform_sql(seed, ids, 1)
    return f"(sqrt(-2e0 * ln({u})) * cos(2e0 * pi() * {v}))"
