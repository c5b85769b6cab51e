"""Registry of named queries: Spark builders and their oracle SQL.

Each entry pairs a Spark builder ``(spark, sf_dir) -> DataFrame`` with the
same question written in DuckDB SQL over the same parquet tables.  Builders
return lazy DataFrames; the final projection goes through ``present`` so
both engines report dates/times as ISO text and money as double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.exprs import present

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a query builder (and its oracle SQL, if any)."""
    def deco(fn: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def queries() -> dict[str, Builder]:
    from . import registry  # noqa: F401  (populates the registry)
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import registry  # noqa: F401
    return dict(_ORACLE)
