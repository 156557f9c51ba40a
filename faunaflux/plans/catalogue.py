"""The query catalogue: each query over the driver's tables, and its SQL for the other engine.

Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views_sql: str = "") -> Callable[[Query], Query]:
    """Registers a query; sql follows the given views as common table expressions."""

    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: views.rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = (f"WITH {views_sql}\n" if views_sql and not sql.lstrip().startswith(",") else f"WITH {views_sql}" if views_sql else "") + sql
        return f

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import catalogue_data, catalogue_models, catalogue_results  # noqa: F401

    return QUERIES, ORACLES
