"""Names every query of the library, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitwise.plans import evaluation, learning, matching, paths, performance, point_in_time, projections, records, research, rounding_off, simulation, store_flows, stores, streams, vectors

_PLANS = (point_in_time, performance, evaluation, matching, projections, simulation, records, streams, learning, rounding_off, store_flows, vectors, paths, research, stores)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for plan in _PLANS for name, (run, _) in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, (_, sql) in plan.QUERIES.items() if sql}
