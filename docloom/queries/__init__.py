"""Queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    from docloom.queries import corpus, evaluation, integrity, joins, parts, scalars, storage, windows

    return {name: f for m in (scalars, corpus, windows, evaluation, joins, parts, storage, integrity) for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from docloom.queries import corpus, evaluation, integrity, joins, parts, scalars, storage, windows

    return {name: sql for m in (scalars, corpus, windows, evaluation, joins, parts, storage, integrity) for name, sql in m.ORACLES.items()}
