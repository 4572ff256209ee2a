"""Named queries over the star-schema tables, each with an independent SQL statement of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from . import answers_set, documents_set, facts_set, forecast_set, lineage_set, records_set

_SETS = (facts_set, forecast_set, lineage_set, documents_set, records_set, answers_set)


def _tuned(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(tune(spark), sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _tuned(run) for s in _SETS for name, (run, _) in s.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for s in _SETS for name, (_, sql) in s.QUERIES.items() if sql}
