"""Composed jobs and the registry of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.session import tune


def _tuned(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(tune(spark), folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All named queries: name -> callable(spark, folder) -> DataFrame."""
    from shelfwise.plans import registry_models, registry_sales, registry_storage, registry_streams, registry_texts

    registries = (registry_sales, registry_models, registry_texts, registry_streams, registry_storage)
    return {name: _tuned(query) for registry in registries for name, query in registry.queries().items()}
