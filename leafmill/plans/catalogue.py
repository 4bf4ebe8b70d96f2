"""All queries of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, files, labels, lifecycle, service, stores, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**documents.QUERIES, **lifecycle.QUERIES, **labels.QUERIES, **streams.QUERIES, **stores.QUERIES, **service.QUERIES, **files.QUERIES}
ORACLES: dict[str, str] = {**documents.ORACLES, **lifecycle.ORACLES, **labels.ORACLES, **streams.ORACLES, **stores.ORACLES, **service.ORACLES, **files.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review outcome of each document."""
    return QUERIES["document_review_routing"](spark, sf_dir)
