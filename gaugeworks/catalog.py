"""All queries of the library by name, with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import cells, compared, evaluation, evidence, inference, quality, replicated, reports, resampled, shift, slicing, storage, stream, stress

PLANS = (evaluation, inference, resampled, replicated, cells, compared, reports, shift, quality, slicing, stress, evidence, storage, stream)
FLAGSHIP = "slice_metrics"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in PLANS for k, v in p.QUERIES.items()}
SQL: dict[str, str] = {k: v for p in PLANS for k, v in p.SQL.items()}
