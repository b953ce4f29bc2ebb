"""Arrow helpers for the text operators: one Python call per batch, results built column by column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """Apply ``function`` to every Arrow batch; it may yield any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def batch(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def flag(spark: SparkSession, name: str, default: str) -> str:
    """A parameter that a job may set in the session's configuration."""
    return spark.conf.get(f"docloom.{name}", None) or default
