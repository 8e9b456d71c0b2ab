"""Columns that go through a batch function beside its results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def carry(keep: list[str] | None) -> list[Column]:
    """The kept columns as one column, so that their names clash with nothing."""
    return [F.struct(*keep).alias("kept")] if keep else []


def carried(batch: pa.RecordBatch) -> list[pa.Array]:
    return [batch.column("kept")] if "kept" in batch.schema.names else []


def with_kept(rows: DataFrame, function, schema: str, keep: list[str] | None) -> DataFrame:
    """``rows`` through ``function``; a kept column replaces a result column of its name."""
    if not keep:
        return rows.mapInArrow(function, schema)
    types = StructType([*StructType.fromDDL(schema), StructField("kept", rows.schema["kept"].dataType)])
    done = rows.mapInArrow(function, types)
    return done.select(*(c for c in done.columns if c != "kept" and c not in keep), *(F.col("kept")[c].alias(c) for c in keep))
