"""Small helpers around ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernel import chunks


def text_groups(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts together stay within a kernel chunk."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        at = 0
        for group in chunks(t or "" for t in texts):
            yield batch.slice(at, len(group)), group
            at += len(group)


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array of consecutive slices of bytes."""
    at = pa.py_buffer(np.ascontiguousarray(bounds, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(data))])


def need_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def bounded(df: DataFrame, most: int) -> list:
    """All rows of a table that is small by definition; one over the bound is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has more than {most} rows")
    return rows


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
