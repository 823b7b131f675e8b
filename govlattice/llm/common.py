"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlattice.session import ensure_checkpoint_dir, spread

# White space of the word definitions: U+0020 and U+0009 to U+000D.
BLANK = r"\x20\x09-\x0D"


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table, over all cores if it has fewer partitions than cores."""
    return spread(spark.read.parquet(f"{base}/{name}.parquet"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does the same to plain ASCII and is much faster; the letter table
    is only walked for texts with other characters.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new folder that every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast ``df`` only if it is seen to have at most ``most`` (narrow) rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def whole(df: DataFrame) -> Column:
    """All columns as one struct, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def per_process(key: str, make: Callable[[], object]) -> object:
    """A value made once per Python process and kept for its later tasks.

    Functions are sent to tasks by value, globals included, so a table that is
    costly to fill would otherwise start empty in every task.
    """
    held = sys.modules.setdefault("_govlattice_per_process", ModuleType("_govlattice_per_process")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def utf8_parts(column: pa.Array) -> Iterator[bytes]:
    """The values as bytes, null as empty, one at a time and without a copy of the whole column."""
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in raw:
        yield value.as_py() or b""


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        lengths = np.asarray(
            pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        )
        group = np.cumsum(lengths) // most
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)


def list_of(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from concatenated values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
