"""What the corpus operators share: tables, Arrow helpers and shared-folder checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.loops import forget, scratch, written as saved

__all__ = ["arrow_map", "field_type", "forget", "met", "pieces", "replaced", "saved", "scratch", "table", "texts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None where null."""
    return column.cast(pa.binary()).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes at most (or one row)."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        total, first, start = 0, 0, 0
        if batch.column(column).nbytes <= most:
            yield batch
            continue
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            total += n or 0
            if total > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, n or 0
        yield batch.slice(start, batch.num_rows - start)


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType, by: str | None = None) -> DataFrame:
    """df.mapInArrow of a function of one batch; ``by`` names a text column that bounds the batches' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, by) if by else batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    i = batch.schema.get_field_index(name)
    arrays = [values if k == i else batch.column(k) for k in range(batch.num_columns)]
    return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)


_HOT, _FEW = 2000, 100


def met(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """left joined with right, one row a key with ``n``: how many of left's ``total`` rows have the key.

    At most ``_HOT`` keys can have more than total / _HOT rows; their rows of right are sent to the workers.
    """
    is_hot = F.col("n") > max(_FEW, -(-total // _HOT))
    hot, cold = F.broadcast(right.where(is_hot).drop("n")), right.where(~is_hot).drop("n")
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))
