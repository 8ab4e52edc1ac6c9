"""Columns, tables and Arrow helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratanet.session import written

#: Fixed value of the contracts: what separates words.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a table that is sent to every executor, at most.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    grain = 1 << 53
    return F.pmod(F.xxhash64(*columns), F.lit(grain)) / F.lit(float(grain))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the folder the cluster shares and read back.

    A lost executor re-reads the files instead of computing the rows anew, and
    a table that is read twice is computed once.
    """
    return written(df, name)


def small(df: DataFrame, width: int) -> DataFrame:
    """The table, sent to all executors if its counted rows of ``width`` bytes are few; else it is shuffled."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``size`` bytes of a text or binary column, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype="int64") // size
        starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for begin, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(begin, end - begin)


def flat_lists(values: pa.Array, lengths) -> pa.Array:
    """One list per length, cut from the values in their order."""
    ends = np.zeros(len(lengths) + 1, dtype="int32")
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)
