"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import checkpointed

#: The six ASCII white-space characters, as the contracts name them.
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: A key is hot when it holds at least this share of all rows, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1e-3

#: A table of a few numbers a row is broadcast whole up to this many rows, some 8 MB; the size is checked before.
SMALL_ROWS = 100_000


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; other columns can't clash with them."""
    return docs.select(*[docs[old].alias(new) for new, old in columns.items()])


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined with one row of groups for each key, where a few keys may hold most rows.

    Groups with at least HOT_SHARE of `total` rows, which can't be more than 1 / HOT_SHARE, are broadcast, so
    their rows stay where they are. All other rows meet their group in a shuffled join.
    """
    least = max(2, int(total * HOT_SHARE))
    hot = groups.where(F.col(size) >= least)
    cold = groups.where(F.col(size) < least)
    keys = hot.select(key)
    at_hot = rows.join(F.broadcast(hot), key)
    at_cold = rows.join(F.broadcast(keys), key, "left_anti").join(cold.hint("merge"), key, "left")
    return at_hot.unionByName(at_cold.select(at_hot.columns))


def semi_join(rows: DataFrame, keys: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """Rows whose key is among keys (one row each). Up to `most` keys, by count, are broadcast, so that no row of a
    hot key moves; more meet the rows in a shuffled join."""
    small = keys.count() <= most
    return rows.join(F.broadcast(keys) if small else keys.hint("merge"), key, "left_semi")


def anti_join(rows: DataFrame, keys: DataFrame, on, most: int = 200_000) -> DataFrame:
    """Rows that meet none of keys. Up to `most` keys, by count, are broadcast, so that no row moves; on is a name or
    a condition."""
    keys = checkpointed(keys)
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys.hint("merge"), on, "left_anti")


def gathered(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """df in no more partitions than `rows`, about their number, need at `each` a task, but eight at least: small
    steps of a loop then write few files, however many partitions a shuffle has."""
    return df.coalesce(max(8, -(-rows // each)))


def bound_batches(spark: SparkSession, most_bytes: int = 4_000_000) -> None:
    """From now on the session passes texts to Python workers in batches of about most_bytes, where it would pass more:
    the writer's and the worker's buffers are of that size then, for long rows too."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.isModifiable(key):
        spark.conf.set(key, most_bytes)


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most most_bytes of text each; a longer text gets a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
        yield batch.slice(start, end - start)
        start = end


def raw_texts(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in batch.column(text).cast(pa.large_binary()).to_pylist()]
