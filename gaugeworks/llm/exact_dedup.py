"""Exact dedup against a persistent digest index.

The index is a Parquet table of one row per distinct normalised text, bucketed and sorted by the text's
SHA-256. A batch of documents is reduced to one row per digest, anti-joined with the index by sort-merge (the
index side needs no shuffle), and what is new is appended. All work is in Spark's own expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import SPACE_RUN, join_by_group, pick
from gaugeworks.session import checkpointed


def text_digest(text: Column) -> Column:
    """SHA-256, as 32 bytes, of a text whose runs of ASCII white space are each one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "), 256))


class DigestIndex:
    """A bucketed table of (digest, keep_id, batch) at a path in a shared or permanent folder.

    A later session opens the same index by giving the same path. The number of buckets is fixed when the index
    is made: as many as keep a bucket below a task's memory at the size that the index shall reach.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forget the table's name in the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _append(self, entries: DataFrame) -> None:
        """Each bucket is written by one task, as one sorted file."""
        entries.repartition(self.buckets, "digest").sortWithinPartitions("digest").select("digest", "keep_id", "batch").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compacted(self, path: str, name: str) -> DigestIndex:
        """The same entries in a new index at another path, with one sorted file a bucket instead of one a batch."""
        out = DigestIndex(self.spark, path, name, self.buckets)
        out._append(self.entries())
        return out

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Decide on every row of a batch and append the batch's new digests to the index.

        Returns a row per input row: doc_id, row_key, keep_id (the id whose text is kept: that of the index if
        the text was there before, else the smallest of the batch), group_size (rows of the batch with that
        text), kept, digest. Nulls: a null text counts as empty; a null id sorts after all others. Of repeated
        rows with one id, one is kept. An empty batch gives no rows and leaves the index as it was.

        A batch that is named may be run again, after a failure or not: entries of its own name don't count as
        there before and aren't appended twice, so each run gives the same rows. Without a name it counts as new.
        """
        batch = batch or uuid.uuid4().hex
        rows = pick(docs, doc_id=id_col, text=text_col).select(
            "doc_id", F.monotonically_increasing_id().alias("row_key"), text_digest(F.col("text")).alias("digest")
        )
        rows = checkpointed(rows)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
        groups = checkpointed(rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size")))
        others = self.entries().where(F.col("batch") != batch)
        new = groups.join(others.hint("merge"), "digest", "left_anti").select("digest", F.col("first.doc_id").alias("keep_id"))
        new = checkpointed(new.withColumn("is_new", F.lit(True)))
        known = others.select("digest", F.col("keep_id").alias("known_id"))
        resolved = groups.join(new.select("digest", "is_new"), "digest", "left")
        resolved = resolved.join(known.hint("merge"), "digest", "left")
        resolved = checkpointed(
            resolved.select(
                "digest",
                "group_size",
                F.coalesce("is_new", F.lit(False)).alias("is_new"),
                F.col("first.row_key").alias("first_row"),
                F.when(F.col("is_new"), F.col("first.doc_id")).otherwise(F.col("known_id")).alias("keep_id"),
            )
        )
        own = self.entries().where(F.col("batch") == batch).select("digest")
        self._append(checkpointed(new.join(own.hint("merge"), "digest", "left_anti").select("digest", "keep_id", F.lit(batch).alias("batch"))))
        return join_by_group(rows, resolved, "digest", "group_size", rows.count()).select(
            "doc_id",
            "row_key",
            "keep_id",
            "group_size",
            (F.col("is_new") & (F.col("row_key") == F.col("first_row"))).alias("kept"),
            "digest",
        )
