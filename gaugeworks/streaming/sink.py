"""A table that stream batches are merged into: newest row of each key, once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.merge import last_write_wins


class MergedTable:
    """Every batch that reached the table is a folder of its own, named by the batch's number, so a batch that is
    run again after a failure replaces its own folder and changes nothing else. Readers take the newest row of
    each key; compact() folds the batches into one."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], stamp: str, ties: list[str]):
        self.spark, self.path, self.schema, self.keys, self.stamp, self.ties = spark, path, schema, keys, stamp, ties

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        rows = last_write_wins(batch, self.keys, self.stamp, self.ties)
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, batch BIGINT").parquet(self.path)
        return last_write_wins(rows, self.keys, self.stamp, [*self.ties, "batch"]).drop("batch")

    def compact(self, path: str) -> MergedTable:
        """The same rows as one batch, -1, of a new table at path; batches of the stream go there from then on."""
        self.read().write.mode("overwrite").parquet(f"{path}/batch=-1")
        return MergedTable(self.spark, path, self.schema, self.keys, self.stamp, self.ties)

    def todo(self, wanted: DataFrame, done: str) -> DataFrame:
        """Wanted keys that aren't complete yet: those never seen first."""
        seen = self.read().select(*self.keys, F.expr(done).alias("_done"))
        met = wanted.join(seen, self.keys, "left").where(~F.coalesce("_done", F.lit(False)))
        return met.orderBy(F.col("_done").isNotNull(), *self.keys).drop("_done")
