"""Session settings, table readers and the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gaugeworks", cpus: str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where neither the setting nor the context has one, as in
    local tests, a temporary folder is made and set; on a cluster that is an error, since executors can't share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), f"gaugeworks-{uuid.uuid4().hex}")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a table that one query writes and reads again."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, by: str, rows: int = 50_000) -> DataFrame:
    """df dealt out by a hash of `by`, a task for about `rows` rows. A file of small rows is read by one task, which
    would hold all that its rows grow into; so their number and not their bytes decides."""
    return df.repartition(df.count() // rows + 1, by)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, with the lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
