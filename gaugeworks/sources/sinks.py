"""Published datasets: a folder for each tier, a manifest, an index over tiers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.functions.text import tier_order


def write_tier(rows: DataFrame, path: str) -> None:
    """Parquet by tier; only the tiers that rows hold are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tier").parquet(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """JSON lines by tier; null keys are left out."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tier").json(path)


def read_tiers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, tier STRING").json(path)


def manifest(rows: DataFrame, keys: list[str], columns: list[str], settings: dict[str, str]) -> DataFrame:
    """One row per tier: the settings, and a sorted list with a summary of each build. A tier's builds are few."""
    entry = F.struct(*keys, *columns)
    return rows.groupBy("tier").agg(*[F.lit(v).alias(k) for k, v in settings.items()], F.array_sort(F.collect_list(entry)).alias("builds"))


def tier_index(rows: DataFrame) -> DataFrame:
    """(tier, builds, current): the tiers that exist, with the latest by prefix and number marked."""
    tiers = rows.groupBy("tier").agg(F.count(F.lit(1)).alias("builds"))
    last = tiers.agg(F.max_by("tier", tier_order(F.col("tier"))).alias("last"))
    return tiers.join(F.broadcast(last)).select("tier", "builds", (F.col("tier") == F.col("last")).alias("current"))  # one row


def tier_at(rows: DataFrame, back: int = 0) -> DataFrame:
    """(tier): the latest tier, or the one so many before it; no row if there are too few."""
    order = tier_order(F.col("tier"))
    return rows.select("tier").distinct().orderBy(order.desc()).offset(back).limit(1)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A document that may not have been published."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def schema_text(df: DataFrame) -> list[str]:
    """A line for each field, nested ones by path; fields that hold times are starred."""
    out: list[str] = []

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}[]")
        else:
            star = "*" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) or "time" in path.lower() else ""
            out.append(f"{path}: {kind.simpleString()}{star}")

    walk(df.schema, "")
    return out
