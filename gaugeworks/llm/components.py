"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import SMALL_ROWS, gathered, join_by_group
from gaugeworks.session import checkpointed


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One step: every node's larger (or smaller) neighbours are linked to its smallest neighbour instead.

    The smallest neighbour comes from a pre-aggregated minimum, so no neighbour list is ever gathered.
    """
    if large:
        sides = edges.select(F.col("u").alias("at"), F.col("v").alias("to")).union(edges.select(F.col("v").alias("at"), F.col("u").alias("to")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("at"), F.least("u", "v").alias("to"))
    least = sides.groupBy("at").agg(F.least(F.min("to"), F.col("at")).alias("low"), F.count(F.lit(1)).alias("sides"))
    least = gathered(least, rows, 100_000)
    if 2 * rows <= SMALL_ROWS:  # each of the `rows` edges has two ends, so there are no more minima than that
        met = sides.join(F.broadcast(least), "at")
    else:  # once components are stars, a hub has most of the edges
        met = join_by_group(sides, checkpointed(least), "at", "sides", 2 * rows)
    if large:
        out = met.where(F.col("to") > F.col("at")).select(F.col("to").alias("u"), F.col("low").alias("v"))
    else:
        out = met.select(F.col("to").alias("u"), F.col("low").alias("v")).union(met.select(F.col("at").alias("u"), F.col("low").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v) that reaches a smaller one: component is the smallest.

    Ends when a round changes nothing, after about log2 of the longest chain. Self-loops and repeated edges do
    no harm; rows with a null end are left out; no edges give no rows.
    """
    now = checkpointed(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        now = gathered(now, mark[0], 100_000)
        now = checkpointed(gathered(_star(gathered(_star(now, True, mark[0]), mark[0], 100_000), False, mark[0]), mark[0], 100_000))
