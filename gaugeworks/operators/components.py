"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import checkpointed


def _star(edges: DataFrame, within: str, is_large: bool) -> DataFrame:
    """One step: larger (or smaller) neighbours of every node are linked to its least neighbour instead. Least
    neighbours are minima that are aggregated before they move; no list of neighbours is gathered."""
    a, b = F.col("a"), F.col("b")
    if is_large:
        sides = edges.select(within, a.alias("at"), b.alias("to")).union(edges.select(within, b.alias("at"), a.alias("to")))
    else:
        sides = edges.select(within, F.greatest(a, b).alias("at"), F.least(a, b).alias("to"))
    least = sides.groupBy(within, "at").agg(F.least(F.min("to"), F.col("at")).alias("low"))
    met = sides.join(least, [within, "at"])
    out = met.select(within, F.col("low").alias("a"), F.col("to").alias("b"))
    if is_large:
        out = out.where("b > a AND at < b")
    else:
        out = out.union(met.select(within, F.col("low").alias("a"), F.col("at").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, within: str) -> DataFrame:
    """(within, node, component) of the nodes that edges (within, a, b) connect with a smaller one: component is the
    smallest. Ends when a round changes nothing, after about the logarithm of the longest chain; self-loops and edges
    that repeat do no harm, rows with a null end go."""
    now = checkpointed(edges.select(within, "a", "b").where("a <> b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(within, "a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return now.select(within, F.col("b").alias("node"), F.col("a").alias("component"))
        seen = mark
        now = checkpointed(_star(_star(now, within, True), within, False))
