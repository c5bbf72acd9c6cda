"""Shapes of step functions: resampling, distance, clusters, representatives, bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.operators.components import components
from gaugeworks.operators.selection import order_statistics
from gaugeworks.session import checkpointed

#: Fixed value: shapes are near when fewer of their samples than this share differ. Rows of a chunk that are compared.
NEAR, CHUNK = 0.2, 500


def last_before(steps: DataFrame, grid: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """grid (keys, at) with the value of the last step at or before it; 0 before the first. One union and one
    window over both, so nothing multiplies."""
    both = steps.select(*keys, F.col(at).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_grid"))
    both = both.unionByName(grid.select(*keys, F.col(at).alias("_t"), F.lit(None).cast(steps.schema[value].dataType).alias("_v"), F.lit(1).alias("_grid")))
    order = W.partitionBy(*keys).orderBy("_t", "_grid").rowsBetween(W.unboundedPreceding, 0)
    held = both.withColumn(value, F.last("_v", ignorenulls=True).over(order)).where("_grid = 1")
    return held.select(*keys, F.col("_t").alias(at), F.coalesce(value, F.lit(0)).alias(value))


def resampled(steps: DataFrame, until: DataFrame, group: str, buckets: int) -> DataFrame:
    """(group, bucket, n): the count at the middle of each of `buckets` equal parts of the observed window."""
    return samples_of(sampled(steps, until, group, buckets), group)


def sampled(steps: DataFrame, until: DataFrame, group: str, buckets: int) -> DataFrame:
    """until (group, window and more) with shape, the counts at the middle of each of `buckets` equal parts of the
    window; 0 before the first step.

    A step knows how many of the middles it holds, so no grid is made, sorted or shuffled: a group has its steps that
    hold any, `buckets` at most."""
    number = steps.schema["n"].dataType
    held = steps.select(group, "t", "n", F.lead("t").over(W.partitionBy(group).orderBy("t")).alias("_next"))
    met = until.join(held, group, "left")
    middle = lambda b: F.col("window") * (b + 0.5) / buckets
    mine = F.filter(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: (middle(b) >= F.col("t")) & (F.col("_next").isNull() | (middle(b) < F.col("_next"))))
    met = met.withColumn("_k", F.when(F.col("t").isNotNull(), F.size(mine)).otherwise(0))
    rest = [c for c in until.columns if c != group]
    out = met.groupBy(group).agg(*(F.first(c).alias(c) for c in rest), F.sum("_k").cast("int").alias("_all"), F.array_sort(F.collect_list(F.when(F.col("_k") > 0, F.struct("t", "n", "_k")))).alias("_runs"))
    runs = F.flatten(F.transform("_runs", lambda r: F.array_repeat(r["n"], r["_k"])))
    return out.select(group, *rest, F.concat(F.array_repeat(F.lit(0).cast(number), buckets - F.col("_all")), runs).alias("shape"))


def samples_of(shapes: DataFrame, *keep: str) -> DataFrame:
    """(keep, bucket, n): a row for each sample."""
    return shapes.select(*keep, F.posexplode("shape").alias("bucket", "n")).withColumn("bucket", F.col("bucket").cast("long"))


def shape_distance(a, b):
    """Share of the buckets whose counts differ by 1 or more; 1 for empty shapes."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(F.abs(x - y) >= 1, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, apart / F.size(a)).otherwise(1.0)


def pair_distances(shapes: DataFrame, within: str, name: str) -> DataFrame:
    """(within, name_a, name_b, distance) of the different members of an encounter, whose number its pulls bound."""
    a, b = (shapes.select(within, F.col(name).alias(f"{name}_{s}"), F.col("shape").alias(f"shape_{s}")) for s in "ab")
    met = a.join(b, within).where(F.col(f"{name}_a") < F.col(f"{name}_b"))
    return met.select(within, f"{name}_a", f"{name}_b", shape_distance(F.col("shape_a"), F.col("shape_b")).alias("distance"))


def _tiles(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """(key, members): the rows of each key that has two or more, dealt to chunks of about CHUNK; a row of two chunks
    (or one) side by side for each pair of chunks, as an array of (name, shape). No task holds more than two."""
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_parts", F.ceil(F.col("_n") / CHUNK).cast("int"))
    dealt = rows.join(sizes, key).withColumn("_part", F.pmod(F.xxhash64(name), F.col("_parts")).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    low, high = F.least("_part", "_with").alias("_low"), F.greatest("_part", "_with").alias("_high")
    return dealt.groupBy(*key, low, high).agg(F.collect_list(F.struct(name, "shape")).alias("members")).select(*key, "members")


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, pa.Array, np.ndarray]]:
    """Of each tile its batch and row, its names, and how many samples of each two shapes differ."""
    for batch in batches:
        for k in range(batch.num_rows):
            members = batch.column("members")[k].values
            shapes = np.stack([np.asarray(x) for x in members.field(1).to_pylist()])
            apart = np.concatenate([(shapes[at : at + 32, None] != shapes[None]).sum(2) for at in range(0, len(shapes), 32)])
            yield batch, k, members.field(0), apart


def near_links(shapes: DataFrame, within: str, name: str, less: float = NEAR) -> DataFrame:
    """(within, a, b): links that connect what pairs closer than `less` connect, and no others. Counts are whole
    numbers, so two samples differ by 1 or more if they differ.

    Two shapes that differ in at most d samples are equal in one of d + 1 blocks at least, so only shapes that share
    a block are compared; CHUNK shapes or fewer are compared as they are. Equal shapes are one. What a tile of shapes
    connects is linked to its first, so the number of links grows with the shapes and not with their pairs. Empty
    shapes are near none.
    """
    kind = shapes.schema[name].dataType.simpleString()
    one = shapes.where(F.size("shape") > 0).groupBy(within, "shape").agg(F.min(name).alias(name))
    m = F.size("shape")
    blocks = F.ceil(m * less).cast("int")  # the most samples that may differ, and one
    begin = lambda b: F.floor(m * b / blocks).cast("int")
    block = lambda b: F.xxhash64(m, b, F.slice("shape", begin(b) + 1, begin(b + 1) - begin(b)))
    many = one.groupBy(within).agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > CHUNK)
    whole = F.array(F.xxhash64(m))  # shapes of other lengths aren't compared
    blocked = F.when(F.col("_many").isNull(), whole).otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), block))
    keyed = one.join(many, within, "left").withColumn("block", F.explode(blocked))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, names, apart in _tile_rows(batches):
            size = len(batch.column("members")[k].values.field(1)[0])
            near = apart < less * size
            order = pc.sort_indices(names).to_numpy()
            near = near[order][:, order]
            first = np.arange(len(near))
            while True:
                new = np.where(near, first, len(near)).min(1)
                new = new[new]
                if (new == first).all():
                    break
                first = new
            names = names.take(pa.array(order))
            linked = np.flatnonzero(first != np.arange(len(first)))
            where = batch.column(within).take(pa.array(np.full(len(linked), k)))
            yield pa.RecordBatch.from_arrays([where, names.take(pa.array(first[linked])), names.take(pa.array(linked))], [within, "a", "b"])

    tiles = _tiles(keyed.select(within, "block", name, "shape"), [within, "block"], name)
    return tiles.select(within, "members").mapInArrow(work, f"{within} {shapes.schema[within].dataType.simpleString()}, a {kind}, b {kind}").distinct()


def clusters(shapes: DataFrame, within: str, name: str, less: float = NEAR) -> DataFrame:
    """(within, name, cluster): single-link clusters of members closer than `less`, each named by its first."""
    one = shapes.groupBy(within, "shape").agg(F.min(name).alias("_one"))
    found = components(near_links(shapes, within, name, less), within)
    named = one.join(found.select(within, F.col("node").alias("_one"), "component"), [within, "_one"], "left")
    named = named.select(within, "shape", F.coalesce("component", "_one").alias("cluster"))
    is_empty = F.size("shape") == 0  # an empty shape is at distance 1 from any, an equal one too
    return shapes.join(named, [within, "shape"]).select(within, name, F.when(is_empty, F.col(name)).otherwise(F.col("cluster")).alias("cluster"))


def medoids(shapes: DataFrame, members: DataFrame, within: str, name: str) -> DataFrame:
    """(within, cluster, medoid, total, diameter, size): the member with the least sum of distances to its cluster's
    others (6 places), then the first. members: within, name, cluster.

    Of clusters of CHUNK different shapes or fewer all are compared in a task that holds them; equal ones are one.
    """
    group = [within, "cluster"]
    met = members.join(shapes, [within, name]).select(*group, name, "shape")
    one = checkpointed(met.groupBy(*group, "shape").agg(F.min(name).alias(name), F.count(F.lit(1)).alias("_w")))
    length = F.size("shape")
    facts = checkpointed(one.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("size"), F.min(length).alias("_least"), F.max(length).alias("_most"), F.first(name).alias(name)))
    is_few = (F.col("_n") <= CHUNK) & (F.col("_least") == F.col("_most")) & (F.col("_least") > 0)
    is_alone = F.col("size") == 1
    lone = facts.where(is_alone).select(*group, F.col(name).alias("medoid"), F.lit(0.0).alias("total"), F.lit(0.0).alias("diameter"), "size")
    kinds = {c: members.schema[c].dataType.simpleString() for c in [*group, name]}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, names, apart in _tile_rows(batches):
            rows = batch.column("members")[k].values
            sums = apart @ rows.field(2).to_numpy()
            least = np.flatnonzero(sums == sums.min())
            best = names.take(pa.array(least)).take(pc.sort_indices(names.take(pa.array(least)))[:1])
            size = len(rows.field(1)[0])
            values = [pa.array([int(sums.min())]), pa.array([int(apart.max())]), pa.array([size])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in group), best, *values], [*group, "medoid", "_sum", "_far", "_m"])

    few = facts.where(is_few & ~is_alone).select(*group)
    tiles = one.join(few, group).groupBy(*group).agg(F.collect_list(F.struct(name, "shape", "_w")).alias("members"))
    near = tiles.mapInArrow(work, ", ".join(f"{c} {kinds[c]}" for c in group) + f", medoid {kinds[name]}, _sum long, _far long, _m long")
    near = near.join(facts.select(*group, "size"), group).select(*group, "medoid", F.round(F.col("_sum") / F.col("_m"), 6).alias("total"), (F.col("_far") / F.col("_m")).alias("diameter"), "size")
    large = facts.where(~is_few & ~is_alone).select(*group)
    out = lone.unionByName(near)
    return out if large.isEmpty() else out.unionByName(_large_medoids(shapes, met.join(large, group, "left_semi"), within, name))


def _large_medoids(shapes: DataFrame, met: DataFrame, within: str, name: str) -> DataFrame:
    """medoids() of met (within, cluster, name, shape) without holding a cluster.

    The sum of a member's distances needs no pairs: at each sample it differs from all but those with its own count.
    The diameter is searched among the members that can be ends of it: those whose distances from the medoid add up to
    more than the largest distance from the member that is farthest from it.
    """
    group = [within, "cluster"]
    sizes = met.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    points = met.select(*group, name, F.posexplode("shape").alias("at", "n"))
    same = points.groupBy(*group, "at", "n").agg(F.count(F.lit(1)).alias("same"))
    alike = points.join(same, [*group, "at", "n"]).groupBy(*group, name).agg(F.sum("same").alias("alike"), F.count(F.lit(1)).alias("m"))
    sums = met.select(*group, name).join(alike, [*group, name], "left").join(sizes, group)
    total = F.coalesce(F.col("size") - F.col("alike") / F.col("m"), F.col("size") - F.lit(1.0))  # empty shapes lie 1 apart
    sums = sums.select(*group, name, "size", F.round(total, 6).alias("total"))
    best = sums.groupBy(*group).agg(F.min_by(name, F.struct("total", name)).alias("medoid"), F.min("total").alias("total"), F.first("size").alias("size"))
    best = checkpointed(best)
    one = met.groupBy(*group, "shape").agg(F.min(name).alias(name))
    centre = best.select(within, F.col("medoid").alias(name)).join(shapes, [within, name]).select(within, F.col(name).alias("medoid"), F.col("shape").alias("centre"))
    centred = one.join(best.select(*group, "medoid"), group).join(centre, [within, "medoid"])
    centred = centred.select(*group, name, "shape", shape_distance(F.col("shape"), F.col("centre")).alias("r"))
    ends = centred.groupBy(*group).agg(F.max("r").alias("most"), F.max_by("shape", F.struct("r", name)).alias("end"))
    reach = centred.join(ends, group).withColumn("far", F.when(F.size("shape") > 0, shape_distance(F.col("shape"), F.col("end"))).otherwise(F.lit(0.0)))
    least = reach.groupBy(*group).agg(F.max("far").alias("reach"))
    open_ = reach.join(least, group).where((F.size("shape") > 0) & (F.col("r") + F.col("most") > F.col("reach")))
    kinds = {c: met.schema[c].dataType.simpleString() for c in group}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, k, _, apart in _tile_rows(batches):
            size = len(batch.column("members")[k].values.field(1)[0])
            row = [batch.column(c).slice(k, 1) for c in group]
            yield pa.RecordBatch.from_arrays([*row, pa.array([apart.max() / size])], [*group, "far"])

    tiles = _tiles(open_.select(*group, name, "shape"), group, name)
    wide = tiles.mapInArrow(work, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", far double").groupBy(*group).agg(F.max("far").alias("far"))
    out = best.join(least, group, "left").join(wide, group, "left")
    return out.select(*group, "medoid", "total", F.greatest(F.coalesce("reach", F.lit(0.0)), F.coalesce("far", F.lit(0.0))).alias("diameter"), "size")


def representatives(pulls: DataFrame, within: str, name: str, mean: str, length: str) -> DataFrame:
    """(within, name): the pull nearest to its encounter's median mean, then its median length, then the first."""
    middle = lambda c, name: order_statistics(pulls, [within], c, {name: 0.5}).select(within, name)
    met = pulls.join(middle(mean, "_m"), within, "left").join(middle(length, "_l"), within, "left")
    order = F.struct(F.round(F.abs(F.col(mean) - F.col("_m")), 6), F.round(F.abs(F.col(length) - F.col("_l")), 6), F.col(name))
    return met.groupBy(within).agg(F.min_by(name, order).alias(name))


def band(samples: DataFrame, within: str, least: int = 2) -> DataFrame:
    """(within, bucket, pulls, median, p25, p75, low, high) over the pulls of an encounter, of `least` or more.

    Counts are few however many the pulls, so a bucket's counts are counted, and those are what a task holds."""
    counted = samples.where("n IS NOT NULL").groupBy(within, "bucket", "n").agg(F.count(F.lit(1)).alias("c"))
    at = lambda share: F.percentile("n", F.lit(share), F.col("c"))
    out = counted.groupBy(within, "bucket").agg(F.sum("c").alias("pulls"), at(0.5).alias("median"), at(0.25).alias("p25"), at(0.75).alias("p75"), F.min("n").alias("low"), F.max("n").alias("high"))
    return out.where(F.col("pulls") >= least)


def aligned(steps: DataFrame, ends: DataFrame, within: str, name: str) -> DataFrame:
    """(within, t, name, n): every series of an encounter at all breakpoints of the encounter; null after its end.

    Values are carried forward over the union of the breakpoints.
    """
    points = steps.select(within, "t").distinct()
    grid = points.join(ends.select(within, name, "window"), within)
    held = last_before(steps, grid.select(within, name, "t"), [within, name], "t", "n")
    return held.join(ends, [within, name]).select(within, "t", name, F.when(F.col("t") <= F.col("window"), F.col("n")).alias("n"))


def nearest_window(asserted: DataFrame, measured: DataFrame, within: str, most: float = 8.0) -> DataFrame:
    """asserted (within, id, start, lasts) with the id of the measured window nearest in start and length taken
    together, null where none is within `most`. Only windows whose start lies that near are compared, by bins of
    that width; equal distances go to the earlier start, then the smaller id."""
    cut = lambda c: F.floor(c / most).cast("long")
    near = asserted.withColumn("_bin", F.explode(F.array(*[cut(F.col("start")) + d for d in (-1, 0, 1)])))
    found = measured.select(within, F.col("id").alias("m_id"), F.col("start").alias("m_start"), F.col("lasts").alias("m_lasts"), cut(F.col("start")).alias("_bin"))
    met = near.join(found, [within, "_bin"])
    gap = F.round(F.abs(F.col("start") - F.col("m_start")) + F.abs(F.col("lasts") - F.col("m_lasts")), 6)
    best = met.withColumn("gap", gap).where(F.col("gap") <= most).groupBy(within, "id").agg(F.min_by("m_id", F.struct("gap", "m_start", "m_id")).alias("nearest"), F.min("gap").alias("gap"))
    return asserted.join(best, [within, "id"], "left")
