"""Paged event scans as a Spark data source.

A cached response is a row (fight, cursor, next, data): the page that was asked for at a cursor, and the cursor that it
named for the next, null for the last. Pages lie in buckets, sorted by fight and cursor, one file each. Batch reads walk
the cursors of a bucket's fights in one task each. Streams walk them under a budget: what passes through the driver is
a reference to each admitted page, its data are fetched by tasks; the offset is the next cursor, so that a later run
goes on where the budget ended the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from gaugeworks.plans.rules import LEAST_COVERAGE

FORMAT = "paged_events"
EVENT = "timestamp long, type string, actor long, amount double"
_EVENT_NAMES = [f.split()[0] for f in EVENT.split(", ")]
_EVENT_TYPE = pa.struct([("timestamp", pa.int64()), ("type", pa.string()), ("actor", pa.int64()), ("amount", pa.float64())])
ROW = f"fight long, page int, cursor long, next long, {EVENT}"
#: Pages of a fight that are read at most, and the share of a budget at which a run stops.
MAX_PAGES, CEILING = 5, 0.8


def write_pages(events: DataFrame, path: str, stamps: int, buckets: int = 16) -> None:
    """Cache events (fight and the columns of EVENT) as pages of `stamps` distinct timestamps each. Events of one
    timestamp are never parted, so a cursor names one page. Rows without a fight or a timestamp go."""
    known = events.where("fight IS NOT NULL AND timestamp IS NOT NULL")
    nth = F.dense_rank().over(W.partitionBy("fight").orderBy("timestamp"))
    paged = known.select("fight", F.floor((nth - 1) / stamps).alias("page"), F.struct(*_EVENT_NAMES).alias("e"))
    pages = paged.groupBy("fight", "page").agg(F.min("e.timestamp").alias("cursor"), F.array_sort(F.collect_list("e")).alias("data"))
    after = F.lead("cursor").over(W.partitionBy("fight").orderBy("page"))
    rows = pages.select(F.pmod("fight", F.lit(buckets)).cast("int").alias("bucket"), "fight", "cursor", after.alias("next"), "data")
    rows.repartition("bucket").sortWithinPartitions("bucket", "fight", "cursor").write.partitionBy("bucket").parquet(path)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _buckets(path: str) -> list[int]:
    store, base = _open(path)
    found = store.get_file_info(fs.FileSelector(base))
    return sorted(int(f.base_name.removeprefix("bucket=")) for f in found if f.base_name.startswith("bucket="))


def _pages(path: str, bucket: int, columns: list[str], where: pads.Expression | None = None) -> Iterator[pa.RecordBatch]:
    """A bucket's pages in the order of fight and cursor, a few at a time."""
    store, base = _open(path)
    files = pads.dataset(f"{base}/bucket={bucket}", format="parquet", filesystem=store)
    yield from files.scanner(columns=columns, filter=where, batch_size=256, batch_readahead=1, fragment_readahead=1).to_batches()


def _rows(pages: pa.RecordBatch, numbers: list[int]) -> pa.RecordBatch:
    """A row for each event of the pages."""
    at = pc.list_parent_indices(pages.column("data"))
    events = pc.list_flatten(pages.column("data")).cast(_EVENT_TYPE)
    columns = [pages.column("fight").take(at), pa.array(numbers, pa.int32()).take(at), pages.column("cursor").take(at), pages.column("next").take(at), *events.flatten()]
    return pa.RecordBatch.from_arrays(columns, ["fight", "page", "cursor", "next", *_EVENT_NAMES])


class Bucket(InputPartition):
    def __init__(self, bucket: int):
        self.bucket = bucket


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxpages", MAX_PAGES))

    def partitions(self) -> list[Bucket]:
        return [Bucket(b) for b in _buckets(self.path)]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        """Pages of each fight from its first cursor on, as far as each names the one that follows."""
        fight, expected, page = None, None, 0
        for batch in _pages(self.path, partition.bucket, ["fight", "cursor", "next", "data"]):
            taken, numbers = [], []
            for k, (f, cursor, after) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("fight", "cursor", "next")), strict=True)):
                if f != fight:
                    fight, expected, page = f, cursor, 0
                if page >= self.most or cursor != expected:  # a cursor without a page ends the fight
                    continue
                taken.append(k)
                numbers.append(page)
                page, expected = page + 1, after
            if taken:
                yield _rows(batch.take(pa.array(taken)), numbers)


class _CursorStream(SimpleDataSourceStreamReader):
    """References to pages, in the order of bucket, fight and cursor. The offset is the first page not yet admitted.

    A run admits pages until more than `ceiling` of its budget are spent, `perbatch` at most in one batch."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.budget, self.ceiling = int(options.get("budget", 1 << 62)), float(options.get("ceiling", CEILING))
        self.most, self.per_batch = int(options.get("maxpages", 1 << 30)), int(options.get("perbatch", 1000))
        self.spent = 0

    def initialOffset(self) -> dict:
        return {"bucket": -1, "fight": 0, "cursor": 0, "page": 0}

    def _walk(self, start: dict) -> Iterator[tuple[tuple, dict]]:
        """Each page from an offset on, with the offset behind it."""
        for bucket in _buckets(self.path):
            if bucket < start["bucket"]:
                continue
            where, fight, expected, page = None, None, None, 0
            if bucket == start["bucket"]:
                same = (pc.field("fight") == start["fight"]) & (pc.field("cursor") >= start["cursor"])
                where = (pc.field("fight") > start["fight"]) | same
                fight, expected, page = start["fight"], start["cursor"], start["page"]
            for batch in _pages(self.path, bucket, ["fight", "cursor", "next"], where):
                for f, cursor, after in zip(*(batch.column(c).to_pylist() for c in ("fight", "cursor", "next")), strict=True):
                    if f != fight:
                        fight, expected, page = f, cursor, 0
                    if page >= self.most or cursor != expected:
                        continue
                    row = (bucket, f, page, cursor, after)
                    page, expected = page + 1, after
                    yield row, {"bucket": bucket, "fight": f, "cursor": cursor + 1 if after is None else after, "page": page}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, end = [], start
        if self.spent / self.budget <= self.ceiling:
            for row, behind in self._walk(start):
                out.append(row)
                end = behind
                self.spent += 1
                if len(out) >= self.per_batch or self.spent / self.budget > self.ceiling:
                    break
        return iter(out), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same references again, after a failure."""
        if start == end:
            return iter([])
        out = []
        for row, behind in self._walk(start):
            out.append(row)
            if behind == end:
                break
        return iter(out)


class PagedEvents(DataSource):
    """Options: path; maxpages of a fight; for streams budget, ceiling and perbatch. Batch rows are events (ROW);
    stream rows are references to pages (bucket, fight, page, cursor, next)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> _BatchReader:
        return _BatchReader(self.options)

    def simpleStreamReader(self, schema) -> _CursorStream:
        return _CursorStream(self.options)


REFERENCE = "bucket int, fight long, page int, cursor long, next long"


def read_pages(spark: SparkSession, path: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """The events of at most max_pages pages of each fight."""
    spark.dataSource.register(PagedEvents)
    return spark.read.format(FORMAT).option("path", path).option("maxpages", max_pages).load()


def stream_pages(spark: SparkSession, path: str, budget: int, ceiling: float = CEILING, per_batch: int = 1000, max_pages: int = 1 << 30) -> DataFrame:
    """The events of the pages that a run admits, as a stream."""
    spark.dataSource.register(PagedEvents)
    options = {"path": path, "budget": budget, "ceiling": ceiling, "perbatch": per_batch, "maxpages": max_pages}
    references = spark.readStream.format(FORMAT).schema(REFERENCE).options(**options).load()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket in pc.unique(batch.column("bucket")).to_pylist():
                wanted = batch.filter(pc.equal(batch.column("bucket"), bucket))
                number = dict(zip(zip(wanted.column("fight").to_pylist(), wanted.column("cursor").to_pylist(), strict=True), wanted.column("page").to_pylist(), strict=True))
                fights = wanted.column("fight")
                where = (pc.field("fight") >= pc.min(fights)) & (pc.field("fight") <= pc.max(fights)) & pc.field("cursor").isin(pc.unique(wanted.column("cursor")))
                for pages in _pages(path, bucket, ["fight", "cursor", "next", "data"], where):
                    keys = list(zip(pages.column("fight").to_pylist(), pages.column("cursor").to_pylist(), strict=True))
                    taken = [k for k, key in enumerate(keys) if key in number]
                    if taken:
                        yield _rows(pages.take(pa.array(taken)), [number[keys[k]] for k in taken])

    return references.repartition("bucket").mapInArrow(fetch, ROW)


def admitted(stream: DataFrame, path: str) -> None:
    """Run a stream until it admits nothing more, into path/rows; a later run with the same path goes on from its offset."""
    running = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()


def observed(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(fight, pages, events, reached, truncated, coverage, complete) of what was read. lengths: fight, begin, length.

    Reached is the time of the last event read since begin, or the whole length if no page is missing; coverage is its
    share of the length, and complete says whether that is enough for a claim about the whole. Fights of which nothing
    was read have no pages and a coverage of 0.
    """
    read = rows.groupBy("fight").agg(
        F.countDistinct("page").alias("pages"), F.count(F.lit(1)).alias("events"), F.max("timestamp").alias("last"),
        F.max_by(F.struct(F.col("next").isNotNull().alias("more")), "page").alias("end"),
    )
    met = lengths.join(read, "fight", "left")
    truncated = F.coalesce(F.col("end.more"), F.lit(True))
    reached = F.when(F.col("last").isNull(), 0).when(truncated, F.least(F.col("last") - F.col("begin"), "length")).otherwise(F.col("length"))
    out = met.select("fight", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("events", F.lit(0)).alias("events"), reached.alias("reached"), truncated.alias("truncated"), "length")
    coverage = F.when(F.col("length") > 0, F.round(F.least(F.col("reached") / F.col("length"), F.lit(1.0)), 4)).otherwise(F.lit(0.0))
    return out.withColumn("coverage", coverage).withColumn("complete", F.col("coverage") >= LEAST_COVERAGE).drop("length")


def searched(pages: DataFrame, group: str, limit: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(codes, ends) of searches by page: pages has the group, page from 1, limit and found, an array of codes.

    A search reads page after page and ends at an empty or missing page, or behind one of fewer codes than the limit;
    if neither comes within `most` pages, it is truncated. codes: group, code and the first page it stands on. ends:
    group, pages (an empty one that was asked for counts) and truncated. A group is `most` rows here, in one pass.
    """
    size = F.coalesce(F.size("found"), F.lit(0))
    order = W.partitionBy(group).orderBy("page")
    is_next = F.col("page") == F.row_number().over(order)
    marked = pages.where(F.col("page") <= most).withColumn("goes_on", is_next & (size >= F.col(limit)) & (size > 0)).withColumn("has_any", is_next & (size > 0))
    before = F.coalesce(F.min("goes_on").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    marked = marked.withColumn("asked", before).withColumn("read", before & F.col("has_any"))
    ends = marked.groupBy(group).agg(F.count_if("read").alias("full"), F.bool_and(F.when(F.col("read"), F.col("goes_on"))).alias("all_full"))
    # behind the last full page one more is asked for, unless there were `most`
    on = F.coalesce("all_full", F.lit(True))
    ends = ends.select(group, F.least(F.col("full") + F.when(on, 1).otherwise(0), F.lit(most)).alias("pages"), (on & (F.col("full") == most)).alias("truncated"))
    codes = marked.where("read").select(group, "page", F.explode("found").alias("code")).groupBy(group, "code").agg(F.min("page").alias("page"))
    return codes, ends
