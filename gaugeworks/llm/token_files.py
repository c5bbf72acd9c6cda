"""Token ids in patched frame-of-reference segments.

Documents are dealt out by ranges of doc_id and encoded in that order. Each task writes its part (a shard) as
segments of about SEGMENT_TOKENS ids, whole documents each. A segment is one binary value, laid out so:

    "PFR1", then as little-endian unsigned 32-bit numbers: documents d, ids n, blocks b
    d signed 64-bit document ids (the smallest number stands for null), d unsigned 64-bit counts of ids
    b + 1 unsigned 64-bit block starts, in bytes from the first block: the index
    b blocks of up to BLOCK ids each

A block holds its minimum (32 bits), a width w (8 bits) and a number of exceptions e (8 bits), then the low w
bits of each id's distance from the minimum as w planes of BLOCK bits, then e positions (8 bits each), then the
rest of e distances, shifted right by w (32 bits each). w is the width that PERCENTILE of the block's distances
fit in. Segments are rows of a Parquet table, so Spark's own writer commits them and any task can read any one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.llm.common import pick, slices
from gaugeworks.llm.words import word_ids

MAGIC, BLOCK, PERCENTILE, SEGMENT_TOKENS, NO_ID = b"PFR1", 128, 90, 1 << 20, -(1 << 63)
PLANE = BLOCK // 8
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("odd", "u1")])


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bits that each unsigned 32-bit number needs; exact, since a double holds 53."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The index (starts of all blocks, and the end) and the blocks."""
    n = len(ids)
    if not n:
        return np.zeros(1, "<u8"), b""
    b = -(-n // BLOCK)
    grid = np.full(b * BLOCK, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(b, BLOCK)
    low = grid.min(1)
    grid = grid - low[:, None]
    need = _bit_length(grid)
    width = np.partition(need, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    odd_block, odd_at = np.nonzero(need > width[:, None])
    odd = np.bincount(odd_block, minlength=b)
    size = HEAD.itemsize + width.astype(np.int64) * PLANE + odd * 5
    start = np.r_[0, np.cumsum(size)]
    out = np.zeros(start[-1], np.uint8)
    head = np.zeros(b, HEAD)
    head["low"], head["width"], head["odd"] = low, width, odd
    out[start[:-1, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(b, -1)
    for k in range(int(width.max())):
        has = np.flatnonzero(width > k)
        plane = np.packbits((grid[has] >> np.uint32(k) & 1).astype(np.uint8), axis=1, bitorder="little")
        out[(start[has] + HEAD.itemsize + k * PLANE)[:, None] + np.arange(PLANE)] = plane
    if len(odd_block):
        nth = np.arange(len(odd_block)) - np.repeat(np.cumsum(odd) - odd, odd)
        list_at = start[odd_block] + HEAD.itemsize + width[odd_block].astype(np.int64) * PLANE
        out[list_at + nth] = odd_at
        rest = grid[odd_block, odd_at].astype(np.uint64) >> width[odd_block].astype(np.uint64)
        value = rest.astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(list_at + odd[odd_block] + 4 * nth)[:, None] + np.arange(4)] = value
    return start.astype("<u8"), out.tobytes()


def unpack_blocks(start: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of the blocks that start at `start` (the last entry is their end) in data (bytes)."""
    b = len(start) - 1
    if b <= 0:
        return np.zeros(0, "<u4")
    at = start[:-1].astype(np.int64)
    head = data[at[:, None] + np.arange(HEAD.itemsize)].copy().view(HEAD).reshape(b)
    width, odd = head["width"].astype(np.int64), head["odd"].astype(np.int64)
    grid = np.zeros((b, BLOCK), np.uint32)
    for k in range(int(width.max())):
        has = np.flatnonzero(width > k)
        plane = data[(at[has] + HEAD.itemsize + k * PLANE)[:, None] + np.arange(PLANE)]
        grid[has] |= np.unpackbits(plane, axis=1, bitorder="little").astype(np.uint32) << np.uint32(k)
    if odd.any():
        block = np.repeat(np.arange(b), odd)
        nth = np.arange(len(block)) - np.repeat(np.cumsum(odd) - odd, odd)
        list_at = at[block] + HEAD.itemsize + width[block] * PLANE
        value = data[(list_at + odd[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
        grid[block, data[list_at + nth]] |= (value.astype(np.uint64) << width[block].astype(np.uint64)).astype(np.uint32)
    return (grid + head["low"][:, None]).reshape(-1)[:n].astype("<u4")


def write_segment(doc_ids: list[int | None], texts: list[bytes]) -> bytes:
    """texts: each document's ids, little-endian unsigned 32-bit."""
    ids = np.frombuffer(b"".join(texts), "<u4")
    start, blocks = pack_blocks(ids)
    head = np.array([len(doc_ids), len(ids), len(start) - 1], "<u4").tobytes()
    names = np.array([NO_ID if i is None else i for i in doc_ids], "<i8").tobytes()
    counts = np.array([len(t) // 4 for t in texts], "<u8").tobytes()
    return b"".join([MAGIC, head, names, counts, start.tobytes(), blocks])


class Segment:
    """A segment's documents, and its ids by position without unpacking other blocks."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        docs, self.n_ids, blocks = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
        self.doc_ids = np.frombuffer(data, "<i8", docs, 16)
        self.counts = np.frombuffer(data, "<u8", docs, 16 + 8 * docs).astype(np.int64)
        self.start = np.frombuffer(data, "<u8", blocks + 1, 16 + 16 * docs)
        self.data = np.frombuffer(data, np.uint8, -1, 16 + 16 * docs + 8 * (blocks + 1)) if blocks else np.zeros(0, np.uint8)

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else min(end, self.n_ids)
        if first >= end:
            return np.zeros(0, "<u4")
        a, b = first // BLOCK, -(-end // BLOCK)
        return unpack_blocks(self.start[a : b + 1], self.data, (b - a) * BLOCK)[first - a * BLOCK : end - a * BLOCK]


def in_id_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt out by ranges of doc_id and sorted; rows that repeat an id follow the order of their texts."""
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, each followed by end_id, as a table of segments at path.

    Columns: shard and start (ids of the shard before this segment), n_docs, n_tokens, payload. A null or empty
    text is end_id alone. A null id sorts first. An empty table writes no segment.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, start = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        names: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            row = [[shard], [start], [len(names)], [held], [write_segment(names, texts)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["shard", "start", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for part in slices(batch, "text", 8_000_000):
                for i, text in zip(part.column("doc_id").to_pylist(), words.texts(part.column("text")), strict=True):
                    names.append(i)
                    texts.append(text + end)
                    held += len(texts[-1]) // 4
                    if held >= SEGMENT_TOKENS:
                        yield flush()
                        start, held, names, texts = start + held, 0, [], []
        if names:
            yield flush()

    rows = in_id_order(docs, id_col, text_col).mapInArrow(work, "shard int, start long, n_docs long, n_tokens long, payload binary")
    rows.write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: start counts the ids of all documents before it, ids
    holds them as little-endian unsigned 32-bit numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "payload")), strict=True):
                segment = Segment(payload)
                raw, ends = segment.ids().tobytes(), np.cumsum(segment.counts)
                begins = ends - segment.counts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(segment.doc_ids, pa.int64(), mask=segment.doc_ids == NO_ID),
                        pa.array(np.full(len(ends), shard, np.int32)),
                        pa.array(begins + start),
                        pa.array(segment.counts),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "shard", "local", "n_tokens", "ids"],
                )

    segments = spark.read.parquet(path)
    # one row for each shard, so no more rows than tasks wrote
    shards = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.alias("before"))
    docs = segments.select("shard", "start", "payload").mapInArrow(work, "doc_id long, shard int, local long, n_tokens long, ids binary")
    return docs.join(F.broadcast(shards), "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids")
