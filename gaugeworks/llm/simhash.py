"""SimHash near-dedup over a Gray-ordered hierarchical index.

Fingerprints within `limit` of 64 bits of each other agree on whole blocks of bits: cut into b blocks, they
agree on at least b - limit. Each choice of blocks is a bit mask; the bits under the mask are a bucket. Inside
a bucket the fingerprints are sorted by Gray rank, so neighbours share most of their bits. Pages of them, and
groups of pages, keep the pattern of the bits that all members share. A search goes down from pairs of groups,
adds up the differences of shared patterns, and prunes a pair of nodes as soon as these exceed the limit.

Buckets that grow past `bucket_rows` are cut again by blocks of their remaining bits, which is as exact as the
first cut. Nothing is capped: buckets that are still large after `depth` cuts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import join_by_group, pick, raw_texts, slices
from gaugeworks.llm.components import components
from gaugeworks.session import checkpointed

SEED, MIX = 42, 0x9E3779B97F4A7C15


# ---- fingerprints -------------------------------------------------------------------------------------------


def _shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each run of `size` words, A-Z lowered; of the whole sequence if it has fewer; [] without words."""
    words = text.lower().split()
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    runs = zip(*(words[i:] for i in range(size)), strict=False)
    return [xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, runs)]


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, for hashes in rows of one or more 64-bit numbers."""
    bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")
    # a bit is a byte now; eight such bytes are added as one number, which 255 rows can't overflow
    sums = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)
    return sums.view(np.uint8).sum(0, dtype=np.int64)


def _fingerprint(hashes: list[int] | np.ndarray, words: int = 1, block: int = 1 << 14) -> np.ndarray:
    """`words` signed 64-bit numbers, of which a bit is 1 if it is set in over half of the hashes; 0 for none.

    The first number is of the hashes themselves. Each further one is of the hashes times an odd number, mixed.
    """
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), block):
        part = np.array(hashes[at : at + block], "<u8")
        wide = np.empty((len(part), words), "<u8")
        wide[:, 0] = part
        for k in range(1, words):
            mixed = part * np.uint64(pow(MIX, k, 1 << 64))
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(MIX)
            wide[:, k] = mixed ^ (mixed >> np.uint64(29))
        ones += _ones(wide)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed 64-bit number; a null text is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = [_fingerprint(_shingle_hashes(t, words))[0] for t in raw_texts(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(work, "doc_id long, fp long")


# ---- masks --------------------------------------------------------------------------------------------------


def _spread(bits: list[int], parts: int) -> list[int]:
    """The bits dealt into `parts` consecutive blocks, each as a mask."""
    return [sum(1 << int(b) for b in block) for block in np.array_split(np.array(bits, dtype=np.int64), parts)]


def first_masks(n: int, limit: int) -> list[int]:
    """Masks of the first cut: the cheapest number of blocks for n fingerprints.

    With b blocks there are C(b, limit) masks of b - limit blocks. Each costs a shuffled row per fingerprint,
    and about n / 2 ** width comparisons, which are some 200 times as fast. Any choice gives the same links.
    """
    bits = list(range(63, -1, -1))

    def cost(b: int) -> float:
        width = 64 * (b - limit) / b
        return comb(b, limit) * n * (1 + n / 2**width / 200)

    b = min(range(limit + 1, limit + 5), key=cost)
    blocks = _spread(bits, b)
    return [sum(x) for x in combinations(blocks, b - limit)]


def next_masks(mask: int, limit: int) -> list[int]:
    """Masks of one more cut of a bucket whose bits under `mask` agree: limit + 1 blocks of the others."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    return [mask | x for x in _spread(free, limit + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: Column) -> Column:
    """The position of a 64-bit number in Gray order, as a long that sorts as an unsigned number would."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(_signed(1 << 63)))


# ---- search inside buckets ----------------------------------------------------------------------------------


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of each pair of fingerprints, which are rows of one or more numbers."""
    bits = np.bitwise_count(x ^ y)
    return bits[:, 0] if bits.shape[1] == 1 else bits.sum(1, dtype=np.int32)


class _Level:
    """Nodes over consecutive children: the bits that all members share, and their pattern."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.starts, self.ends = starts, ends
        self.low = np.bitwise_and.reduceat(low, starts, axis=0)
        self.high = np.bitwise_or.reduceat(high, starts, axis=0)
        self.same = ~(self.low ^ self.high)

    def near(self, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
        both = self.same[i] & self.same[j]
        return _differing(self.low[i] & both, self.low[j] & both) <= limit


def _nodes(bucket_of: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of at most `fan` consecutive members of one bucket, and the bucket of each."""
    n = len(bucket_of)
    first = np.flatnonzero(np.r_[True, bucket_of[1:] != bucket_of[:-1]])
    at = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    starts = np.flatnonzero(at % fan == 0)
    return starts, np.r_[starts[1:], n], bucket_of[starts]


def _pairs_below(i: np.ndarray, j: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children, a of i and b of j; within one node only a <= b."""
    na, nb = ends[i] - starts[i], ends[j] - starts[j]
    count = na * nb
    pair = np.repeat(np.arange(len(i)), count)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    a = starts[i][pair] + k // nb[pair]
    b = starts[j][pair] + k % nb[pair]
    keep = (i != j)[pair] | (a <= b)
    return a[keep], b[keep]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give each connected set of positions the label of its smallest member, in place."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def linked(bucket: np.ndarray, fp: np.ndarray, limit: int, page: int = 16, chunk: int = 1 << 16) -> np.ndarray:
    """For members sorted by (bucket, Gray rank): the position of the first member that each is connected to
    by links inside its bucket. fp holds unsigned numbers, or rows of them."""
    n = len(fp)
    fp = fp.reshape(n, -1)
    label = np.arange(n)
    leaf_start, leaf_end, leaf_bucket = _nodes(bucket, page)
    top_start, top_end, top_bucket = _nodes(leaf_bucket, page)
    leaves = _Level(leaf_start, leaf_end, fp, fp)
    tops = _Level(top_start, top_end, leaves.low, leaves.high)
    last = np.searchsorted(top_bucket, top_bucket, side="right") if np.all(top_bucket[1:] >= top_bucket[:-1]) else None
    if last is None:  # buckets are in runs but not in order
        change = np.flatnonzero(np.r_[top_bucket[1:] != top_bucket[:-1], True]) + 1
        last = np.repeat(change, np.diff(np.r_[0, change]))
    at = np.arange(len(top_start))
    reach = last - at
    for lo, hi in _chunks(reach, chunk):
        i = np.repeat(at[lo:hi], reach[lo:hi])
        j = i + np.arange(len(i)) - np.repeat(np.cumsum(reach[lo:hi]) - reach[lo:hi], reach[lo:hi])
        keep = tops.near(i, j, limit)
        i, j = i[keep], j[keep]
        for p, q in _chunks((top_end - top_start)[i] * (top_end - top_start)[j], chunk):
            a, b = _pairs_below(i[p:q], j[p:q], top_start, top_end)
            keep = leaves.near(a, b, limit)
            a, b = a[keep], b[keep]
            for r, s in _chunks((leaf_end - leaf_start)[a] * (leaf_end - leaf_start)[b], chunk * 8):
                x, y = _pairs_below(a[r:s], b[r:s], leaf_start, leaf_end)
                open_ = (x < y) & (label[x] != label[y])
                x, y = x[open_], y[open_]
                keep = _differing(fp[x], fp[y]) <= limit
                _merge(label, x[keep], y[keep])
    return label


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges with about `most` in sum, at least one element each."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        yield at, to
        at = to


def _whole_buckets(batches: Iterator[pa.RecordBatch], fields: list[str], least: int = 200_000) -> Iterator[list[np.ndarray]]:
    """The fields of about `least` rows or more at a time, never with a part of a bucket. fields[0] is the bucket."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def arrays(parts):
        return [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]) for c in fields]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= least:
            columns = arrays(held)
            bucket = columns[0]
            cut = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
            if cut:
                yield [x[:cut] for x in columns]
            rest = pa.RecordBatch.from_arrays([pa.array(x[cut:]) for x in columns], fields)
            held, rows = [rest], rest.num_rows
    if rows:
        yield arrays(held)


def _bucket_edges(rows: DataFrame, limit: int, fps: tuple[str, ...] = ("fp",)) -> DataFrame:
    """Edges (u, v) that connect each bucket's members exactly as their links do: at most one per member.
    A wide fingerprint is sorted by the Gray rank of its first number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, node, *words in _whole_buckets(batches, ["bucket", "node", *fps]):
            label = linked(bucket, np.stack(words, axis=1).view(np.uint64), limit)
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["u", "v"])

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", gray_rank(F.col(fps[0])))
    return dealt.select("bucket", "node", *fps).mapInArrow(work, "u long, v long")


def _cut(rows: DataFrame, cuts: dict[int, list[int]]) -> DataFrame:
    """Each row once for every mask that follows its own; the bucket is a hash of the mask and the bits under it.
    Different buckets with one hash are searched together, which costs time and changes no link."""
    pairs = [(_signed(m), _signed(t)) for m, to in cuts.items() for t in to]  # as many as the cuts have masks
    table = rows.sparkSession.createDataFrame(pairs, "mask long, next long")
    rows = rows.join(F.broadcast(table), "mask").drop("mask").withColumnRenamed("next", "mask")
    return rows.withColumn("bucket", F.xxhash64("bucket", "mask", F.col("fp").bitwiseAND(F.col("mask"))))


def link_edges(nodes: DataFrame, limit: int = 4, bucket_rows: int = 20_000, depth: int = 3) -> DataFrame:
    """Edges (u, v) over nodes (node, fp), one row per distinct fp, whose connected components are those of
    all pairs of fingerprints at `limit` or fewer differing bits."""
    count = nodes.count()
    cuts = {0: first_masks(count, limit)}
    rows = nodes.select("node", "fp", F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("bucket"))
    found = []
    for level in range(depth + 1):
        rows = _cut(rows, cuts)
        sizes = rows.groupBy("bucket").count().where(F.col("count") > bucket_rows)
        sizes = checkpointed(sizes)
        if level == depth or sizes.isEmpty():
            found.append(_bucket_edges(rows, limit))
            break
        found.append(_bucket_edges(rows.join(sizes, "bucket", "left_anti"), limit))
        rows = checkpointed(rows.join(sizes.select("bucket"), "bucket", "left_semi"))
        cuts = {m: next_masks(m, limit) for to in cuts.values() for m in to}
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


# ---- the operator -------------------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, limit: int = 4, bucket_rows: int = 20_000
) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id, the smallest doc_id that links of
    `limit` or fewer differing bits reach, itself included.

    A null or empty text has fingerprint zero and is linked like any other. Rows with a null id get a
    fingerprint and the component of their fingerprint, but can't name one. Repeated rows are returned each. An
    empty table gives no rows.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, words))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    found = components(link_edges(nodes.where("node IS NOT NULL"), limit, bucket_rows))
    groups = nodes.join(found, "node", "left").select("fp", "copies", F.coalesce("component", "node").alias("component_id"))
    return join_by_group(fps, checkpointed(groups), "fp", "copies", fps.count()).select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
