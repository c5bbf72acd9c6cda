"""Ranked lexical search: an inverted index in shards, and MaxScore in each of them.

The index is built in one pass over the documents, without a shuffle: a task closes a shard after SHARD_TERMS terms
and writes a row for each term of it (its documents' places in the shard, how often each holds the term, the most of
those numbers and the least length of such a document), and one row with the shard's documents and their lengths.

A search knows the weight of a term once its lists are counted over all shards. In a shard each list has an upper
bound: its weight times what a document would get that holds the term as often as any does and is as short as any
that holds it. An item's lists are taken by falling bound. While the bounds of the lists not yet taken could together
still reach the tenth best score, the list is essential and all its documents are scored; from then on lists are
non-essential: a document that none of the essential lists holds can't be among the ten, and the others are looked up
in the rest only while their score and the rest's bounds reach the tenth best. The tenth best score counts what the
task has found in the shards before. Nothing is lost: a document goes only when it can't qualify, ties included.

Items are searched in blocks of at most BLOCK_TERMS (item, term) rows, whose terms and weights are sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gaugeworks.llm.common import pick, raw_texts, slices
from gaugeworks.session import checkpointed

TOP, SHARD_TERMS, BLOCK_TERMS, SALTS = 10, 1 << 21, 400_000, 32
#: Fixed values of the score: an item's term gets weight * ((SCALE * tf) div (1000 * tf + 8 * m)), where m of a
#: document is 25 plus 75 times its length over the mean length.
SCALE, FLAT, SLOPE = 1_000_000_000, 25, 75
#: Terms are runs of any code points but ASCII signs; only A-Z are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256)).lower()
NO_ID = -(1 << 63)
KINDS = "kind string, shard long, term string, docs binary, counts binary, n_docs long, n_terms long, most long, least long"


class _Numbers(dict):
    """The next free number for each new term."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Consecutive parts of an array of unsigned 32-bit numbers, each as one binary."""
    raw = values.astype("<u4").tobytes()
    ends = np.r_[starts, len(values)].astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])


def shard_rows(shard: int, names: list[int | None], found: list[np.ndarray], terms: dict[bytes, int]) -> pa.RecordBatch:
    """The rows of one shard: its documents first, then a list for each term, in the terms' order."""
    lengths = np.array([len(x) for x in found], np.int64)
    order = sorted(terms, key=terms.__getitem__)
    by_name = np.array(sorted(range(len(order)), key=order.__getitem__), np.int64)
    rank = np.empty(len(order), np.uint64)
    rank[by_name] = np.arange(len(order), dtype=np.uint64)
    place = np.repeat(np.arange(len(found), dtype=np.uint64), lengths)
    pairs, tf = np.unique(rank[np.concatenate(found)] << np.uint64(32) | place, return_counts=True)
    docs = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, np.diff(pairs >> np.uint64(32)) > 0])
    steps = np.diff(docs, prepend=0)
    steps[starts] = docs[starts]
    n = len(starts) + 1
    ids = np.array([NO_ID if i is None else i for i in names], "<i8").tobytes()
    columns = [
        pa.array(["docs"] + ["lists"] * (n - 1)),
        pa.array(np.full(n, shard, np.int64)),
        pa.array([None, *(order[k].decode() for k in by_name)], pa.string()),
        pa.concat_arrays([pa.array([ids], pa.binary()), _binaries(steps, starts)]),
        pa.concat_arrays([pa.array([lengths.astype("<u4").tobytes()], pa.binary()), _binaries(tf, starts)]),
        pa.array(np.r_[len(found), np.diff(np.r_[starts, len(docs)])]),
        pa.array(np.r_[lengths.sum(), np.add.reduceat(tf, starts)]),
        pa.array(np.r_[lengths.max(), np.maximum.reduceat(tf, starts)]),
        pa.array(np.r_[lengths.min(), np.minimum.reduceat(lengths[docs], starts)]),
    ]
    return pa.RecordBatch.from_arrays(columns, ["kind", "shard", "term", "docs", "counts", "n_docs", "n_terms", "most", "least"])


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS) -> None:
    """Write the index of all whole texts as a table at path, with folders for documents and lists.

    A null text, or one without a term, is in no list. Rows that repeat an id are documents of their own; a null id is
    kept. Other columns aren't read. An empty table writes no shard.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 20
        names: list[int | None] = []
        found: list[np.ndarray] = []
        terms = _Numbers()
        held = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for i, text in zip(part.column("doc_id").to_pylist(), raw_texts(part, "text"), strict=True):
                    words = text.translate(_PARTED).split()
                    if not words:
                        continue
                    names.append(i)
                    found.append(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)))
                    held += len(words)
                    if held >= shard_terms:
                        yield from _parts(shard_rows(shard, names, found, terms))
                        shard, names, found, terms, held = shard + 1, [], [], _Numbers(), 0
        if names:
            yield from _parts(shard_rows(shard, names, found, terms))

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows.mapInArrow(work, KINDS).write.partitionBy("kind").option("compression", "zstd").parquet(path)


def _parts(rows: pa.RecordBatch, each: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, each):
        yield rows.slice(at, each)


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times) of the terms of every item. Rows that repeat an id are one item; null has no term."""
    low = F.translate("text", UPPER, LOWER)
    words = pick(items, item_id=id_col, text=text_col).select("item_id", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term"))
    return words.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Lists of one shard, decoded when first looked at."""

    def __init__(self, ids: bytes, lengths: bytes, n_docs: int, n_terms: int):
        """n_docs and n_terms: of the whole corpus, for the mean length."""
        self.ids = np.frombuffer(ids, "<i8")
        self.mean = n_docs, n_terms
        self.m = self.length_part(np.frombuffer(lengths, "<u4").astype(np.int64))
        self.raw: dict[str, tuple[bytes, bytes, int, int]] = {}
        self.open: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.sum = np.zeros(len(self.ids), np.int64)

    def length_part(self, n):
        return FLAT + SLOPE * n * self.mean[0] // self.mean[1]

    def bound(self, term: str) -> int:
        most, least = self.raw[term][2:]
        return SCALE * most // (1000 * most + 8 * int(self.length_part(least)))

    def postings(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores, before the weight, of the documents that hold a term."""
        if term not in self.open:
            steps, counts = self.raw[term][:2]
            at = np.cumsum(np.frombuffer(steps, "<u4"), dtype=np.int64)
            tf = np.frombuffer(counts, "<u4").astype(np.int64)
            self.open[term] = at, SCALE * tf // (1000 * tf + 8 * self.m[at])
        return self.open[term]

    def best(self, wanted: list[tuple[str, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of documents that include all whose score over wanted, (term, weight), is among the TOP of
        this shard and at least `least`, which is 1 or more."""
        lists = sorted(((w * self.bound(t), t, w) for t, w in wanted if t in self.raw and w > 0), reverse=True)
        rest = np.cumsum([b for b, _, _ in lists][::-1])[::-1].tolist() + [0]
        taken = 0
        while taken < len(lists) and rest[taken] >= least:
            at, score = self.postings(lists[taken][1])
            self.sum[at] += lists[taken][2] * score
            taken += 1
            if taken & (taken - 1) == 0 and taken < len(lists):  # after 1, 2, 4, 8, ... lists
                partial = self.sum[self.sum >= least]
                if len(partial) >= TOP:
                    least = max(least, int(np.partition(partial, -TOP)[-TOP]))
        alive = np.flatnonzero(self.sum)
        for k in range(taken, len(lists)):
            alive = alive[self.sum[alive] + rest[k] >= least]
            if not len(alive):
                break
            at, score = self.postings(lists[k][1])
            near = np.minimum(np.searchsorted(at, alive), len(at) - 1)
            hit = at[near] == alive
            self.sum[alive[hit]] += lists[k][2] * score[near[hit]]
        alive = alive[self.sum[alive] >= least]
        out = self.ids[alive], self.sum[alive]
        self.sum[:] = 0
        return out


def _first(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TOP by score, equal scores by id; a missing id comes last."""
    order = np.lexsort((ids, ids == NO_ID, -scores))[:TOP]
    return ids[order], scores[order]


def search(spark: SparkSession, path: str, items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the ten documents of the index at path that score highest, or all
    with a score above 0 if there are fewer. Equal scores go by ascending id, a null id last.

    An item with no term, or none that a document holds, has no row; so has any if the index is empty.
    """
    kind = dict(items.dtypes)[id_col]
    index = spark.read.schema(KINDS).parquet(path)
    shards, lists = index.where("kind = 'docs'"), index.where("kind = 'lists'")
    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    terms = checkpointed(query_terms(items, id_col, text_col))
    n_blocks = -(-terms.count() // block_terms)
    dealt = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, n_blocks))))
    found = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    for block in range(n_blocks if n_docs else 0):
        own = dealt.where(F.col("block") == block)
        names = F.broadcast(own.select("term").distinct())  # no more than a block's rows
        held = lists.join(names, "term", "left_semi")
        df = held.groupBy("term").agg(F.sum("n_docs").alias("df"))
        wanted: dict = {}
        for item, term, times, n in own.join(df, "term").select("item_id", "term", "times", "df").collect():  # a block's rows at most
            wanted.setdefault(item, []).append((term, times * weight(n_docs, n)))
        sent = spark.sparkContext.broadcast((n_docs, n_terms, wanted))
        rows = shards.unionByName(held.select(shards.columns)).select("shard", "term", "docs", "counts", "most", "least")
        dealt_rows = rows.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))
        found = found.union(checkpointed(dealt_rows.mapInArrow(_searcher(sent, kind), f"item_id {kind}, doc_id long, score long")))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    near = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.Window.partitionBy("item_id", "salt").orderBy(*order)))
    near = near.where(F.col("rank") <= TOP).select("item_id", "doc_id", "score")
    ranked = near.withColumn("rank", F.row_number().over(W.Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= TOP)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _searcher(sent, kind: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    item_type = to_arrow_type(DataType.fromDDL(kind))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, n_terms, wanted = sent.value
        best: dict = {}
        shard: Shard | None = None

        def settle() -> None:
            for item, terms in wanted.items():
                ids, scores = best.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                new_ids, new_scores = shard.best(terms, int(scores[-1]) if len(scores) == TOP else 1)
                if len(new_ids):
                    best[item] = _first(np.r_[ids, new_ids], np.r_[scores, new_scores])

        for batch in batches:
            for term, docs, counts, most, least in zip(*(batch.column(c).to_pylist() for c in ("term", "docs", "counts", "most", "least")), strict=True):
                if term is not None:
                    shard.raw[term] = docs, counts, most, least
                    continue
                if shard:
                    settle()
                shard = Shard(docs, counts, n_docs, n_terms)
        if shard:
            settle()
        for item, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), item_type), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], ["item_id", "doc_id", "score"])

    return work
