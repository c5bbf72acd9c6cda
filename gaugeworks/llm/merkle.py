"""Document fingerprints: a Merkle tree over sections, paragraphs and what they consist of.

The leaves of a text are its tokens, a word with the white space after it. Level by level they are joined to nodes of
some four children: a sentence ends a node of level SENTENCE and below, a line feed (a paragraph) one of PARAGRAPH, a
blank line (a section) one of SECTION, and where no such end comes, nodes end after tokens that a hash of two
neighbours chooses, so that what stands elsewhere in the text doesn't move the ends. A node's digest is that of its
children's digests. The root tests equality; where roots differ, equal nodes are skipped and only differing branches
are followed down to the edit.

A fingerprint is a text: the root, and the nodes of the finest level of at most MOST_NODES nodes and of all above it,
each as five hex digits of its digest and four of its length. Where that level has under FEW_NODES nodes, the one below
is added if it has no more than four times MOST_NODES; below the tokens are the single characters. Two fingerprints
are compared at the finest level that both hold: likeness is twice the code points in equal nodes over those of both
texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gaugeworks.llm.common import pick, slices
from gaugeworks.session import checkpointed, scratch_path

SENTENCE, PARAGRAPH, SECTION, TOP_LEVEL, MOST_NODES, FEW_NODES, MOST_BRANCHES = 3, 4, 5, 14, 64, 12, 2000
TOKEN = re.compile(r"[^\x20\x09-\x0D]{1,12}[\x20\x09-\x0D]{0,12}|[\x20\x09-\x0D]{1,12}")
_LEAF = np.dtype([("digest", "V16"), ("ends", "u1"), ("chars", "u1")])
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]


class _Leaves(dict):
    """Digest, highest level of which it ends a node, and length of each token; forgets all at `most` tokens, some
    60 MB a worker."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, token: str) -> bytes:
        lines = token.count("\n")
        word = token.rstrip()
        ends = SECTION if lines > 1 else PARAGRAPH if lines else SENTENCE if word != token and word.endswith((".", "!", "?")) else 1
        if len(self) >= self.most:
            self.clear()
        self[token] = out = xxhash.xxh3_128_digest(token.encode()) + bytes((ends, len(token)))
        return out


_leaves = _Leaves()


def _node_ends(leaves: np.ndarray) -> np.ndarray:
    """Of each token the highest level of which it ends a node."""
    low = np.frombuffer(leaves["digest"].tobytes(), "<u8")[::2]
    x = low * _MIX[0] + np.r_[np.uint64(0), low[:-1]] * _MIX[1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[2]
    x ^= x >> np.uint64(32)
    ends = leaves["ends"].copy()
    for level in range(2, TOP_LEVEL + 1):
        chosen = x < np.uint64(1 << (64 - 2 * (level - 1)))
        if not chosen.any():
            break
        np.maximum(ends, np.where(chosen, level, 0).astype(np.uint8), out=ends)
    for level in range(TOP_LEVEL, 1, -1):  # runs that repeat may have no chosen end
        size = 4 ** (level - 1)
        if len(ends) <= 8 * size:
            continue
        stops = np.r_[-1, np.flatnonzero(ends >= level), len(ends)]
        for k in np.flatnonzero(np.diff(stops) > 8 * size):
            part = ends[stops[k] + size : stops[k + 1] : size]
            np.maximum(part, level, out=part)
    return ends


class Tree:
    """levels: of level 1 (tokens) and up to the one with a single node, digests, 16 bytes each, and lengths in code
    points; stops: for each level but the first, the number of children up to the end of each node."""

    def __init__(self, text: str):
        self.n_chars = len(text)
        self.text = text if len(text) <= 4 * MOST_NODES else ""
        leaves = np.frombuffer(b"".join(map(_leaves.__getitem__, TOKEN.findall(text))), _LEAF)
        digests, chars = leaves["digest"].tobytes(), leaves["chars"].astype(np.int64)
        self.levels = [(digests, chars)]
        self.stops: list[np.ndarray] = []
        ends = _node_ends(leaves)
        level = 1
        while len(ends) > 1 and level < TOP_LEVEL:
            level += 1
            is_end = ends >= level
            is_end[-1] = True
            stops = np.flatnonzero(is_end) + 1
            starts = np.r_[0, stops[:-1]]
            digests = b"".join([xxhash.xxh3_128_digest(digests[a:b]) for a, b in zip((16 * starts).tolist(), (16 * stops).tolist(), strict=True)])
            chars = np.add.reduceat(chars, starts)
            ends = ends[is_end]
            self.levels.append((digests, chars))
            self.stops.append(stops)
        self.root = hashlib.blake2b(self.levels[-1][0] + str(self.n_chars).encode(), digest_size=16).hexdigest()

    def fingerprint(self) -> str:
        sizes = [len(self.text) or self.n_chars, *(len(chars) for _, chars in self.levels)]
        finest = next((level for level, n in enumerate(sizes) if n <= MOST_NODES), len(sizes) - 1)
        if finest and sizes[finest] < FEW_NODES and sizes[finest - 1] <= 4 * MOST_NODES:
            finest -= 1
        out = [self.root]
        if finest == 0 and self.text:
            out.append("0" + "".join([f"{ord(c) & 0xFFFFF:05x}0001" for c in self.text]))
        for level, (digests, chars) in enumerate(self.levels, 1):
            if level >= finest and len(chars):
                names = digests.hex()
                out.append(f"{level:x}" + "".join([f"{names[32 * k : 32 * k + 5]}{n:04x}" for k, n in enumerate(np.minimum(chars, 0xFFFF).tolist())]))
        return ":".join(out)


def compare(a: str, b: str) -> float:
    """Likeness, from 0 to 1, of two fingerprints. At the levels of characters and tokens, so for short texts, nodes are
    compared from both ends; above them as multisets. Texts whose lengths lie far apart hold no
    level in common and count as unlike."""
    root_a, *levels_a = a.split(":")
    root_b, *levels_b = b.split(":")
    if root_a == root_b:
        return 1.0
    at = max(levels_a[0][0] if levels_a else "~", levels_b[0][0] if levels_b else "~")
    x, y = (next((p[1:] for p in levels if p[0] == at), "") for levels in (levels_a, levels_b))
    if not x or not y:
        return 0.0
    x, y = ([p[k : k + 9] for k in range(0, len(p), 9)] for p in (x, y))
    if at <= "1":
        short = min(len(x), len(y))
        head = next((k for k in range(short) if x[k] != y[k]), short)
        tail = next((k for k in range(short - head) if x[-1 - k] != y[-1 - k]), short - head)
        both = x[:head] + x[len(x) - tail :]
    else:
        both = (Counter(x) & Counter(y)).elements()
    chars = lambda nodes: sum(int(p[5:], 16) for p in nodes)
    return 2 * chars(both) / (chars(x) + chars(y))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two columns of fingerprints; null if either is null."""

    def work(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if i is None or j is None else compare(i, j) for i, j in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(work, "double")(a, b)


def differing(before: Tree, after: Tree) -> list[tuple[int, int, int, int]]:
    """Spans (start, end) of code points in both texts that differ, in order. Equal branches aren't looked into; a
    differing pair of branches of over MOST_BRANCHES children on both sides is one span."""
    if before.root == after.root:
        return []
    out: list[tuple[int, int, int, int]] = []
    top = min(len(before.levels), len(after.levels))
    names = [[[d[k : k + 16] for k in range(0, len(d), 16)] for d, _ in t.levels] for t in (before, after)]
    ends = [[np.r_[0, np.cumsum(n)].tolist() for _, n in t.levels] for t in (before, after)]

    def below(tree: Tree, level: int, a: int, b: int) -> tuple[int, int]:
        stops = tree.stops[level - 2]
        return (int(stops[a - 1]) if a else 0), (int(stops[b - 1]) if b else 0)

    def follow(level: int, a0: int, a1: int, b0: int, b1: int) -> None:
        x, y = names[0][level - 1][a0:a1], names[1][level - 1][b0:b1]
        whole = level < top and min(len(x), len(y)) > MOST_BRANCHES
        blocks = [("replace", 0, len(x), 0, len(y))] if whole else SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        for tag, i0, i1, j0, j1 in blocks:
            if tag == "equal":
                continue
            if level == 1 or whole or i0 == i1 or j0 == j1:
                at = ends[0][level - 1], ends[1][level - 1]
                out.append((at[0][a0 + i0], at[0][a0 + i1], at[1][b0 + j0], at[1][b0 + j1]))
            else:
                follow(level - 1, *below(before, level, a0 + i0, a0 + i1), *below(after, level, b0 + j0, b0 + j1))

    follow(top, 0, len(names[0][top - 1]), 0, len(names[1][top - 1]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, root, fingerprint) of every whole text; null counts as empty. Equal texts, and for all that
    matters no others, have equal roots. Other columns aren't read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                trees = [Tree(t or "") for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), pa.array([t.n_chars for t in trees]), pa.array([t.root for t in trees]), pa.array([t.fingerprint() for t in trees])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "root", "fingerprint"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, n_chars long, root string, fingerprint string")


def edits(before: DataFrame, after: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, new_start, new_end): where the texts of two versions of a corpus differ, as spans of code
    points. Rows meet by id, null ids among themselves; ids are taken to be unique in each table. An id that only one
    table has is an edit of its whole text."""
    one = pick(before, doc_id=id_col, text=text_col).select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("old"))
    two = pick(after, doc_id=id_col, text=text_col).select(F.col("doc_id").alias("j"), F.coalesce("text", F.lit("")).alias("new"))
    met = one.join(two, F.col("i").eqNullSafe(F.col("j")), "full").where("NOT old <=> new")
    met = met.select(F.coalesce("i", "j").alias("doc_id"), F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "old"):
                for i, old, new in zip(*(part.column(c) for c in ("doc_id", "old", "new")), strict=True):
                    spans = differing(Tree(old.as_py()), Tree(new.as_py()))
                    columns = [pa.array([i.as_py()] * len(spans), i.type), *(pa.array([s[k] for s in spans], pa.int64()) for k in range(4))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "new_start", "new_end"])

    return met.mapInArrow(work, f"doc_id {dict(met.dtypes)['doc_id']}, start long, end long, new_start long, new_end long")


_HALF = "part int, kind int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
_RESULT = [f.split()[0] for f in _HALF.split(", ")[2:-1]]


def _half_row(doc_id: int | None, text: str, fp: str, following: str, following_fp: str) -> tuple:
    """The result of one document, its second half replaced by the beginning of the following text."""
    cut = len(text) // 2
    edited = text[: len(text) - cut] + following[:cut]
    edited_fp = fp if edited == text else Tree(edited).fingerprint()
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp, edited_fp, compare(fp, edited_fp), compare(fp, following_fp)


def half_replaced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document:
    how its fingerprint compares with that of an edited text, whose last half (rounded down) is replaced by as much of
    the beginning of the next document, and with that of the next document.

    The order is by id, null first, and of rows that repeat an id by a hash of the text; the last document is followed
    by the first. A null text is empty. An empty table gives no rows. Other columns aren't read.

    Texts are dealt out once, by ranges of that order, and a task holds two of them at a time. The last document of a
    range waits for the first of the next: these two rows a range are written with the results and joined afterwards.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # rows that repeat id and text have any order, and the last column deals them out too
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("spread"))
    ranges = rows.repartitionByRange("doc_id", "tie", "spread").sortWithinPartitions("doc_id", "tie", "spread").select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, last = TaskContext.get().partitionId(), None
        nothing = (None,) * 6
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                out = []
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    fp = Tree(text).fingerprint()
                    out.append((part_id, 0, *_half_row(*last, text, fp), None) if last else (part_id, 1, i, *nothing, text))
                    last = i, text, fp
                yield _batch(out)
        if last:
            yield _batch([(part_id, 2, last[0], *nothing, last[1])])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
                row = _half_row(i, text, Tree(text).fingerprint(), following, Tree(following).fingerprint())
                yield _batch([(0, 0, *row, None)]).select(_RESULT)

    path = scratch_path(docs.sparkSession, "half-replaced")
    ranges.mapInArrow(work, _HALF).write.option("compression", "zstd").parquet(path)
    done = docs.sparkSession.read.schema(_HALF).parquet(path)
    ends = checkpointed(done.where("kind > 0").select("part", "kind", "doc_id", "text"))  # two rows for each range
    order = W.Window.orderBy("part")
    after = ends.where("kind = 1").select("part", F.lead("part").over(order).alias("next"), F.min("part").over(W.Window.partitionBy()).alias("least"))
    first = ends.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    waiting = ends.where("kind = 2").join(after.select("part", F.coalesce("next", "least").alias("next")), "part").join(first.hint("merge"), "next")
    kinds = ", ".join(f for f in _HALF.split(", ") if f.split()[0] in _RESULT)
    return done.where("kind = 0").select(*_RESULT).union(waiting.select("doc_id", "text", "following").mapInArrow(settle, kinds))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in _HALF.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])
