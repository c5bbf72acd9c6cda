"""Order-preserving packing: where to cut the stream of documents into sequences.

Documents are taken in doc_id order, and their ids are one long stream. A cut may fall at the end of a document
(no penalty), at the end of a sentence (SENTENCE_CUT) or, where no such end comes for HARD_EVERY ids, after
that many (HARD_CUT). Among all choices of cuts no more than `window` ids apart, the one with the least sum of
padding and penalties is found: with f(j) the least cost up to cut j at position p(j),

    f(j) = penalty(j) + window - p(j) + min { f(i) + p(i) : p(j) - p(i) <= window },

whose minimum over a sliding range is at the head of a monotone queue, so the time is linear in the cuts.
Sequences whose length is a power of two of at least window / 8 count as unpadded. Tasks hold ranges of
doc_id and settle the stream every SEGMENT_TOKENS ids, so the cost of the last sequence of a segment is small.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gaugeworks.llm.common import slices
from gaugeworks.llm.token_files import in_id_order
from gaugeworks.llm.words import sentence_ends, word_ids

SENTENCE_CUT, HARD_CUT, HARD_EVERY, SEGMENT_TOKENS = 4, 32, 64, 1 << 18


def cut_points(doc_ends: np.ndarray, sentence_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the stream may be cut, and the penalty of each."""
    ends = np.union1d(doc_ends, sentence_at)
    gaps = np.diff(ends, prepend=0)
    fill = (gaps - 1) // HARD_EVERY
    nth = np.arange(fill.sum()) - np.repeat(np.cumsum(fill) - fill, fill) + 1
    hard = np.repeat(ends - gaps, fill) + nth * HARD_EVERY
    at = np.union1d(ends, hard)
    penalty = np.full(len(at), HARD_CUT)
    penalty[np.searchsorted(at, ends)] = SENTENCE_CUT
    penalty[np.searchsorted(at, doc_ends)] = 0
    return at, penalty


def unpadded_lengths(window: int) -> list[int]:
    """Powers of two below the window that are long enough to be worth a sequence."""
    return [1 << k for k in range(window.bit_length()) if window // 8 <= 1 << k < window]


def best_cuts(at: list[int], penalty: list[int], window: int) -> list[int]:
    """Positions of the cheapest cuts; the last is the last of at. No two of 0 and at may lie over window apart."""
    free = unpadded_lengths(window)
    place = [0, *at]
    index = {p: i for i, p in enumerate(place)}
    cost, back = [0] * len(place), [0] * len(place)
    reach = [0] * len(place)  # f(i) + p(i)
    queue = deque([0])
    for j in range(1, len(place)):
        p = place[j]
        while p - place[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        least = reach[i] + window - p
        for length in free:
            k = index.get(p - length)
            if k is not None and cost[k] < least:
                i, least = k, cost[k]
        cost[j], back[j] = least + penalty[j - 1], i
        reach[j] = cost[j] + p
        while queue and reach[queue[-1]] >= reach[j]:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(place) - 1
    while j:
        cuts.append(place[j])
        j = back[j]
    return cuts[::-1]


def _pieces(names: list[int | None], texts: list[bytes], enders: np.ndarray, window: int, first: int) -> tuple[pa.RecordBatch, int]:
    """A row for each piece of a segment; the number of its sequences. first: the id of its first sequence."""
    counts = np.array([len(t) // 4 for t in texts])
    raw = b"".join(texts)
    ids = np.frombuffer(raw, "<u4")
    doc_ends = np.cumsum(counts)
    at, penalty = cut_points(doc_ends, np.flatnonzero(np.isin(ids, enders)) + 1)
    cuts = np.array(best_cuts(at.tolist(), penalty.tolist(), window))
    ends = np.union1d(cuts, doc_ends)
    begins = np.r_[0, ends[:-1]]
    doc, seq = np.searchsorted(doc_ends, begins, side="right"), np.searchsorted(cuts, begins, side="right")
    columns = {
        "doc_id": pa.array([names[d] for d in doc], pa.int64()),
        "start": pa.array(begins - (doc_ends - counts)[doc]),
        "length": pa.array(ends - begins),
        "doc_tokens": pa.array(counts[doc]),
        "sequence_id": pa.array(seq + first),
        "offset": pa.array(begins - np.r_[0, cuts][seq]),
        "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns), len(cuts)


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start (the document's ids before it), length, doc_tokens, sequence_id,
    offset (ids of the sequence before it), ids (little-endian unsigned 32-bit).

    A null or empty text is end_id alone. A null id sorts first. Rows that repeat an id are packed as documents
    of their own. A text longer than the window is cut; each id lies in exactly one piece. An empty table gives
    no rows. sequence_id numbers the sequences of a task from its partition's number times 2 ** 33.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, enders, first = word_ids(tokenizer), sentence_ends(tokenizer), TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()
        names: list[int | None] = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for part in slices(batch, "text", 8_000_000):
                for i, text in zip(part.column("doc_id").to_pylist(), words.texts(part.column("text")), strict=True):
                    names.append(i)
                    texts.append(text + end)
                    held += len(texts[-1]) // 4
                    if held >= SEGMENT_TOKENS:
                        rows, n = _pieces(names, texts, enders, window, first)
                        yield rows
                        first, held, names, texts = first + n, 0, [], []
        if names:
            yield _pieces(names, texts, enders, window, first)[0]

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return in_id_order(docs, id_col, text_col).mapInArrow(work, schema)
