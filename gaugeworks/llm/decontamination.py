"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared as words, lower-cased: white space and signs of any script part them, and
in scripts that put no spaces between words each character is one. Runs of MATCH_WORDS
words that both hold, found by running Karp-Rabin hashes, are seeds. Seeds on one diagonal join to maximal
matches; the longest that overlaps no marked word is marked, again and again, until none of MATCH_WORDS words
is left. An item of fewer words is found where all of them stand in a row. The marked tiles may come in any order, so passages whose parts are moved are still covered. An item
is found in a document when tiles cover at least COVERAGE of its words.

The benchmark is sent to the executors in blocks of at most BLOCK_BYTES of text, so what is sent at once is
bounded however large the benchmark is; every block is held against all documents.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from gaugeworks.llm.common import pick, slices
from gaugeworks.llm.words import WordHashes, running_hashes

MATCH_WORDS, COVERAGE, BLOCK_BYTES = 5, 0.5, 16_000_000
FILTER_BITS = 22
#: Letters of scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana and Han.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ODD, _SIGN, _LETTER = re.compile(rf"[^\x00-\x7f\w]|[{_ALONE}]"), re.compile(r"[^\x00-\x7f\w]+"), re.compile(f"([{_ALONE}])")


def parted(text: str | None) -> str | None:
    """A text with a space for each run of signs beyond ASCII, and around each letter of a script without spaces."""
    if not text or text.isascii() or not _ODD.search(text):
        return text
    return _LETTER.sub(r" \1 ", _SIGN.sub(" ", text))


def _begins(doc: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Whether no equal words stand before the positions d and i: a match on their diagonal begins there."""
    inside = (d > 0) & (i > 0)
    return ~inside | (doc[np.where(inside, d - 1, 0)] != item[np.where(inside, i - 1, 0)])


def _lengths(doc: np.ndarray, item: np.ndarray, d: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Words of the match that begins at each pair of positions."""
    n = np.zeros(len(d), np.int64)
    open_ = np.arange(len(d))
    while len(open_):
        x, y = d[open_] + n[open_], i[open_] + n[open_]
        open_, x, y = (z[(x < len(doc)) & (y < len(item))] for z in (open_, x, y))
        open_ = open_[doc[x] == item[y]]
        n[open_] += 1
    return n


def tiles(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]] | np.ndarray, least: int = MATCH_WORDS) -> list[tuple[int, int, int]]:
    """(document position, item position, words) of the greedy tiles. seeds: positions of equal runs of `least`; of
    each match at least the first must be among them."""
    d, i = np.asarray(seeds, np.int64).reshape(-1, 2).T
    first = _begins(doc, item, d, i)
    d, i = d[first], i[first]
    n = _lengths(doc, item, d, i)
    order = np.lexsort((i, d, -n))
    whole = zip((-n[order]).tolist(), d[order].tolist(), i[order].tolist(), strict=True)  # longest first
    rest: list[tuple[int, int, int]] = []  # what is left of matches that overlap a tile
    doc_marked, item_marked = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    best = next(whole, None)
    while best or rest:
        if best and (not rest or best < rest[0]):
            n, d, i = best
            best = next(whole, None)
        else:
            n, d, i = heapq.heappop(rest)
        n = -n
        if n < least:
            continue
        taken = item_marked[i : i + n] | doc_marked[d : d + n]
        if not taken.any():
            out.append((d, i, n))
            item_marked[i : i + n] = doc_marked[d : d + n] = True
            if _longest_false(item_marked) < least:
                break  # no further tile fits into the item
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(rest, (a - b, d + a, i + a))
    return out


def _longest_false(marked: np.ndarray) -> int:
    edges = np.flatnonzero(np.r_[True, marked, True])
    return int(np.diff(edges).max()) - 1


class Block:
    """Items of one block, and where each run of their words stands."""

    def __init__(self, items: list[tuple[object, str]]):
        words = WordHashes()
        self.names = [n for n, _ in items]
        self.items = [words.text(parted(t)) for _, t in items]
        #: of items of 1 to MATCH_WORDS - 1 words: the hash of their whole run, and which they are
        self.short = {}
        for n in range(1, MATCH_WORDS):
            own = np.array([k for k, w in enumerate(self.items) if len(w) == n], np.int64)
            if len(own):
                self.short[n] = np.array([running_hashes(self.items[k], n)[0] for k in own], np.uint64), own
        runs = [running_hashes(w, MATCH_WORDS) for w in self.items]
        every = np.concatenate([np.zeros(0, np.uint64), *runs])
        owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(r)) for r in runs)])
        order = np.argsort(every, kind="stable")
        self.runs, self.owner, self.place = every[order], owner[order], place[order]
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.runs >> np.uint64(64 - FILTER_BITS)] = True

    def matches(self, doc: np.ndarray, coverage: float) -> Iterator[tuple[object, float, int, int, int]]:
        """(item, covered share, tiles, words of the longest, words covered) of each item found in a document."""
        for n, (whole, own) in self.short.items():
            for k in own[np.isin(whole, running_hashes(doc, n))]:
                yield self.names[k], 1.0, 1, n, n
        runs = running_hashes(doc, MATCH_WORDS)
        at = np.flatnonzero(self.maybe[runs >> np.uint64(64 - FILTER_BITS)])
        if not len(at):
            return
        shared = np.unique(runs[at])
        lo, hi = np.searchsorted(self.runs, shared, "left"), np.searchsorted(self.runs, shared, "right")
        count = hi - lo
        if not count.sum():
            return
        row = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner, place = self.owner[row], self.place[row]
        at = at[np.isin(runs[at], shared[count > 0])]
        for k in np.unique(owner):
            item = self.items[k]
            reach = np.zeros(len(item) + 1, np.int64)
            np.add.at(reach, place[owner == k], 1)
            np.add.at(reach, place[owner == k] + MATCH_WORDS, -1)
            if (np.cumsum(reach)[:-1] > 0).sum() < coverage * len(item):
                continue  # all seeds together cover too little
            found = tiles(doc, item, _seeds(doc, item, runs, at))
            covered = sum(n for _, _, n in found)
            if covered >= coverage * len(item):
                yield self.names[k], covered / len(item), len(found), max(n for _, _, n in found), covered


def _seeds(doc: np.ndarray, item: np.ndarray, runs: np.ndarray, at: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """Positions in document and item where a match begins. All pairs of equal runs are looked at, about `most` at a
    time, but only those that no pair precedes on their diagonal are kept."""
    own = running_hashes(item, MATCH_WORDS)
    order = np.argsort(own, kind="stable")
    lo, hi = np.searchsorted(own[order], runs[at], "left"), np.searchsorted(own[order], runs[at], "right")
    at, lo, count = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    ends = np.cumsum(count)
    out, start = [np.zeros((0, 2), np.int64)], 0
    while start < len(at):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        c = count[start:end]
        d = np.repeat(at[start:end], c)
        i = order[np.repeat(lo[start:end], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
        keep = _begins(doc, item, d, i)
        d, i = d[keep], i[keep]
        equal = np.all([doc[d + k] == item[i + k] for k in range(MATCH_WORDS)], axis=0)
        out.append(np.stack([d[equal], i[equal]], axis=1))
        start = end
    return np.concatenate(out)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile, covered_words): a row for each document and item that
    it holds; documents that hold none have no row. Ids may be of any type. Very long and repetitive texts are read
    whole: what is held at once are the starts of matches, never all pairs of equal runs.

    An item of fewer than MATCH_WORDS words is found where all its words stand in a row, however common they are; null
    items and those without a word are never found. Null and empty texts hold nothing. Repeated documents or items are reported each. Without documents
    or items there are no rows.
    """
    items = pick(benchmark, item_id=item_col, text=item_text_col).where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    rows = pick(docs, doc_id=id_col, text=text_col)
    kinds = {"doc": dict(rows.dtypes)["doc_id"], "item": dict(items.dtypes)["item_id"]}
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = [(r.item_id, r.text) for r in part.collect()]
        found = rows.mapInArrow(_search(block, coverage, items.schema["item_id"].dataType), f"doc_id {kinds['doc']}, item_id {kinds['item']}, coverage double, n_tiles long, longest_tile long, covered_words long")
        out = found if out is None else out.union(found)
    return out


def _search(block: list[tuple[object, str]], coverage: float, item_kind: DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, words = Block(block), WordHashes()
        kind = to_arrow_type(item_kind)
        for batch in batches:
            for part in slices(batch, "text"):
                at, found = [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    for row in index.matches(words.text(parted(text)), coverage):
                        at.append(k)
                        found.append(row)
                if found:
                    names, *numbers = zip(*found, strict=True)
                    columns = [part.column("doc_id").take(pa.array(at)), pa.array(names, kind), pa.array(numbers[0], pa.float64()), *(pa.array(x, pa.int64()) for x in numbers[1:])]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile", "covered_words"])

    return work
