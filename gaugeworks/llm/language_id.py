"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram of letters is bound to
one vector: the product of its letters' vectors, each rotated by its distance from the end. A text is the sum
(bundle) of its n-grams' vectors, and a language the sum of its texts' vectors, each of unit length. A text
gets the language whose prototype has the largest cosine with it.

Prototypes are learned from about TRAIN_ROWS labelled rows at most, chosen by a hash of the id. Scoring reads
every whole text, in blocks of n-grams, so a very long text needs no more memory than its own letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import is_held_out, pick, slices

DIMENSIONS, ORDER, TRAIN_ROWS, SEED, BLOCK, CELLS = 1024, 3, 20_000, 7, 1024, 1 << 20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(1 << 16, np.int64)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low[0])
    return out


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; each run of anything else is one 0, also at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    plain = points < 1 << 16
    out = np.where(plain, _folded()[np.where(plain, points, 0)], points)
    if not plain.all():
        for i in np.flatnonzero(~plain):
            out[i] = ord(chr(points[i]).lower()[0]) if chr(points[i]).isalpha() else 0
    out = np.r_[0, out, 0]
    return out[np.r_[True, (out[1:] != 0) | (out[:-1] != 0)]]


class Letters:
    """Vectors of letters in each of their rotations, drawn when first met. Beyond `most` letters all are forgotten
    and drawn again from their code points: 12 MB at most, or what one text's own letters take."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, most: int = 4096):
        self.order, self.most, self.known = order, most, {}
        self.table = np.zeros((64, order, dimensions), np.int8)

    def _rows(self, alphabet: list[int]) -> np.ndarray:
        """(letters, rotations, dimensions)."""
        new = [c for c in alphabet if c not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, alphabet
            self.table = self.table[: self.most].copy() if len(self.table) > self.most else self.table
        need = len(self.known) + len(new)
        if need > len(self.table):
            grown = np.zeros((max(need, 2 * len(self.table)), *self.table.shape[1:]), np.int8)
            grown[: len(self.known)] = self.table[: len(self.known)]
            self.table = grown
        for c in new:
            row = (2 * np.random.default_rng([SEED, c]).integers(0, 2, self.table.shape[2]) - 1).astype(np.int8)
            at = self.known[c] = len(self.known)
            for k in range(self.order):
                self.table[at, k] = np.roll(row, k)
        return self.table[[self.known[c] for c in alphabet]]

    def bundle(self, text: str) -> np.ndarray | None:
        """The sum of the text's n-gram vectors; None if it has no letter."""
        points = letters(text)
        if not points.any():
            return None
        while len(points) < self.order:
            points = np.r_[points, 0]
        alphabet, at = np.unique(points, return_inverse=True)
        vectors = self._rows(alphabet.tolist())
        a = len(alphabet)
        if a <= 256:
            vectors = vectors.astype(np.float32)
        n = len(points) - self.order + 1
        tail = np.zeros(n, np.int64)  # all letters of an n-gram but its first
        for k in range(1, self.order):
            tail = tail * a + at[k : k + n]
        tails, which = np.unique(tail, return_inverse=True)
        order = np.argsort(which, kind="stable")
        ends = np.cumsum(np.bincount(which))
        block = max(16, min(BLOCK, CELLS // a))
        total = np.zeros(vectors.shape[2], np.float64)
        for lo in range(0, len(tails), block):
            rest = tails[lo : lo + block]
            here = order[ends[lo - 1] if lo else 0 : ends[lo + len(rest) - 1]]
            # binding is distributive: n-grams with one tail are bundled before their first letters are bound to it
            if a > 256 and 8 * len(here) < len(rest) * a and len(here) <= 1 << 14:  # a large alphabet: few letters go before a tail
                begins = np.flatnonzero(np.r_[True, which[here[1:]] != which[here[:-1]]])
                bound = np.add.reduceat(vectors[at[here], -1], begins, axis=0, dtype=np.int32).astype(np.float32)
            else:
                counts = np.bincount((which[here] - lo) * a + at[here], minlength=len(rest) * a).reshape(len(rest), a)
                bound = counts.astype(np.float32) @ vectors[:, -1].astype(np.float32, copy=False)
            for k in range(self.order - 1):
                bound *= vectors[rest % a, k]
                rest = rest // a
            total += bound.sum(0, dtype=np.float64)
        return total


@lru_cache(maxsize=4)
def _letters(dimensions: int) -> Letters:
    """One per worker process."""
    return Letters(dimensions)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(-1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of unit length from labelled rows that are not held out; about `rows` of them at most.

    Rows with a null id, language or text, or without a letter, teach nothing. Without any other row the result
    is empty. What comes to the driver is one vector for each language.
    """
    known = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    known = known.where(~is_held_out())
    n = pick(docs, doc_id=id_col, lang=lang_col).where("doc_id IS NOT NULL AND lang IS NOT NULL").where(~is_held_out()).count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                x = _letters(dimensions).bundle(text)
                if x is not None:
                    sums[lang] = sums.get(lang, 0) + _unit(x)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "sums": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))})

    parts = known.select("text", "lang").mapInArrow(work, "lang string, sums array<double>")
    summed = parts.select("lang", F.posexplode("sums").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    vectors = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", "v.x")
    found = {r.lang: np.array(r.x) for r in vectors.collect()}
    if not found:
        return {}
    # what all languages share tells none apart
    mean = np.mean([_unit(x) for x in found.values()], axis=0) if len(found) > 1 else 0
    return {lang: _unit(_unit(x) - mean) for lang, x in sorted(found.items())}


def noise(dimensions: int = DIMENSIONS, deviations: float = 3.3) -> float:
    """A cosine that a text in none of the learned languages seldom reaches: its vector lies at random to theirs,
    and such cosines have a standard deviation of 1 / sqrt(dimensions)."""
    return deviations / dimensions**0.5


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score): the nearest language of each whole text and its cosine, 0 to 1.

    `und` with score 0 where the text is null or has no letter, or nothing was learned. Equal cosines go to the
    name that sorts first. Repeated rows are scored each. An empty table gives no rows.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[x] for x in names])
    dimensions = matrix.shape[1] if names else DIMENSIONS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                langs, scores = [], []
                for text in part.column("text").to_pylist():
                    x = _letters(dimensions).bundle(text) if text and names else None
                    near = matrix @ _unit(x) if x is not None else None
                    best = int(near.argmax()) if near is not None else -1
                    langs.append(names[best] if best >= 0 else UNKNOWN)
                    scores.append(min(1.0, max(0.0, float(near[best]))) if best >= 0 else 0.0)
                kept = [part.column(c) for c in ("doc_id", *keep)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", *keep, "lang_pred", "score"])

    rows = pick(docs, doc_id=id_col, text=text_col, **{c: c for c in keep if c not in ("doc_id", "text")})
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(work, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)) + ", lang_pred string, score double")
