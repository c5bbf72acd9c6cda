"""A bit-stream codec for selections: six bits a letter, the lowest bit first.

A stream holds a version (8 bits), a spec (16 bits) and a hash of the tree (128 bits, not read), then for every node
in ascending order: taken (1 bit); if taken, purchased (1); if purchased, partial (1), with its rank (6) if partial,
and choice (1), with its entry (2) if so. A node that is taken but not purchased was granted and has rank 1. Reading
past the end gives zeros. This is the one thing here that columns can't say, since a field's place depends on all
before it; it runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the letters of base 64 in their usual order.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
# Fixed values of the format: its version and the width of the tree's hash.
VERSION = 2
TREE_BITS = 128
SCHEMA = "version int, spec int, picks array<struct<node int, rank int, entry int>>, error string"


class _Bits:
    def __init__(self, text: str):
        self.value = sum(ALPHABET.index(c) << 6 * k for k, c in enumerate(text))

    def take(self, n: int) -> int:
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        return out


#: A node's id, highest rank and number of entries.
Node = tuple[int, int, int]


def decode_one(text: str | None, nodes: list[Node]) -> dict:
    """The picks of a stream over nodes in any order; entry counts from 0 among the node's entries.

    A letter outside the alphabet, another version and an entry that the node lacks are errors, not exceptions.
    """
    nothing = {"version": None, "spec": None, "picks": None}
    if text is None:
        return nothing | {"error": "missing"}
    if bad := [c for c in text if c not in ALPHABET]:
        return nothing | {"error": f"unknown letter {bad[0]}"}
    bits, picks = _Bits(text), []
    version, spec = bits.take(8), bits.take(16)
    if version != VERSION:
        return nothing | {"error": f"version {version}"}
    bits.take(TREE_BITS)
    for node, top, entries in sorted(nodes):
        if bits.take(1):
            rank, entry = 1, 0
            if bits.take(1):
                rank = bits.take(6) if bits.take(1) else top
                entry = bits.take(2) if bits.take(1) else 0
            if entry and entry >= entries:
                return nothing | {"error": f"node {node} has no entry {entry}"}
            picks.append({"node": node, "rank": rank, "entry": entry})
    return {"version": version, "spec": spec, "picks": picks, "error": None}


def encode_one(version: int, spec: int, picks: dict[int, tuple[int, int]], nodes: Iterable[Node]) -> str:
    """The stream of picks {node: (rank, entry)}, all of them purchased, under an empty hash."""
    value, at = 0, 0

    def put(x: int, n: int) -> None:
        nonlocal value, at
        value |= x << at
        at += n

    put(version, 8)
    put(spec, 16)
    put(0, TREE_BITS)
    for node, top, _ in sorted(nodes):
        put(node in picks, 1)
        if node in picks:
            rank, entry = picks[node]
            put(1, 1)
            put(rank != top, 1)
            if rank != top:
                put(rank, 6)
            put(entry > 0, 1)
            if entry > 0:
                put(entry, 2)
    return "".join(ALPHABET[value >> 6 * k & 63] for k in range(-(-at // 6)))


def decoded(text: Column, nodes: list[Node]) -> Column:
    """struct(version, spec, picks, error) of each stream. The nodes of one tree are a bounded list."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_one(t, nodes) for t in texts], columns=["version", "spec", "picks", "error"])

    return run(text)


def encoded(version: Column, spec: Column, picks: Column, nodes: list[Node]) -> Column:
    """The stream of picks, an array of struct(node, rank, entry)."""

    @F.pandas_udf("string")
    def run(versions: pd.Series, specs: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([encode_one(int(v), int(s), {p["node"]: (p["rank"], p["entry"]) for p in ps}, nodes) for v, s, ps in zip(versions, specs, lists, strict=True)])

    return run(version, spec, picks)


def header(text: Column) -> Column:
    """struct(version, spec) by columns alone: the first 24 bits are the first four letters. Nulls for a letter outside
    the alphabet; past the end are zeros."""
    letter = lambda k: F.substr(text, F.lit(k + 1), F.lit(1))
    at = lambda k: F.nullif(F.instr(F.lit(ALPHABET), letter(k)), F.lit(0)).cast("int") - 1
    six = [F.when(letter(k) == "", 0).otherwise(at(k)) for k in range(4)]
    number = six[0] + six[1] * 64 + six[2] * 4096 + six[3] * 262144
    return F.struct((number % 256).alias("version"), F.floor(number / 256).cast("int").alias("spec"))
