"""Streaming forms of the event operators.

Each gives, once the stream has ended, the rows of its batch form over the same events.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PAIR_OUT = "fight long, ability long, start double, end double, truncated boolean, opener long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State of several kinds for each key, and timers, need the RocksDB store; streams that start inside have it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


#: What is kept of a row, as lists of a bucket's rows; numbers instead of nulls, which `nulls` marks.
_KEPT = {"fight": "long", "ability": "long", "source": "long", "nulls": "long", "seq": "long", "stamp": "long", "ends": "long", "t": "double", "duration": "double", "closes": "boolean", "opened": "boolean"}
#: Bits of `nulls`.
_NULLS = {"fight": 1, "ability": 2, "source": 4}


class _Pairing(StatefulProcessor):
    """Of each bucket of (fight, ability): the rows that the watermark hasn't passed, and those that opened a window.

    A call for each pair costs milliseconds, whatever its rows are; a bucket's pairs share one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", ", ".join(f"{c} array<{kind}>" for c, kind in _KEPT.items()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._released([frame.loc[frame.known, list(_KEPT)] for frame in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._released([], timerValues.getCurrentWatermarkInMs())  # rows that no later input has released

    def _released(self, frames: list[pd.DataFrame], until: int) -> Iterator[pd.DataFrame]:
        """Takes the waiting rows up to the watermark, in their order, and gives the windows that they or the ends of
        their fights close."""
        new = [frame for frame in frames if len(frame)]
        before = [pd.DataFrame(dict(zip(_KEPT, self.kept.get(), strict=True)))] if self.kept.exists() else []
        if not new and not before:
            return
        rows = pd.concat([*before, *new], ignore_index=True)
        due = _due(rows) <= until
        if not new and not due.any():  # this trigger's input has released them
            return
        ready = rows.opened | due
        windows, still = _windows(rows[ready], until)
        rest = pd.concat([rows[~ready], still])
        if len(rest):
            self.kept.update(tuple(rest[c].tolist() for c in _KEPT))
            nearest = int(_due(rest).min())
            if not before or nearest != _due(before[0]).min():
                self.handle.registerTimer(nearest)
        else:
            self.kept.clear()
        if len(windows):
            yield windows


def _due(rows: pd.DataFrame) -> pd.Series:
    """When something is to be done for a row: its own time, or that of its fight's end."""
    return rows.ends.where(rows.opened, np.minimum(rows.stamp, rows.ends))


def _windows(rows: pd.DataFrame, until: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The windows of PAIR_OUT that rows close or that their fight's end closes, and the rows that open the others."""
    pairs = [rows.fight, rows.ability, rows.nulls & (_NULLS["fight"] | _NULLS["ability"])]
    order = np.lexsort([rows.seq, rows.t, ~rows.opened, *pairs])
    rows, pairs = rows.iloc[order], np.stack(pairs)[:, order]
    closes = rows.closes.to_numpy()
    head = np.ones(len(rows), bool)
    head[1:] = closes[:-1] | (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
    first = np.flatnonzero(head)
    one, two = (rows.iloc[at].reset_index(drop=True) for at in (first, np.append(first, len(rows))[1:] - 1))
    null = lambda frame, c: (frame.nulls & _NULLS[c]) > 0
    out = pd.DataFrame({
        "fight": one.fight.astype("Int64").mask(null(one, "fight")),
        "ability": one.ability.astype("Int64").mask(null(one, "ability")),
        "start": one.t.mask(one.closes, 0.0),
        "end": two.t.where(two.closes, two.duration),
        "truncated": one.closes | ~two.closes,
        "opener": one.source.where(~null(one, "source"), two.source).astype("Int64").mask(null(one, "source") & (null(two, "source") | ~two.closes)),
    })
    done = two.closes | (two.ends <= until)
    return out[done], one[~done].assign(opened=True)


def paired_stream(events: DataFrame, delay: str, buckets: int = 256) -> DataFrame:
    """Windows of kind 'start' to kind 'end' per (fight, ability), in append mode, as intervals.paired gives them.

    events: ts (event time), fight, ability, t (seconds into the fight), seq, kind, source, ends (time of the fight's
    end in ms) and duration (its seconds). Rows may come in any order that the watermark, `delay` behind the newest
    row, allows: they wait until it has passed them, and later ones are dropped. At the fight's end a timer closes a
    window that is still open, truncated, and what was kept of it goes. State is held by buckets, dealt out by a hash
    of (fight, ability); a bucket's waiting rows are in memory at once, so their number should grow with the rows of a
    delay, and stays the same for all runs from a checkpoint. Start it inside keyed_state().
    """
    nulls = sum((F.when(F.col(c).isNull(), bit).otherwise(0) for c, bit in _NULLS.items()), F.lit(0))
    rows = events.withWatermark("ts", delay).select(
        "ts", F.pmod(F.xxhash64("fight", "ability"), F.lit(buckets)).alias("bucket"), F.coalesce(F.col("kind").isin("start", "end"), F.lit(False)).alias("known"),
        *(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("fight", "ability", "source", "seq")), nulls.cast("long").alias("nulls"),
        F.coalesce("ends", F.lit(1 << 62)).alias("ends"), F.coalesce(F.unix_millis("ts"), F.lit(0).cast("long")).alias("stamp"), "t", "duration", F.coalesce(F.col("kind") == "end", F.lit(False)).alias("closes"), F.lit(False).alias("opened"),
    )
    return rows.groupBy("bucket").transformWithStateInPandas(_Pairing(), PAIR_OUT, "Append", "EventTime")


def entity_stream(hits: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(fight, actor, instance, first, last, total) so far, in update or complete mode. hits has ts, the event
    time; state of fights that the watermark has passed is dropped."""
    day = F.window("ts", "1 day").alias("day")
    return hits.withWatermark("ts", delay).groupBy(day, "fight", "actor", "instance").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.sum("amount").alias("total"))


def tumbling(hits: DataFrame, width: str, delay: str) -> DataFrame:
    """(start, fight, n, total) of closed windows, in append mode."""
    grouped = hits.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "fight")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total")).select(F.col("w.start").alias("start"), "fight", "n", "total")
