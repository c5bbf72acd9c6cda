import os
import random
from collections import defaultdict

from pyspark.sql import functions as F

from gaugeworks.operators import intervals as I
from gaugeworks.queries import fights
from gaugeworks.streaming.sink import MergedTable
from gaugeworks.streaming.windows import entity_stream, keyed_state, paired_stream, tumbling

HITS = "ts timestamp, fight long, actor long, instance long, t double, amount double"


def drain(stream, mode, path):
    stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def test_pairing_over_several_triggers_equals_the_batch_form(spark, tmp_path):
    """Rows come out of order and across triggers; each trigger is a run of its own, from the checkpoint of the last."""
    rng = random.Random(8)
    rows, seq = [], 0
    for k in range(20):
        for n in range(rng.randint(1, 14)):
            seq += 1
            rows.append((k % 7, k, float(n), seq, rng.choice(["start", "end", "refresh"]), rng.choice([None, 1, 2])))
    frame = spark.createDataFrame(rows, "fight long, ability long, t double, seq long, kind string, source long")
    batch = I.paired(frame.withColumn("duration", F.lit(50.0)), ["fight", "ability"], ["t", "seq"])
    stamped = frame.select(F.timestamp_millis((F.col("t") * 1000).cast("long") + 1_000_000).alias("ts"), "*", F.lit(1_050_000).cast("long").alias("ends"), F.lit(50.0).alias("duration"))
    late = F.col("seq") % 3 == 0  # a third of the rows comes a trigger late, within the delay
    end = spark.createDataFrame([(1_100_000,)], "ms long").select(F.timestamp_millis("ms").alias("ts"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in stamped.schema[1:]))
    parts = [stamped.where((F.col("t") < 4) & ~late), stamped.where(((F.col("t") < 4) & late) | ((F.col("t") >= 4) & (F.col("t") < 9) & ~late))]
    parts += [stamped.where(((F.col("t") >= 4) & (F.col("t") < 9) & late) | ((F.col("t") >= 9) & ~late)), stamped.where((F.col("t") >= 9) & late), end]
    path = str(tmp_path)
    open_rows = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        with keyed_state(spark):
            drain(paired_stream(spark.readStream.schema(stamped.schema).parquet(f"{path}/in"), "10 seconds"), "append", path)
        open_rows.append(spark.read.schema("fight long").parquet(f"{path}/rows").count())
    as_set = lambda df: sorted(repr(tuple(r)) for r in df.select("fight", "ability", "start", "end", "truncated", "opener").collect())
    assert as_set(spark.read.parquet(f"{path}/rows")) == as_set(batch)
    assert open_rows[0] == 0 and open_rows[-2] < open_rows[-1]  # the timer at the fights' end closes the rest


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    row = lambda s, kind: spark.createDataFrame([(s, kind)], "s long, kind string").select(
        F.timestamp_millis(F.col("s") * 1000).alias("ts"), F.lit(1).cast("long").alias("fight"), F.lit(1).cast("long").alias("ability"), F.col("s").cast("double").alias("t"),
        F.col("s").alias("seq"), "kind", F.lit(7).cast("long").alias("source"), F.lit(40_000).cast("long").alias("ends"), F.lit(40.0).alias("duration"),
    )
    path = str(tmp_path)
    for part in (row(10, "start"), row(30, "other"), row(12, "end"), row(90, "other")):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        with keyed_state(spark):
            drain(paired_stream(spark.readStream.schema(part.schema).parquet(f"{path}/in"), "5 seconds"), "append", path)
    assert [tuple(r) for r in spark.read.parquet(f"{path}/rows").collect()] == [(1, 1, 10.0, 40.0, True, 7)]


def test_pairs_share_state_and_calls(spark, tmp_path):
    """Each pair had three states, a call and a timer of its own, some 3 ms of a trigger whatever its rows were."""
    many = spark.range(4000).select((F.col("id") % 2000).alias("fight"), F.lit(1).cast("long").alias("ability"), (F.floor(F.col("id") / 2000) + 1).cast("double").alias("t"), F.col("id").alias("seq"))
    frame = many.withColumn("kind", F.when(F.col("seq") % 3 == 0, "end").otherwise("start")).withColumn("source", F.col("seq") % 5).withColumn("duration", F.lit(9.0))
    stamped = frame.select(F.timestamp_millis((F.col("t") * 1000).cast("long") + 1_000_000).alias("ts"), "*", F.lit(1_009_000).cast("long").alias("ends"))
    tick = spark.range(1).select(F.timestamp_millis(F.lit(2_000_000)).alias("ts"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in stamped.schema[1:]))
    path, held = str(tmp_path), []
    for part in (stamped.where("t = 1"), stamped.where("t = 2"), tick):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        with keyed_state(spark):
            stream = paired_stream(spark.readStream.schema(stamped.schema).parquet(f"{path}/in"), "5 seconds")
            q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
        held += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert 0 < max(held) < 2000 and held[-1] == 0
    rows = lambda df: sorted(tuple(r) for r in df.select("fight", "ability", "start", "end", "truncated", "opener").collect())
    assert rows(spark.read.parquet(f"{path}/rows")) == rows(I.paired(frame, ["fight", "ability"], ["t", "seq"]))


def test_pairs_with_nulls_and_long_ids(spark, tmp_path):
    """A null beside them made doubles of ids."""
    big = 2**60 + 1
    some = [(None, 1, 1.0, 1, "start", None), (None, 1, 2.0, 2, "end", big), (0, 1, 3.0, 3, "start", None), (big, None, 1.0, 4, "end", big), (big, 1, 1.0, 5, "start", big), (big, 1, 2.0, 6, "end", None)]
    some += [(big + 2, 1, 1.0, 7, "start", None), (big + 2, 1, 2.0, 8, "start", 5), (big, 0, 1.0, 9, None, 3), (big, 0, 1.0, big + 4, "start", big), (big, 0, 1.0, big + 3, "end", 0)]
    frame = spark.createDataFrame(some, "fight long, ability long, t double, seq long, kind string, source long").withColumn("duration", F.lit(9.0))
    stamped = frame.select(F.timestamp_millis((F.col("t") * 1000).cast("long") + 1_000_000).alias("ts"), "*", F.lit(1_009_000).cast("long").alias("ends"))
    tick = spark.range(1).select(F.timestamp_millis(F.lit(2_000_000)).alias("ts"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in stamped.schema[1:]))
    path = str(tmp_path)
    for part in (stamped, tick):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    with keyed_state(spark):
        stream = spark.readStream.schema(stamped.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        drain(paired_stream(stream, "5 seconds", 2), "append", path)
    rows = lambda df: sorted(repr(tuple(r)) for r in df.select("fight", "ability", "start", "end", "truncated", "opener").collect())
    assert rows(spark.read.parquet(f"{path}/rows")) == rows(I.paired(frame, ["fight", "ability"], ["t", "seq"]))


def test_steps_of_the_stream_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """One task read all rows for each step and wrote them as one file."""
    monkeypatch.setattr(fights, "scratch_path", lambda s, label: str(tmp_path))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # else so few rows are one task's
    try:
        got = fights.aura_windows_streamed(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset(key)
    assert len([f for f in os.listdir(tmp_path / "in") if f.endswith(".parquet")]) > 8
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(got) == rows(fights.aura_windows(spark, "/root/testdata/sf0.001"))


def test_running_aggregates(spark, tmp_path):
    rows = [(f"2024-01-0{1 + d} 0{h}:00:00", d, a, 0, h * 3600.0, 1.5) for d in range(3) for h in range(5) for a in range(2)]
    frame = spark.createDataFrame(rows, "ts string, fight long, actor long, instance long, t double, amount double").withColumn("ts", F.to_timestamp("ts"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = entity_stream(stream).writeStream.outputMode("complete").format("memory").queryName("entities").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.fight, r.actor): (r["first"], r["last"], r.total) for r in spark.table("entities").collect()}
    assert got == {(d, a): (0.0, 14400.0, 7.5) for d in range(3) for a in range(2)}
    drain(tumbling(stream, "1 hour", "10 minutes"), "append", str(tmp_path / "out"))
    closed = spark.read.parquet(str(tmp_path / "out/rows")).collect()
    # the watermark is 03:50 of the last day, so its windows from 3 and 4 are still open
    assert len(closed) == 13 and all(r.n == 2 and r.total == 3.0 for r in closed)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "k string, stamp int, v int, done boolean")
    kept = MergedTable(spark, str(tmp_path / "t"), "k STRING, stamp INT, v INT, done BOOLEAN", ["k"], "stamp", ["v"])
    kept.write(rows(("a", 1, 1, False), ("a", 2, 2, False), ("b", 1, 1, True)), 0)
    kept.write(rows(("a", 3, 9, False)), 1)
    kept.write(rows(("a", 3, 9, False)), 1)
    state = lambda t: {(r.k, r.stamp, r.v) for r in t.read().collect()}
    assert state(kept) == {("a", 3, 9), ("b", 1, 1)}
    folded = kept.compact(str(tmp_path / "u"))
    folded.write(rows(("b", 5, 5, False)), 2)
    assert state(folded) == {("a", 3, 9), ("b", 5, 5)}
    wanted = spark.createDataFrame([("b",), ("a",), ("z",)], "k string")
    assert [r.k for r in kept.todo(wanted, "done").collect()] == ["z", "a"]


def test_order_of_input_changes_no_rows(spark):
    counts = defaultdict(set)
    rng = random.Random(1)
    spans = [(f, float(rng.randint(0, 9)), float(rng.randint(9, 20))) for f in range(5) for _ in range(6)]
    for n in (1, 3, 7):
        rng.shuffle(spans)
        frame = spark.createDataFrame(spans, "fight long, first double, last double").repartition(n)
        counts["x"].add(tuple(sorted(tuple(r) for r in I.concurrency(frame).collect())))
    assert len(counts["x"]) == 1
