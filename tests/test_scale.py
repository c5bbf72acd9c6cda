"""What grows with the input: no broadcast of a row for each key, no task that holds what a small file grows into."""

import os

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gaugeworks import queries as base
from gaugeworks.operators import shapes as H
from gaugeworks.operators import talents as T
from gaugeworks.operators.sweeps import combination_counts
from gaugeworks.queries import sweeps
from gaugeworks.session import dealt
from gaugeworks.sources import reports


def plan(df):
    return df._jdf.queryExecution().toString()


def test_points_join_nothing(spark):
    """A build's chosen sub-tree was joined to its picks, and broadcast to all tasks since the file is small."""
    rows = [(1, 1, 0, 2), (1, 3, 32, 3), (1, 3, 33, 4), (1, 4, 33, 1), (2, 2, 0, 5), (2, 3, 32, 1), (2, 3, 33, 1), (3, 4, 32, 1), (3, 4, 33, 1), (3, 3, 33, 7), (4, 9, 0, 1)]
    out = T.points(spark.createDataFrame(rows, "id long, tree int, sub_tree int, rank int"), ["id"])
    assert {tuple(r) for r in out.collect()} == {(1, 2, 0, 4, True), (2, 0, 5, 2, True), (3, 0, 0, 7, True), (4, 0, 0, 0, True)}
    assert "Join" not in plan(out)


def parts_of(spark, path, copies):
    """The smallest part table so many times with shifted keys, as one file; equal prices are ties."""
    rows = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    top = rows.agg(F.max("p_partkey")).first()[0] + 1
    both = spark.range(copies).crossJoin(rows).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * top).drop("id")
    both.coalesce(1).write.parquet(f"{path}/part.parquet")


def test_rows_that_grow_are_dealt_out_by_their_number(spark):
    """All parts of a small file were one task's, which held every step or ran every stream."""
    few = dealt(spark.range(10).coalesce(1), "id", 4)
    assert few.rdd.getNumPartitions() == 3 and few.count() == 10
    assert dealt(spark.range(0), "id").count() == 0


def test_steps_and_streams_shuffle_parts_and_not_their_rows(spark, tmp_path):
    parts_of(spark, tmp_path, 2)
    for name in ("planned_steps", "talent_roundtrip", "talent_points"):
        text = plan(base.queries()[name](spark, str(tmp_path))).split("== Physical Plan ==")[1].split("== Initial Plan ==")[0]
        assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text, name


def test_best_pairs_of_many_equal_items(spark, tmp_path):
    """Items of equal price and size were all ends of pairs, so pairs grew with their square; the order of equal ones is part of the result."""
    parts_of(spark, tmp_path, 7)
    parts = spark.read.parquet(f"{tmp_path}/part.parquet")
    few = parts.withColumn("p_retailprice", F.lit(900.0) + F.col("p_partkey") % 3 * 10).withColumn("p_size", (1 + F.col("p_partkey") % 2).cast("int"))
    few.write.parquet(f"{tmp_path}/few/part.parquet")
    ends = sweeps._ends(sweeps._pool(spark, f"{tmp_path}/few")).groupBy("brand").count().agg(F.max("count")).first()[0]
    assert ends <= 2 * 3 * 4 * 4  # sides, values, numbers of digits, items
    con = duckdb.connect()
    for sf in (f"{tmp_path}/few", str(tmp_path)):
        con.execute(f"CREATE OR REPLACE VIEW part AS SELECT * FROM '{sf}/part.parquet/*.parquet'")
        for name in ("best_set", "best_sets", "best_with_item", "beyond_one_swap"):
            want = con.execute(base.oracle_sql()[name])
            names = [d[0] for d in want.description]
            rows = lambda it: sorted(repr(tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r)) for r in it)
            assert rows(base.queries()[name](spark, sf).select(*names).collect()) == rows(want.fetchall()), (sf, name)


def test_samples_make_no_grid_and_reports_no_folder_each(spark, monkeypatch):
    """Sixty rows a fight were sorted and shuffled; a folder was written for each build."""
    steps = spark.createDataFrame([(1, 0.0, 0), (1, 1.0, 2), (1, 2.0, 1), (3, 5.0, 7)], "fight long, t double, n long")
    until = spark.createDataFrame([(1, 4.0, "x"), (2, 1.0, "y"), (3, 8.0, "z")], "fight long, window double, more string")
    out = H.sampled(steps, until, "fight", 4)
    assert {(r.fight, r.window, r.more): r["shape"] for r in out.collect()} == {(1, 4.0, "x"): [0, 2, 1, 1], (2, 1.0, "y"): [0, 0, 0, 0], (3, 8.0, "z"): [0, 0, 7, 7]}
    assert "Generate" not in plan(out)
    written, read = [], reports.read_reports
    monkeypatch.setattr(reports, "read_reports", lambda s, path, **how: written.append(path) or read(s, path, **how))
    assert base.queries()["report_cells"](spark, "/root/testdata/sf0.001").count() > 0
    assert not [f for f in os.listdir(written[0]) if f.startswith("build=")]


def test_a_band_and_medoids_hold_counts_and_tiles(spark, monkeypatch):
    rows = [(e, k, b, (k * k + b) % (3 + e)) for e in (1, 2) for k in range(50) for b in range(5)]
    got = H.band(spark.createDataFrame(rows, "encounter long, fight long, bucket long, n long"), "encounter")
    want = {(e, b): np.percentile([r[3] for r in rows if r[0] == e and r[2] == b], [50, 25, 75]).tolist() for e in (1, 2) for b in range(5)}
    assert {(r.encounter, r.bucket): [r.median, r.p25, r.p75] for r in got.collect()} == want
    shapes = [(1, k, [k % 3] * 50 + [k % 5] * 10) for k in range(40)] + [(2, 100, [1] * 60), (3, 101, []), (4, 102, [2] * 60), (4, 103, [2] * 60)]
    frame = spark.createDataFrame(shapes, "encounter long, fight long, shape array<long>")
    found = H.clusters(frame, "encounter", "fight")
    few = {tuple(r) for r in H.medoids(frame, found, "encounter", "fight").collect()}
    monkeypatch.setattr(H, "CHUNK", 1)  # now none is few
    assert few == {tuple(r) for r in H.medoids(frame, found, "encounter", "fight").collect()}


def test_a_sweep_broadcasts_no_items(spark, tmp_path):
    """Tables with a row for each item or variant were joined by broadcast as long as the files were small."""
    parts_of(spark, tmp_path, 3)
    text = plan(base.queries()["gear_sweep"](spark, str(tmp_path))).split("== Physical Plan ==")[1]
    assert "SortMergeJoin [grp#" in text
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "g string, item long")
    counts = plan(combination_counts(rows, rows.withColumn("level", F.lit(1)), ["g"])).split("== Physical Plan ==")[1].split("== Initial Plan ==")[0]
    assert "SortMergeJoin [g#" in counts
