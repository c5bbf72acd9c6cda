import zlib

import numpy as np
from pyspark.sql import functions as F

from gaugeworks.llm import language_id, queries, toxicity
from tests.llm.test_dedup import DOCS, ODD

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def plain_bundle(text):
    points = language_id.letters(text).tolist()
    one = lambda c: 2 * np.random.default_rng([language_id.SEED, c]).integers(0, 2, language_id.DIMENSIONS) - 1
    return sum(np.roll(one(a), 2) * np.roll(one(b), 1) * one(c) for a, b, c in zip(points, points[1:], points[2:], strict=False))


def test_bundle_is_the_sum_of_bound_ngrams():
    for text in ("A", "Été, 12 où!", "der die das der", "漢字 x" * 3):
        assert np.array_equal(language_id.Letters().bundle(text), plain_bundle(text))
    assert language_id.Letters().bundle(" 12 !") is None


def test_language_of_held_out_documents(spark):
    got = queries.queries()["op7_language_id"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(lang) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in unseen) / len(unseen) > 0.98


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    a, b = language_id.learn(docs), language_id.learn(changed)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_toxicity_of_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.queries()["op1_toxicity"](spark, SF).collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held(i) for i, r in got.items())
    pairs = [(got[a].score > got[b].score) + 0.5 * (got[a].score == got[b].score) for a in marks if marks[a] == 1 and held(a) for b in marks if marks[b] == 0 and held(b)]
    assert np.mean(pairs) > 0.8


def test_facts_of_words():
    assert toxicity.plain("(Id1ot)!") == "idiot" and toxicity.plain("don't") == "don't" and toxicity.plain("i.d.i.o.t") == "idiot"
    facts = toxicity.WordFacts({"idiot": 3.0, "scum-": 2.0})
    row = dict(zip(toxicity.FEATURES, facts.features(b"YOU are an id10t, scummy one!"), strict=True))
    assert row["hits_near_second_person"] == 1 and row["hit_rate"] == 2 / 6 and row["top_weight"] == 3.0 and row["shouted_rate"] == 1 / 6
    assert facts.features(b"") == [0.0] * len(toxicity.FEATURES)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], DOCS).withColumn("score", F.lit(9)).withColumn("features", F.lit("x"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.learn(known, labels.union(labels.limit(5)), rounds=3)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.learn(known.limit(0), labels.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}
    langs = language_id.predict(docs, language_id.learn(known), keep=("lang",)).collect()
    assert len(langs) == len(ODD) and {r.lang_pred for r in langs if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in language_id.predict(docs, language_id.learn(docs)).collect()} == {"und"}
