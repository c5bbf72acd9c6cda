import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import decontamination, license_scan, line_dedup, preference_format, queries
from gaugeworks.llm.words import WordHashes, running_hashes
from tests.llm.test_dedup import DOCS, ODD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def plain_words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split(" ")


def words_of(text):
    return [w for w in plain_words(text) if w]


def plain_tiling(doc, item, least):
    """Greedy string tiling as first published: scan for the longest unmarked matches, mark, repeat."""
    dm, im, out = [False] * len(doc), [False] * len(item), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not im[i + n] and not dm[d + n]:
                    n += 1
                if n > best:
                    best, found = n, [(d, i)]
                elif n == best and n >= least:
                    found.append((d, i))
        if not found:
            return out
        for d, i in sorted(found, key=lambda x: x):
            if not any(dm[d : d + best]) and not any(im[i : i + best]):
                dm[d : d + best] = im[i : i + best] = [True] * best
                out.append((d, i, best))


def test_tiles_are_those_of_the_plain_algorithm():
    rng = random.Random(4)
    for _ in range(200):
        item = [rng.randint(0, 6) for _ in range(rng.randint(3, 25))]
        doc = [rng.randint(0, 6) for _ in range(20)] + item[8:] + [rng.randint(0, 9)] + item[:8]
        seeds = [(d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if doc[d : d + 3] == item[i : i + 3]]
        got = decontamination.tiles(np.array(doc), np.array(item), seeds, 3)
        want = plain_tiling(doc, item, 3)
        assert sorted(n for *_, n in got) == sorted(n for *_, n in want)
        assert all(doc[d : d + n] == item[i : i + n] for d, i, n in got)
        assert len({d + k for d, _, n in got for k in range(n)}) == sum(n for *_, n in got)


def test_repetitive_texts_are_tiled_in_bounded_time_and_memory(spark):
    import time
    import tracemalloc

    block, words = decontamination.Block([(1, "ha " * 60), (2, "ho hi " * 20 + "end")]), WordHashes()
    for text, want in (("ha " * 1_000_000, [(1, 1.0, 1, 60, 60)]), ("hi ho " * 300_000, [(2, 40 / 41, 1, 40, 40)])):
        doc = words.text(text)
        tracemalloc.start()
        began = time.time()
        assert list(block.matches(doc, 0.5)) == want
        assert time.time() - began < 30 and tracemalloc.get_traced_memory()[1] < 300e6
        tracemalloc.stop()
    rng = random.Random(6)
    for _ in range(60):  # few words, so that matches overlap in many ways
        item, doc = [[rng.randint(0, 1) for _ in range(n)] for n in (rng.randint(5, 18), 40)]
        text = lambda x: " ".join(f"w{k}" for k in x)
        got = [r[1:] for r in decontamination.Block([(1, text(item))]).matches(words.text(text(doc)), 0.01)]
        tiled = [n for *_, n in plain_tiling(doc, item, 5)]
        assert [(r[1], r[2], r[3]) for r in got] == ([(len(tiled), max(tiled), sum(tiled))] if tiled else [])


def test_items_may_have_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6")], "doc_id long, text string")
    for kind in ("decimal(9,2)", "smallint", "binary", "string", "date"):
        bench = spark.createDataFrame([(None, "w1 w2 w3 w4 w5 w6")], "item_id string, text string")
        value = {"binary": "X'0A'", "date": "DATE'2020-01-02'"}.get(kind, f"CAST(7 AS {kind})")
        got = decontamination.contaminated(docs, bench.selectExpr(f"{value} AS item_id", "text"))
        assert dict(got.dtypes)["item_id"] == kind and got.count() == 1


def test_op10_finds_what_brute_force_finds(spark, documents):
    items = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for i, t in documents.items():
        doc = words_of(t)
        held = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
        for name, item in items.items():
            seeds = [k for k in range(len(item) - 4) if tuple(item[k : k + 5]) in held]
            if len({p for k in seeds for p in range(k, k + 5)}) >= decontamination.COVERAGE * len(item):
                spots = [(d, k) for k in seeds for d in range(len(doc) - 4) if doc[d : d + 5] == item[k : k + 5]]
                near = sorted({p for d, _ in spots for p in range(max(0, d - 80), d + 80) if p < len(doc)})
                if sum(n for *_, n in plain_tiling([doc[p] for p in near], item, 5)) >= decontamination.COVERAGE * len(item):
                    want.add((i, name))
    got = {(r.doc_id, r.item_id) for r in queries.queries()["op10_decontamination"](spark, SF).collect()}
    assert got == want and got


def test_moved_and_changed_passages(spark):
    rng = random.Random(2)
    item = [f"w{rng.randint(0, 999)}" for _ in range(40)]
    noise = [f"n{k}" for k in range(300)]
    moved = noise[:50] + item[25:] + noise[50:99] + item[10:25] + noise[99:] + item[:10]
    rows = [(1, " ".join(moved)), (2, ", ".join(item).upper()), (3, " ".join(noise)), (4, " ".join(item[:19] + noise)), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(8))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "w1 w2"), (4, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {1, 2} and got[1].n_tiles == 3 and got[2].n_tiles == 1 and got[1].coverage == 1.0
    many = bench.union(spark.createDataFrame([(k, f"x{k} " * 9) for k in range(10, 30)], "item_id long, text string"))
    assert {r.doc_id for r in decontamination.contaminated(docs, many, block_bytes=200).collect()} == {1, 2}
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0 and decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_op6_finds_every_contained_notice(spark, documents):
    words = WordHashes()
    shingles = lambda t: set(running_hashes(words.text(t), 5).tolist())
    notices = {n: shingles(t) for n, t in license_scan.TEMPLATES.items()}
    want = {(i, n) for i, t in documents.items() for n, s in notices.items() if len(s & shingles(t)) >= 0.8 * len(s)}
    got = [(r.doc_id, r.license) for r in queries.queries()["op6_license_scan"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_notices_are_retrieved_at_every_place():
    rng = random.Random(9)
    known, words = license_scan.Templates(license_scan.TEMPLATES), WordHashes()
    for name, text in license_scan.TEMPLATES.items():
        for at in range(24):
            noise = [f"q{rng.randint(0, 10**6)}" for _ in range(60)]
            doc = " ".join(noise[:at]) + " " + text + " " + " ".join(noise[at:])
            assert name in {n for n, *_ in known.found(words.text(doc), 0.8)}
        assert name in {n for n, *_ in known.found(words.text(text), 0.8)}


def test_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(i, f"many\n only {i}\nfew" if i < 9 else "many\nrest\n\nrest", f"s{i}") for i in range(10)]
    rows += [(100 + i, f"wide\nx{i}", f"t{i % 40}") for i in range(400)] + [(900, None, "s"), (901, "", "s"), (902, "many", None), (902, "many", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit(1)).withColumn("at", F.lit(1))
    got = {r.doc_id: r for r in line_dedup.remove_shared_lines(docs, min_sites=10).collect()}
    assert got[3].text == " only 3\nfew" and got[9].text == "rest\n\nrest" and got[150].text == "x50"
    assert got[900].text is None and got[901].text == "" and got[902].text == "" and got[902].n_removed == 1
    assert line_dedup.remove_shared_lines(docs).count() == len(rows)
    assert line_dedup.remove_shared_lines(docs.limit(0)).count() == 0
    eleven = line_dedup.remove_shared_lines(docs, min_sites=11).where("doc_id = 3").first()
    assert eleven.text == "many\n only 3\nfew"


def test_preference_pairs(spark):
    rows = lambda *x: spark.createDataFrame(x, "conv_id long, turn long, role string, text string")
    chosen = rows((1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "ok"), (1, 3, "assistant", "bye"), (2, 0, "user", "a"), (3, 0, None, None), (None, 0, "user", "x"))
    rejected = rows((1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "a"), (4, 5, "assistant", "z"))
    got = {r.pair_id: r for r in preference_format.format_preferences(chosen.withColumn("at", F.lit(1)), rejected).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert one.n_prompt_turns == 1 and one.prompt == "<|user|>\nhi<|end|>\n"
    seen = [one.chosen[int(a) : int(b)] for a, b in (s.split(":") for s in one.chosen_spans.split(","))]
    assert seen == ["yo<|end|>", "bye<|end|>"] and one.rejected == "<|assistant|>\nno<|end|>\n"
    assert (got[2].chosen, got[2].rejected, got[2].prompt) == ("", "", "<|user|>\na<|end|>\n")
    assert got[3].chosen == "<|user|>\n<|end|>\n" and got[3].rejected == "" and got[4].chosen == "" and got[4].rejected_spans == "14:22"
    assert preference_format.format_preferences(chosen.limit(0), rejected.limit(0)).count() == 0
    worse = {(r.conv_id, r.turn): r.text for r in preference_format.repeated_answer(chosen).where("side = 'rejected'").collect()}
    assert worse[1, 3] == "yo" and worse[1, 1] == "yo" and worse[2, 0] == "a"
    assert preference_format.repeated_answer(chosen).where("side = 'chosen'").select(chosen.columns).exceptAll(chosen).count() == 0
    # turns of equal number, role and text, a long conversation, and one shuffle for it all
    long = [(7, k // 2, ("user", "assistant")[k % 2], f"t{k}") for k in range(2000)]
    twice = rows((5, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "user", "b"), *long)
    got = preference_format.format_preferences(twice, rows((5, 0, "user", "a"), (5, 0, "user", "a"), *long[:-1]))
    found = {r.pair_id: r for r in got.collect()}
    assert found[5].n_prompt_turns == 2 and found[5].chosen == "<|user|>\nb<|end|>\n" and found[5].rejected == ""
    # equal numbers follow the role, so the lone last user turn lies where the longer side has its answer
    assert found[7].n_prompt_turns == 1998 and found[7].rejected == "<|user|>\nt1998<|end|>\n"
    assert found[7].chosen == "<|assistant|>\nt1999<|end|>\n<|user|>\nt1998<|end|>\n"
    plan = preference_format.format_sides(preference_format.repeated_answer(twice))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], DOCS).withColumn("license", F.lit("x")).withColumn("coverage", F.lit(1))
    notice = spark.createDataFrame([(1, "Released under the MIT License.", None, None, None)], DOCS)
    assert license_scan.scan(docs).count() == 0 and license_scan.scan(docs.limit(0)).count() == 0
    assert [r.license for r in license_scan.scan(notice.union(notice)).collect()] == ["MIT", "MIT"]
    bench = spark.createDataFrame([(1, "w w w w w w w")], "item_id long, text string")
    assert [r.doc_id for r in decontamination.contaminated(docs, bench).collect()] == [8]
    assert line_dedup.remove_shared_lines(docs).count() == len(ODD)


def test_short_items_unspaced_scripts_and_spaces_of_any_kind(spark):
    docs = [
        (1, "Which way to go"), (2, "someone asked which way, to go!"), (3, "which way to stay go"), (4, "前の文。東京は日本の首都であり、人口が最も多い都市である。後の文"), (5, "東京は大きい"),
        (6, "one two\u00a0three four\u2003five six"), (7, "\u201cone\u201d two three \u2014 four five six"), (8, None), (9, ""), (10, "ไทยเป็นภาษา"),
    ]
    items = [(1, "Which way to go?"), (2, "東京は日本の首都であり、人口が最も多い都市である。"), (3, "one two three four five six"), (4, ""), (5, "!!"), (6, None), (7, "首都")]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 1), (4, 2), (4, 7), (6, 3), (7, 3)}
    assert {(r.coverage, r.n_tiles, r.longest_tile, r.covered_words) for r in found if r.item_id == 1} == {(1.0, 1, 4, 4)}
