import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from gaugeworks.llm import exact_dedup, near_copies, queries, simhash
from gaugeworks.llm.components import components
from tests.llm.helpers import closure

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    ids = list(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 4]
    return closure(ids, links)


def test_op2_equals_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = plain_components(fps)
    got = queries.queries()["op2_simhash_near_dedup"](spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in docs}
    assert len(got) == len(docs)


@pytest.mark.parametrize("bucket_rows", [3, 20, 20_000])
def test_links_survive_every_way_of_cutting_buckets(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {c for c in centres}
    while len(fps) < 400:
        x = rng.choice(sorted(fps)) if rng.random() < 0.7 else rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        fps.add(x)
    ids = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(i, simhash._signed(f)) for i, f in ids.items()], "node long, fp long")
    found = {r.node: r.component for r in components(simhash.link_edges(nodes, 4, bucket_rows)).collect()}
    assert {i: found.get(i, i) for i in ids} == plain_components(ids)


def test_masks_hold_every_pair_within_the_limit():
    rng = random.Random(5)
    for n in (10, 10**5, 10**7, 10**9, 10**11):
        masks = simhash.first_masks(n, 4)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not m & diff for m in masks)
            for m in masks:
                if not m & diff:
                    assert any(not x & diff for x in simhash.next_masks(m, 4))


def test_search_in_large_buckets_prunes_nothing_that_links():
    rng = np.random.default_rng(3)
    fp = np.unique(np.r_[rng.integers(0, 2**20, 1500), rng.integers(0, 2**63, 500)]).astype(np.uint64)
    label = simhash.linked(np.zeros(len(fp), np.int64), fp, 3, page=4, chunk=64)
    links = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 3).tolist()]
    assert dict(enumerate(label.tolist())) == closure(range(len(fp)), links)


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain + star + [(7, 7), (0, 1)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    want = closure(set(range(41)) | set(range(100, 150)), chain + star)
    assert got == {n: c for n, c in want.items() if n != c}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (4, "One two"), (5, "ONE  two"), (6, "a\x0bb"), (7, "a b"), (None, "a b"), (8, "w " * 60_000), (9, "é Ü 漢字 " * 5)]


def test_odd_rows_have_defined_results(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], DOCS)
    docs = docs.withColumn("fp", docs.doc_id).withColumn("digest", docs.text).withColumn("component_id", docs.n_chars)
    near = simhash.near_duplicates(docs).collect()
    assert len(near) == len(ODD)
    assert {r.component_id for r in near if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in near if r.doc_id in (4, 5)} == {4}
    index = exact_dedup.DigestIndex(spark, f"{spark.conf.get('spark.checkpoint.dir')}/odd", "odd_digests", 4)
    got = index.dedup(docs).collect()
    assert len(got) == len(ODD)
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).digest()
    assert sorted(bytes(r.digest) for r in got) == sorted(norm(t) for _, t in ODD)
    assert sum(r.kept for r in got) == len({norm(t) for _, t in ODD})
    assert sorted(r.kept for r in got if r.doc_id == 4) == [False, True]
    assert {r.keep_id for r in got if r.doc_id in (6, 7, None)} == {6}
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    assert index.dedup(empty).count() == 0


def test_index_keeps_what_came_before(spark):
    rows = lambda *x: spark.createDataFrame([(i, t, None, None, None) for i, t in x], DOCS)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/persist"
    index = exact_dedup.DigestIndex(spark, path, "first_name", 4)
    index.dedup(rows((5, "x"), (6, "x"), (7, "y"))).collect()
    spark.sql("DROP TABLE first_name")
    again = exact_dedup.DigestIndex(spark, path, "second_name", 4)
    got = {(r.doc_id, r.keep_id, r.kept, r.group_size) for r in again.dedup(rows((1, "x"), (2, "z"), (3, "z"))).collect()}
    assert got == {(1, 5, False, 1), (2, 2, True, 2), (3, 2, False, 2)}
    assert again.entries().count() == 3


def test_named_batch_gives_the_same_rows_again_after_a_failure(spark, monkeypatch):
    rows = lambda *x: spark.createDataFrame([(i, t, None, None, None) for i, t in x], DOCS)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/again"
    index = exact_dedup.DigestIndex(spark, path, "again_name", 4)
    index.dedup(rows((5, "x"), (7, "y")), batch="a").collect()
    batch = rows((1, "x"), (2, "z"), (3, "z"), (4, "u"))
    want = {(1, 5, False, 1), (2, 2, True, 2), (3, 2, False, 2), (4, 4, True, 1)}
    result = lambda: {(r.doc_id, r.keep_id, r.kept, r.group_size) for r in index.dedup(batch, batch="b").collect()}
    with monkeypatch.context() as patched:  # the driver is lost after the append, before the rows are used
        patched.setattr(exact_dedup, "join_by_group", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            result()
    assert result() == want and result() == want
    assert index.entries().count() == 4
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.dedup(rows((9, "u"))).collect()} == {(9, 4, False)}
    small = index.compacted(path + "-compact", "compact_name")
    assert sorted(map(tuple, small.entries().collect())) == sorted(map(tuple, index.entries().collect()))
    assert len({r.f for r in small.entries().selectExpr("input_file_name() f").collect()}) <= 4
    index.close(), small.close()
    assert not spark.catalog.tableExists("again_name")


def test_wide_masks_meet_pairs_at_the_threshold():
    draw = np.random.default_rng(8)
    for n in (100, 10**5, 10**7):
        masks = np.array(near_copies.random_masks(n), np.int64).view(np.uint64)
        met = 0
        for _ in range(300):
            bits = draw.random(near_copies.BITS) > near_copies.SAME
            diff = np.packbits(bits, bitorder="little").view(np.uint64)
            met += bool((masks & diff == 0).all(1).any())
        assert met >= 280
