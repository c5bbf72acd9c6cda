"""Filter audit, Merkle fingerprints and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest

from gaugeworks.llm import filter_audit, merkle, ranked_search
from gaugeworks.session import scratch_path

WORDS = "amber birch cedar delta ember fjord grove haven inlet Juniper KELP larch".split()


def texts(n, seed=5):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        words = [draw.choice(WORDS) + draw.choice(["", "", "", ".", " |", "\n"]) for _ in range(draw.choice([0, 1, 3, 40, 60, 90]))]
        out.append(" ".join(words))
    return [*out, None, "", out[3], out[3], "é" * 500, "A B C " * 40]


# -- filter audit


def fails(rows, k):
    i, text, _ = rows[k]
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    is_copy = any((t or "") == text and j is not None and (i is None or j < i) for j, t, _ in rows)
    return (
        len(words) < 50,
        100 * len(set(words)) < 65 * len(words),
        100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
        is_copy,
    )


def audited(rows, labels):
    flags = [fails(rows, k) for k in range(len(rows))]
    good = [any(i is not None and j == i and q == 1 for j, q, _ in labels) for i, _, _ in rows]
    toxic = [any(i is not None and j == i and t == 1 for j, _, t in labels) for i, _, _ in rows]
    out, shapley = {}, Counter()
    for part in {p or "" for _, _, p in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations(range(5)):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if flags[k][f]]
                left = [k for k in left if not flags[k][f]]
                redundant = sum(flags[k][f] for k in own) - len(gone)
                unique = sum(flags[k][f] and sum(flags[k]) == 1 for k in own)
                shapley[part, f] += len(gone)
                name = "".join("ABCDE"[x] for x in order)
                out[part, name, step] = [len(left), len(gone), redundant, unique, sum(good[k] for k in gone), sum(toxic[k] for k in gone), f]
    return {key: tuple(v[:6] + [shapley[key[0], v[6]]]) for key, v in out.items()}


def test_audit_equals_brute_force(spark):
    all_texts = texts(30)
    parts = ["x", "y", None, ""]
    rows = [(k if k % 11 else None, t, parts[k % 4]) for k, t in enumerate(all_texts)]
    rows += [rows[5], rows[5], (5, "other text under one id", "x")]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 30, 2)] + [(4, None, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, part int, word string")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audited(rows, labels)
    assert len(got) == len(want) == 3 * 600
    for r in got:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == want[r.part, r.filter_order, r.step]


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# -- Merkle fingerprints


def test_half_replaced_equals_brute_force(spark):
    rows = [(3 * k if k != 7 else None, t) for k, t in enumerate(texts(60))]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, kind string").repartition(7)
    got = {r.doc_id: r for r in merkle.half_replaced(docs).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    prints = {}
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
        assert r.edited_fingerprint == merkle.Tree(edited).fingerprint()
        assert r.near_edited == merkle.compare(r.fingerprint, r.edited_fingerprint) and 0 <= r.near_edited <= 1
        assert r.near_next == merkle.compare(r.fingerprint, merkle.Tree(after).fingerprint())
        prints.setdefault(text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert len({v for x in prints.values() for v in x}) == len(prints)


def test_half_replaced_of_one_repeated_and_no_row(spark):
    one = merkle.half_replaced(spark.createDataFrame([(1, "lonely text")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"lonelylonel").hexdigest()
    same = merkle.half_replaced(spark.createDataFrame([(1, "same")] * 500, "doc_id long, text string")).collect()
    assert len(same) == 500 and {r.near_next for r in same} == {1.0}
    assert merkle.half_replaced(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_follows_what_stays(spark):
    draw = random.Random(3)
    prose = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) + draw.choice([""] * 9 + [".", ".\n"]) for _ in range(n))
    for n in (3, 12, 40, 200, 3000):
        for _ in range(10):
            text, other = prose(n), prose(n)
            half = len(text) // 2
            near = merkle.compare(merkle.Tree(text).fingerprint(), merkle.Tree(text[: len(text) - half] + other[:half]).fingerprint())
            assert 0.2 < near < 0.75, (n, near)
            assert merkle.compare(merkle.Tree(text).fingerprint(), merkle.Tree(other).fingerprint()) < 0.2
            moved = merkle.compare(merkle.Tree(text).fingerprint(), merkle.Tree("inserted words " + text).fingerprint())
            assert n < 40 or moved > 0.75
    assert merkle.compare(merkle.Tree("").fingerprint(), merkle.Tree("").fingerprint()) == 1
    assert merkle.compare(merkle.Tree("").fingerprint(), merkle.Tree("x").fingerprint()) == 0
    repeated = "und " * 4000
    assert merkle.compare(merkle.Tree(repeated).fingerprint(), merkle.Tree(repeated[:8000] + prose(1500)[:8000]).fingerprint()) > 0.3
    frame = spark.createDataFrame([("a b", "a b"), (None, "x")], "a string, b string")
    assert [r.v for r in frame.select(merkle.likeness(frame.a, frame.b).alias("v")).collect()] == [1.0, None]


@pytest.mark.parametrize("at", [0, 700, 2500])
def test_edits_are_located(spark, at):
    draw = random.Random(9)
    text = "".join(" ".join(draw.choice(WORDS) for _ in range(12)) + draw.choice([".\n", ".\n\n"]) for _ in range(60))
    new = text[:at] + "PLANTED WORDS HERE " + text[at + 5 :]
    before = spark.createDataFrame([(1, text), (2, "same"), (3, "gone"), (None, "null")], "doc_id long, text string")
    after = spark.createDataFrame([(1, new), (2, "same"), (4, "come"), (None, None)], "doc_id long, text string")
    rows = merkle.edits(before, after).collect()
    spans = sorted((r.start, r.end, r.new_start, r.new_end) for r in rows if r.doc_id == 1)
    rebuilt, done = "", 0
    for a, b, c, d in spans:
        rebuilt, done = rebuilt + text[done:a] + new[c:d], b
    assert rebuilt + text[done:] == new
    assert sum(d - c for _, _, c, d in spans) < 200
    assert {(r.doc_id, r.start, r.end, r.new_start, r.new_end) for r in rows if r.doc_id != 1} == {(3, 0, 4, 0, 0), (4, 0, 0, 0, 4), (None, 0, 4, 0, 0)}


# -- ranked search


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, items):
    held = [(i, Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    out = set()
    for item, text in items:
        wanted = Counter(terms_of(text))
        scored = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = 0
            for term, times in wanted.items():
                if c[term]:
                    df = sum(x[term] > 0 for _, x in held)
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out |= {(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:10], 1)}
    return out


@pytest.mark.parametrize("shard_terms,block_terms", [(40, 7), (1000, 400_000)])
def test_search_equals_brute_force(spark, shard_terms, block_terms):
    draw = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)] + ["Straße", "ÉCOLE", "x9"]
    docs = [(k, " ".join(draw.choices(vocabulary, [1 / (j + 1) for j in range(63)], k=draw.choice([0, 1, 5, 30])))) for k in range(150)]
    docs += [(500, None), (None, "w3 w50"), (7, "w3-W50"), (8, "w3 w50"), (9, "w3 w50"), (10, "??")]
    items = [(1, "w0 w1 W50 w50"), (2, "straße École"), (3, None), (4, "nowhere"), (5, "w3; w50"), (6, " ".join(vocabulary)), (7, "w0")]
    path = scratch_path(spark, "search-test")
    ranked_search.build_index(spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, term string").repartition(3), path, shard_terms=shard_terms)
    got = ranked_search.search(spark, path, spark.createDataFrame(items, "item_id long, text string"), block_terms=block_terms)
    assert {tuple(r) for r in got.collect()} == ranked(docs, items)


def test_search_of_nothing(spark):
    path = scratch_path(spark, "search-test")
    ranked_search.build_index(spark.createDataFrame([], "doc_id long, text string"), path)
    assert ranked_search.search(spark, path, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    path = scratch_path(spark, "search-test")
    ranked_search.build_index(spark.createDataFrame([(1, "a")], "doc_id long, text string"), path)
    assert ranked_search.search(spark, path, spark.createDataFrame([], "item_id long, text string")).count() == 0
