import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugeworks.llm import packing, queries, token_files
from gaugeworks.llm.words import WordIds
from tests.llm.test_dedup import DOCS, ODD

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(end, rows):
    return {i: WHOLE.encode(t or "", add_special_tokens=False).ids + [end] for i, t in rows}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZé.Σς'sd ,!?<|endoftx>\t\x0b\x1c\x85 ́ 1ßİ漢\n")), max_size=40))
def test_words_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(words.text(text.encode()), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


words = WordIds(PATH, most=50)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aZé.Σ's -4<|endoftx>\x00\x1c\x85\n ́ßªµÿĀK$")), max_size=30)), max_size=6), st.integers(0, 3), st.sampled_from([pa.string(), pa.large_string()]))
def test_many_texts_at_once_give_the_ids_of_each(texts, skip, kind):
    got = words.texts(pa.array(texts, kind).slice(skip))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [WHOLE.encode(t or "", add_special_tokens=False).ids for t in texts[skip:]]


def test_words_that_may_not_be_cut_are_encoded_whole():
    held = WordIds(PATH)
    held.direct = False
    text = "Aé's b-2  x<|endoftext|> Straße!!"
    assert np.frombuffer(held.text(text.encode()), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_the_tokenizer_is_asked_once_for_each_piece(monkeypatch):
    """Cases and signs make many words of few pieces; each word that went to the tokenizer cost most of op3's time."""
    held = WordIds(PATH)
    signs = [a + b for a in ["", ".", ",", "!!", "'s"] for b in ["", "$$$", "%%%", "-2"]]
    text = " ".join(f(w) + s for w in ("ofthnon", "erlich", "ciónos", "weiß") for f in (str.lower, str.capitalize) for s in signs)
    asked = []
    for name in ("_encode", "_model"):
        monkeypatch.setattr(held, name, lambda word, f=getattr(held, name): asked.append(word) or f(word))
    ids = held.text(text.encode())
    assert np.frombuffer(ids, "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) <= 4 + len(set(signs))
    assert held.text(text.encode()) == ids and len(asked) <= 4 + len(set(signs))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.data())
def test_blocks_round_trip_whole_and_in_parts(ids, data):
    segment = token_files.Segment(token_files.write_segment([7, None], [np.array(ids, "<u4").tobytes(), b""]))
    assert segment.ids().tolist() == ids
    assert segment.doc_ids.tolist() == [7, token_files.NO_ID] and segment.counts.tolist() == [len(ids), 0]
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert segment.ids(a, b).tolist() == ids[a:b]


def test_outliers_do_not_widen_a_block():
    ids = np.full(1280, 5, "<u4")
    ids[::100] = 2**31
    assert len(token_files.pack_blocks(ids)[1]) < 10 * 6 + 13 * 5 + 1


def test_op3_equals_the_tokenizer(spark, texts):
    got = {r.doc_id: r for r in queries.queries()["op3_token_files"](spark, SF).collect()}
    at = 0
    for i, ids in sorted(encoded(2, texts.items()).items()):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(texts)


def check_pieces(rows, want, window):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, ids, r.doc_tokens))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    for i, ids in want.items():
        parts = sorted(by_doc[i])
        assert sum((p[1] for p in parts), []) == ids
        assert all(p[2] == len(ids) for p in parts)
    assert by_doc.keys() == want.keys()
    return by_seq


def test_op8_pieces_hold_each_id_once_with_little_padding(spark, texts):
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), PATH, 1).collect()
    want = encoded(1, texts.items())
    seqs = check_pieces(rows, want, 2048)
    lengths = [sum(n for _, n in x) for x in seqs.values()]
    pad = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths)
    assert pad / sum(lengths) < 0.02 + 2048 * 4 / sum(lengths)  # the last sequence of each task besides
    got = queries.queries()["op8_packing"](spark, SF).collect()
    assert {(r.doc_id, r.start): r.ids_crc32 for r in got} == {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in rows}


def plain_cost(at, penalty, window):
    free = packing.unpadded_lengths(window)
    place, best = [0, *at], [0]
    for j in range(1, len(place)):
        best.append(min(best[i] + penalty[j - 1] + (0 if place[j] - place[i] in free else window - (place[j] - place[i])) for i in range(j) if place[j] - place[i] <= window))
    return best[-1]


def test_cuts_are_the_cheapest():
    rng = random.Random(1)
    for _ in range(300):
        window = rng.choice([16, 32, 50])
        at = np.cumsum([rng.randint(1, window) for _ in range(rng.randint(1, 40))]).tolist()
        penalty = [rng.choice([0, 3, 9]) for _ in at]
        cuts = packing.best_cuts(at, penalty, window)
        cost, last = 0, 0
        for c in cuts:
            n = c - last
            cost += penalty[at.index(c)] + (0 if n in packing.unpadded_lengths(window) else window - n)
            assert n <= window
            last = c
        assert last == at[-1] and cost == plain_cost(at, penalty, window)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], DOCS).withColumn("ids", docs_col()).withColumn("start", docs_col())
    path = f"{spark.conf.get('spark.checkpoint.dir')}/odd-tokens"
    token_files.write_token_files(docs, path, PATH, 2)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens) for r in token_files.read_token_files(spark, path).collect())
    assert len(got) == len(ODD) and got[0][0] is False and got[0][2] == 0
    assert all(a[2] + a[3] == b[2] for a, b in zip(got, got[1:], strict=False))
    rows = packing.pack(docs, PATH, 1, window=64).collect()
    want = [WHOLE.encode(t or "", add_special_tokens=False).ids + [1] for _, t in ODD]
    assert sum(r.length for r in rows) == sum(map(len, want))
    empty = docs.limit(0)
    assert packing.pack(empty, PATH, 1).count() == 0
    token_files.write_token_files(empty, path + "-none", PATH, 2)
    assert token_files.read_token_files(spark, path + "-none").count() == 0


def docs_col():
    from pyspark.sql import functions as F

    return F.lit("clash")
