import random
import re
import time
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gaugeworks.llm import language_id, near_copies
from gaugeworks.llm.common import is_held_out
from tests.llm.helpers import closure
from tests.llm.test_dedup import DOCS, ODD
from tests.llm.test_text_ops import words_of
from tests.llm.test_tokens import crc

SF = "/root/testdata/sf0.001"


def plain_run(spark, docs):
    """What is left, by loops over all documents."""
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: left[i] for i in first.values()}
    groups = closure(left, near_pairs({i: shingle_set(t) for i, t in left.items()}))
    left = {i: t for i, t in left.items() if groups[i] == i}  # no chain of this table passes a larger id
    whole = lambda doc, item: any(doc[k : k + len(item)] == item for k in range(len(doc) - len(item) + 1))
    return {i: t for i, t in left.items() if not any(whole(words_of(t), item) for item in items)}


def test_stages_and_result(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    want = plain_run(spark, docs)
    assert {r.doc_id for r in rows} == set(want)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in want.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert [p[0] for p in pieces] == [0, *(p[0] + p[1] for p in pieces[:-1])]
        assert all(crc(ids[a : a + n]) == c for a, n, c in pieces) and pieces[-1][0] + pieces[-1][1] == len(ids)


def test_stages_keep_clean_rows_and_columns(spark):
    known = spark.read.parquet(f"{SF}/documents.parquet")
    odd = known.unionByName(spark.createDataFrame([(None if i is None else i + 5000, t, None, None, None) for i, t in ODD], DOCS))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == known.columns, name
        assert out.where("doc_id = 5009").count() == 1, name
        assert stage(spark, known.limit(0), SF).count() == 0, name
    left = corpus_pipeline.drop_exact_copies(spark, odd, SF).where("doc_id > 5000").select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in left) == [5001, 5003, 5004, 5005, 5006, 5008, 5009]


CLASHES = "score lang_pred text_digest gone_id fp digest item_id node grp kept_0 key batch ids start held bucket".split()


def test_columns_of_any_name_come_through_every_stage(spark):
    known = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    odd = known
    for k, name in enumerate(CLASHES):
        odd = odd.withColumn(name, F.concat(F.lit(f"{k}:"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{k}:{r.doc_id}" for r in rows for k, c in enumerate(CLASHES)), name
        assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, known, SF).collect()}, name
    pack = corpus_pipeline.STAGES[-1][1]
    assert sorted(map(tuple, pack(spark, odd, SF).drop("sequence_id").collect())) == sorted(map(tuple, pack(spark, known, SF).drop("sequence_id").collect()))


def test_language_stage_drops_other_languages_and_texts_of_none(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    greek = "η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί και φεύγει μακριά από το δάσος "
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki "
    digits = "12 34 !? 56 -- 78 " * 9
    made = spark.createDataFrame([(9001, greek * 5, None, None, None), (9002, finnish * 4, None, None, None), (9003, digits, None, None, None), (9004, None, None, None, None)], DOCS)
    docs = known.unionByName(made)
    left = corpus_pipeline.identify_language(spark, docs, SF)
    assert left.where("doc_id > 9000").count() == 0
    only = corpus_pipeline.identify_language(spark, docs, SF, languages=("en", "fr")).groupBy("lang").count().collect()
    assert {r.lang for r in only} == {"en", "fr"} and sum(r["count"] for r in only) == known.where("lang IN ('en', 'fr')").count()


def test_noise_bar_keeps_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    scored = language_id.predict(docs, language_id.learn(docs), keep=("text", "lang"))
    unseen = scored.where(is_held_out() & (F.length("text") > 0)).where("lang_pred = lang")
    low, n = unseen.where(F.col("score") < corpus_pipeline.language_bar(F.length("text"))).count(), unseen.count()
    assert n > 2000 and low <= n / 1000


def test_language_stage_keeps_every_text_with_letters_of_a_known_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gone = docs.join(corpus_pipeline.identify_language(spark, docs, SF), "doc_id", "left_anti").collect()
    assert all(language_id.Letters().bundle(r.text or "") is None for r in gone)


def test_near_stage_leaves_no_two_texts_of_five_word_similarity_of_four_fifths(spark):
    docs = corpus_pipeline.drop_exact_copies(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL"), SF)
    word = lambda k: f"w{k}"
    base = [word(k) for k in range(60)]
    # 50 near copies of one text, each with another last word; two rows of one id, of which one is near; null ids
    made = [(9000 + k, " ".join(base[:59] + [f"x{k}"])) for k in range(50)]
    made += [(8000, " ".join(base)), (8000, "something else that is near to nothing"), (None, " ".join(base[:59] + ["y"])), (None, "a null id that is near to nothing")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in made], DOCS)).checkpoint()
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).select("doc_id", "text").collect()]
    texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    sets = {row: shingle_set(row[1]) for row in texts}
    near = near_pairs(sets)
    assert len(near) > 1200
    assert len(set(left)) == len(left) and set(left) <= texts
    assert not any(a in set(left) and b in set(left) for a, b in near)
    tied = {row for pair in near for row in pair}
    assert texts - set(left) <= tied
    assert {(8000, made[50][1]), (8000, made[51][1]), made[53]} <= set(left) and made[52] not in left


def test_near_stage_finds_nine_of_ten_pairs_of_different_text(spark):
    """Recall over pairs of 0.8 and more whose texts differ by more than white space, on the largest table."""
    docs = corpus_pipeline.drop_exact_copies(spark, spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL"), SF).checkpoint()
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    near = near_pairs(sets)
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).select("doc_id").collect()}
    caught = sum(not (a in left and b in left) for a, b in near)
    print(f"{caught} of {len(near)} pairs")
    assert len(near) > 40 and caught >= 0.9 * len(near)
    assert set(sets) - left <= {i for pair in near for i in pair}


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def near_pairs(sets):
    """All pairs at 0.8 and more: each pair that shares any shingle is counted, in numbered rows."""
    rows = sorted(sets, key=repr)
    at = defaultdict(list)
    for k, row in enumerate(rows):
        for x in sets[row]:
            at[x].append(k)
    out = []
    for k, row in enumerate(rows):
        both = Counter()
        for x in sets[row]:
            both.update(j for j in at[x] if j < k)
        n = len(sets[row])
        out += [(rows[j], row) for j, c in both.items() if c >= 0.8 * (n + len(sets[rows[j]]) - c)]
    return out


def test_loosely_linked_texts_stay_and_cost_little(spark):
    """Texts of four passages each out of a few dozen: many links, few near pairs, and no round for each of them."""
    draw = random.Random(4)
    passages = [" ".join(f"p{k}w{j}" for j in range(60)) for k in range(24)]
    texts = {}
    for k in range(900):
        own = " ".join(f"own{k}x{j}" for j in range(12))
        texts[k] = " ".join([*(passages[j] for j in draw.sample(range(24), 4)), own])
    texts |= {900 + k: texts[k] + " tail" for k in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    near = near_pairs({i: shingle_set(t) for i, t in texts.items()})
    want = {max(a, b) for a, b in near}
    began = time.time()
    gone = {r.doc_id for r in near_copies.near_copies(docs).collect()}
    assert time.time() - began < 120
    assert gone <= want and set(range(900, 920)) <= gone and len(gone) >= 0.9 * len(want)


def test_what_goes_does_not_depend_on_bucket_sizes(spark, monkeypatch):
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join([*base[:at], f"c{at}", *base[at + 1 :]]) for at in range(60)] + [" ".join(f"v{k + s}" for k in range(70)) for s in range(0, 700, 70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: {r.doc_id for r in near_copies.near_copies(docs).collect()}
    first = found()
    plain = near_copies.link_edges
    monkeypatch.setattr(near_copies, "link_edges", lambda nodes: plain(nodes, bucket_rows=3))
    assert found() == first == {max(p) for p in near_pairs({k: shingle_set(t) for k, t in enumerate(texts)})}


def test_near_pairs_meet_alike_by_broadcast_and_in_parts(spark, monkeypatch):
    word = lambda k: f"w{k % 97}x{k}"
    base = [word(k) for k in range(120)]
    texts = [" ".join([*base[:at], "changed", *base[at + 1 :]]) for at in range(30)] + [" ".join(word(k) for k in range(s, s + 90)) for s in (1000, 2000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = lambda: {r.doc_id for r in near_copies.near_copies(docs).collect()}
    first = found()
    assert first == set(range(1, 30))
    monkeypatch.setattr(near_copies, "HOT_BYTES", 0)
    monkeypatch.setattr(near_copies, "PART_PAIRS", 4)
    assert found() == first
