"""Near copies: SimHash retrieval over wide fingerprints, then the exact Jaccard similarity of five-word shingles.

A text's fingerprint has BITS = 256 bits over its distinct shingles. Two texts with a similarity of 0.8 have a cosine
of at least 2 * 0.8 / 1.8, so that each bit differs with a chance of at most 1 - SAME = 0.152; LIMIT lies three
standard deviations above the mean. No choice of whole blocks finds all pairs that far apart at a bearable price, so
buckets are cut by masks of random bits: as many masks as leave a pair at 0.8 out of every bucket with a chance of
MISS. Inside a bucket the search is the Gray-order index of simhash.py, which is exact. Texts that its links connect
are a group.

In a group the pairs at 0.8 are found on whole sets of shingles, exactly, in three steps of which each looks only at
texts for which the steps before found no near text of a smaller rank. First all are compared with the group's
smallest, which settles most of a group of copies. Then a prefix filter applies: of a set of n shingles, ordered by the
number of the group's texts that hold them, the first n - ceil(4 n / 5) + 1 are its prefix, and two sets at 0.8 share
a shingle of their prefixes. A text is compared with the smallest of each of these shingles, and then with all others
that share one at a place behind which enough of both sets is left. Rare shingles come first, so texts that differ in more
than a ninth of their shingles have few partners; no step lists a group's pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log1p, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import simhash
from gaugeworks.llm.common import HOT_SHARE, SMALL_ROWS, gathered, join_by_group, pick, raw_texts, semi_join, slices
from gaugeworks.llm.components import components
from gaugeworks.session import checkpointed

WORDS, NUMBERS, LIMIT, SAME, MISS = 5, 4, 56, 0.848, 0.01
BITS = 64 * NUMBERS
HOT_BYTES, PART_PAIRS = 65_536, 256
FPS = tuple(f"fp{k}" for k in range(NUMBERS))


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of WORDS words, A-Z lowered."""
    return np.unique(np.array(simhash._shingle_hashes(text, WORDS), np.uint64))


def is_near(a: bytes, b: bytes) -> bool:
    """Whether two sets, as written by shingles(), have a similarity of 4 / 5 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A number of a row's id and text, so that rows are told apart where ids are null or repeat."""
    return F.xxhash64(docs[id_col], docs[text_col])


def random_masks(n: int, miss: float = MISS) -> list[list[int]]:
    """Masks of random bits, each as NUMBERS signed numbers, for n fingerprints.

    Wider masks make smaller buckets, but take more of them: a mask of w bits holds a pair with a chance of SAME ** w.
    The width is that of least cost, if a shuffled row costs as much as 200 comparisons. Any width has the same `miss`.
    """
    cost = lambda w: (1 + n / 2**w / 200) / SAME**w
    width = min(range(8, 41), key=cost)
    count = ceil(log(miss) / log1p(-(SAME**width)))
    draw = np.random.default_rng(17)
    out = []
    for _ in range(count):
        bits = [int(b) for b in draw.choice(BITS, width, replace=False)]
        out.append([simhash._signed(sum(1 << (b % 64) for b in bits if b // 64 == k)) for k in range(NUMBERS)])
    return out


def _fingerprinted(rows: DataFrame) -> DataFrame:
    """(node, doc_id, *FPS) of the rows that have a word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                held = [shingles(t) for t in raw_texts(part, "text")]
                found = np.array([simhash._fingerprint(h, NUMBERS) for h in held])
                has = pa.array([len(h) > 0 for h in held])
                columns = [part.column("node"), part.column("doc_id"), *(pa.array(found[:, k]) for k in range(NUMBERS))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "doc_id", *FPS]).filter(has)

    return rows.mapInArrow(work, f"node long, doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{f} long" for f in FPS))


def link_edges(nodes: DataFrame, limit: int = LIMIT, bucket_rows: int = 2000) -> DataFrame:
    """Edges (u, v) over nodes (node, *FPS): each connects two that share a bucket and are connected in it by pairs
    of `limit` or fewer differing bits.

    A bucket of more than bucket_rows is far more than masks that wide let meet by chance, so it is a dense group.
    It isn't searched: all its members are linked to its smallest, without any of them meeting in one task.
    """
    spark = nodes.sparkSession
    masks = random_masks(nodes.count())
    names = [f"mask{k}" for k in range(NUMBERS)]
    table = spark.createDataFrame([(0, k, *m) for k, m in enumerate(masks)], "cut int, nth int, " + ", ".join(f"{x} long" for x in names))
    rows = nodes.withColumn("cut", F.lit(0)).join(F.broadcast(table), "cut")  # some hundred masks at most
    rows = rows.select(F.xxhash64("nth", *(F.col(f).bitwiseAND(F.col(m)) for f, m in zip(FPS, names, strict=True))).alias("bucket"), "node", *FPS)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
    large = checkpointed(sizes.where(F.col("size") > bucket_rows))
    if large.isEmpty():
        return simhash._bucket_edges(rows, limit, FPS)
    members = checkpointed(semi_join(rows.select("bucket", "node"), large.select("bucket"), "bucket"))
    star = join_by_group(members, large, "bucket", "size", members.count()).where("node <> least")
    small = rows.join(F.broadcast(large.select("bucket")), "bucket", "left_anti")  # at most rows / bucket_rows of them
    return simhash._bucket_edges(small, limit, FPS).union(star.select(F.col("node").alias("u"), F.col("least").alias("v")))


def _sets(rows: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [shingles(t).tobytes() for t in raw_texts(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], ["node", "held"])

    return rows.select("node", "text").mapInArrow(work, "node long, held binary")


def _near(pairs: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """(doc_id, node): `gone` of the pairs (u, v, gone) that are near. A node u has few partners, but v may have many.

    A set that at least HOT_SHARE of the pairs need, so one of 1 / HOT_SHARE at most, is broadcast if it has no more
    than HOT_BYTES: some 64 MB in all. Any other is copied for every PART_PAIRS of its pairs, which meet it in
    different tasks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "held"):
                a, b = part.column("held").to_pylist(), part.column("v_held").to_pylist()
                keep = pa.array([is_near(x, y) for x, y in zip(a, b, strict=True)], pa.bool_())
                yield part.select(["doc_id", "node"]).filter(keep)

    n = pairs.count()
    if n == 0:
        return pairs.select("gone.doc_id", "gone.node")
    # few pairs go to the sets, which are wide, and not the other way
    few = F.broadcast if n <= SMALL_ROWS else lambda df: df
    kinds = sets.select(F.col("node").alias("v"), F.length("held").alias("bytes")).join(few(pairs.groupBy("v").count()), "v")
    is_hot = (F.col("count") >= max(2, int(n * HOT_SHARE))) & (F.col("bytes") <= HOT_BYTES)
    kinds = checkpointed(gathered(kinds.select("v", "count", is_hot.alias("hot"), F.ceil(F.col("count") / PART_PAIRS).alias("parts")), rows))
    dealt = pairs.join(F.broadcast(kinds), "v") if n <= SMALL_ROWS else join_by_group(pairs, kinds, "v", "count", n)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("u"), "parts")).drop("parts", "count")
    left = sets.select(F.col("node").alias("u"), "held").join(few(dealt), "u")
    right = sets.select(F.col("node").alias("v"), F.col("held").alias("v_held")).join(few(kinds), "v")
    wanted = [F.col("gone.doc_id"), F.col("gone.node"), F.col("held"), F.col("v_held")]
    at_hot = left.where("hot").join(F.broadcast(right.where("hot").select("v", "v_held")), "v").select(*wanted)
    parted = right.where("NOT hot").select("v", "v_held", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = at_hot.union(left.where("NOT hot").join(parted.hint("merge"), ["v", "part"]).select(*wanted))
    met = gathered(met, n, 2000)
    kind = dict(pairs.select("gone.doc_id").dtypes)["doc_id"]
    return met.mapInArrow(work, f"doc_id {kind}, node long").distinct()


def groups_of(docs: DataFrame) -> DataFrame:
    """(node, doc_id, grp) of every row (node, doc_id, text) that a link, or an equal fingerprint, connects
    with another; grp names the group."""
    fps = checkpointed(_fingerprinted(docs).dropDuplicates(["node"]).withColumn("fp", F.xxhash64(*FPS)))
    n = fps.count()
    fps = gathered(fps, n)
    kinds = checkpointed(fps.groupBy("fp").agg(F.min(F.struct("node", *FPS)).alias("one"), F.count(F.lit(1)).alias("copies")))
    kinds = gathered(kinds, n)
    found = components(link_edges(kinds.select("one.*")))
    found = F.broadcast(found) if found.count() <= SMALL_ROWS else found  # as many rows as linked fingerprints
    kinds = kinds.select("fp", "copies", F.col("one.node").alias("node")).join(found, "node", "left")
    kinds = checkpointed(kinds.select("fp", "copies", F.coalesce("component", "node").alias("grp")))
    members = kinds.groupBy("grp").agg(F.sum("copies").alias("members")).where("members > 1")
    kinds = checkpointed(semi_join(kinds, checkpointed(members.select("grp")), "grp"))
    return join_by_group(fps, kinds, "fp", "copies", n).where("grp IS NOT NULL").select("node", "doc_id", "grp")


def _prefixes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, grp, rank, size, at, shingle): the prefix of each member's set, rarest shingles of its group first, with
    their places from 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "held", 400_000):
                held = [np.frombuffer(x, np.int64) for x in part.column("held").to_pylist()]
                sizes = np.array([len(x) for x in held], np.int64)
                at = pa.array(np.repeat(np.arange(len(held)), sizes))
                columns = [part.column(c).take(at) for c in ("node", "grp", "rank")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes).take(at), pa.array(np.concatenate(held))], ["node", "grp", "rank", "size", "shingle"])

    kinds = dict(members.dtypes)
    met = members.select("node", "grp", "rank").join(sets.select("node", "held"), "node")
    rows = met.mapInArrow(work, f"node long, grp {kinds['grp']}, rank {kinds['rank']}, size long, shingle long")
    rows = checkpointed(rows)
    often = rows.groupBy("grp", "shingle").agg(F.count(F.lit(1)).alias("texts"))
    ordered = rows.join(often, ["grp", "shingle"]).groupBy("node", "grp", "rank", "size").agg(F.array_sort(F.collect_list(F.struct("texts", "shingle"))).alias("s"))
    length = F.col("size") - F.ceil(4 * F.col("size") / 5) + 1
    return ordered.select("node", "grp", "rank", "size", F.posexplode(F.slice("s", 1, length.cast("int"))["shingle"]).alias("at", "shingle"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node): the id and row_key() of each row that goes: those to which a text of smaller rank in their
    group is near, at a similarity of 0.8 or more. Ranks follow ids, a null id after all others.

    So of the texts that stay no two of a group are near, and from each that goes a chain of near texts with smaller
    and smaller ids leads to one that stays. Null texts and texts without words are near to none. Rows that repeat
    both id and text share their fate. Other columns are not read. An empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("node", F.xxhash64("doc_id", "text"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node").alias("rank")
    members = checkpointed(groups_of(rows).select("node", "grp", rank))
    total = members.count()
    members = gathered(members, total)
    sets = gathered(checkpointed(_sets(semi_join(rows, members.select("node"), "node")).dropDuplicates(["node"])), total, 5000)
    few = F.broadcast if total <= SMALL_ROWS else lambda df: df  # there are no more groups, or texts that go, than members
    firsts = checkpointed(gathered(members.groupBy("grp").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")), total))
    if total <= SMALL_ROWS:
        met = members.join(F.broadcast(firsts), "grp")
    else:
        met = join_by_group(members, firsts, "grp", "n", total)
    open_ = met.where(F.col("rank") > F.col("first")).select("node", "grp", "rank", F.col("first.node").alias("v"))
    pairs = checkpointed(gathered(open_.select(F.col("node").alias("u"), "v", F.col("rank").alias("gone")), total))
    gone = checkpointed(gathered(_near(pairs, sets, total), total))
    left = checkpointed(gathered(open_.drop("v").join(few(gone.select("node")), "node", "left_anti"), total))
    if left.isEmpty():
        return gone
    groups = checkpointed(gathered(left.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), total))
    held = members.join(few(groups.select("grp")), "grp", "left_semi")
    prefixes = checkpointed(gathered(_prefixes(held, sets), 20 * total, 200_000))
    own = prefixes.join(few(left.select("node")), "node", "left_semi").withColumnsRenamed({"size": "own_size", "at": "own_at"})
    smallest = prefixes.groupBy("grp", "shingle").agg(F.min(F.struct("rank", "size")).alias("other"))
    fits = (F.col("other.rank") < F.col("rank")) & (5 * F.least("own_size", "other.size") >= 4 * F.greatest("own_size", "other.size"))
    named = [F.col("node").alias("u"), F.col("other.rank.node").alias("v"), F.col("rank").alias("gone")]
    pairs = checkpointed(gathered(own.join(smallest, ["grp", "shingle"]).where(fits).select(*named).distinct(), total))
    more = checkpointed(gathered(_near(pairs, sets, total), total))
    own = own.join(few(more.select("node")), "node", "left_anti")
    others = prefixes.select("grp", "shingle", F.struct("rank", "size", "at").alias("other"))
    # behind the first shingle that both hold must stand enough for an overlap of 4 / 9 of both sizes
    enough = 9 * F.least(F.col("own_size") - F.col("own_at"), F.col("other.size") - F.col("other.at")) >= 4 * (F.col("own_size") + F.col("other.size"))
    rest = own.join(others, ["grp", "shingle"]).where(fits & enough).select(*named).distinct()
    rest = checkpointed(rest.join(pairs.select("u", "v"), ["u", "v"], "left_anti"))
    last = checkpointed(gathered(_near(rest, sets, total), total))
    return gone.union(more).union(last)
