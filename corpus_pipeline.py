"""From raw documents to packed sequences: language ID, exact dedup, near dedup, decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes
each stage's rows as Parquet in the shared folder and reads them again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import decontamination, exact_dedup, language_id, near_copies, packing
from gaugeworks.llm.common import anti_join, bound_batches
from gaugeworks.session import checkpointed, scratch_path, table

#: At this many characters half of the noise's bar applies. Short texts hold too few n-grams to be told from noise.
HALF_BAR = 60


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Documents of a known language, or of one of `languages` where these are named.

    Those go that are null, hold no letter, are of another of the learned languages, or whose cosine with every
    learned language is one that noise reaches. The bar rises with the length n of a text, n / (n + HALF_BAR) of the
    noise's, without a step. Very long texts are read whole. Columns may have any name; those of docs are returned as
    they are.
    """
    bound_batches(spark)
    kept = [f"kept_{k}" for k in range(len(docs.columns))]
    plain = docs.select(docs["doc_id"], docs["text"], *(docs[c].alias(k) for c, k in zip(docs.columns, kept, strict=True)))
    scored = language_id.predict(plain, language_id.learn(docs), keep=("text", *kept))
    is_known = F.col("lang_pred") != language_id.UNKNOWN
    if languages is not None:
        is_known &= F.col("lang_pred").isin(*languages)
    is_near = F.col("score") >= language_bar(F.length("text"))
    return scored.where(is_known & is_near).select(*(F.col(k).alias(c) for c, k in zip(docs.columns, kept, strict=True)))


def language_bar(length: Column) -> Column:
    """The least cosine that tells a text of that many characters from noise."""
    return language_id.noise() * length / (length + HALF_BAR)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside; null counts as empty. Rows that repeat an id as well as a text count
    as copies. Very long texts are read whole. Columns may have any name; those of docs are returned as they are."""
    bound_batches(spark)
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "digest-index"), f"digests_{uuid.uuid4().hex}")
    found = index.dedup(docs)
    index.close()
    gone = found.where("NOT kept AND NOT doc_id <=> keep_id").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    names = [f"kept_{k}" for k in range(len(docs.columns))]
    rows = docs.select(docs["doc_id"], exact_dedup.text_digest(docs["text"]).alias("digest"), *(docs[c].alias(k) for c, k in zip(docs.columns, names, strict=True)))
    left = anti_join(rows, gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest")))
    # rows that repeat id and text: only they are shuffled, if there are any
    again = checkpointed(found.groupBy("doc_id", "digest").count().where("count > 1").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")))
    if not again.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone_digest"))
        once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "digest"])
        left = anti_join(left, again, same).union(once)
    return left.select(*(F.col(k).alias(c) for c, k in zip(docs.columns, names, strict=True)))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of gone (doc_id, node): both the id, null or not, and the hash of id and text must meet."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("node").alias("gone_node"))
    names = [f"kept_{k}" for k in range(len(docs.columns))]
    rows = docs.select(docs["doc_id"].alias("id"), near_copies.row_key(docs).alias("node"), *(docs[c].alias(k) for c, k in zip(docs.columns, names, strict=True)))
    left = anti_join(rows, gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("node") == F.col("gone_node")))
    return left.select(*(F.col(k).alias(c) for c, k in zip(docs.columns, names, strict=True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no two of one SimHash group have a similarity of 0.8 or more in runs of five words; of two
    near copies the smaller doc_id stays. Null texts and texts without words stay. Very long texts are read whole.
    Columns may have any name; those of docs are returned as they are."""
    bound_batches(spark)
    return _without(docs, near_copies.near_copies(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are told apart by id and text, so a null or repeated id does no
    harm. Null texts hold nothing and stay. Very long texts are read whole. Columns may have any name; those of docs
    are returned as they are."""
    bound_batches(spark)
    key = F.struct(docs["doc_id"].alias("doc_id"), near_copies.row_key(docs).alias("node"))
    rows = docs.select(F.to_json(key, {"ignoreNullFields": "false"}).alias("row"), docs["text"].alias("text"))
    found = decontamination.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="row").select("doc_id").distinct()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _without(docs, found.select(F.from_json("doc_id", f"doc_id {kind}, node long").alias("row")).select("row.*"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with a checksum of each piece's ids. Null and empty texts are the end id
    alone; very long texts are cut; rows that repeat an id are documents of their own; other columns aren't read."""
    bound_batches(spark)
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't say the hyperdimensional profiles, the XXH64 fingerprints, the tiling or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
