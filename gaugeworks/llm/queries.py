"""The llm queries, each a thin use of its operator over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import (
    decontamination,
    exact_dedup,
    filter_audit,
    language_id,
    license_scan,
    line_dedup,
    merkle,
    packing,
    preference_format,
    ranked_search,
    simhash,
    token_files,
    toxicity,
)
from gaugeworks.llm.common import is_held_out
from gaugeworks.session import scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


@_query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    toxic = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return out.select("doc_id", is_held_out().alias("held_out"), "score", toxic.alias("predicted"))


@_query()
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, limit=4)
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@_query(
    r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
    SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
    """
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of its own for each run, so that a run over the same table again gives the same rows."""
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "digest-index"), f"digests_{uuid.uuid4().hex}")
    out = index.dedup(table(spark, sf_dir, "documents"))
    index.close()  # the rows are checkpointed
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query()
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, _vocabulary(), end_id=2)
    out = token_files.read_token_files(spark, path)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.learn(docs))
    return out.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


@_query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), _vocabulary(), end_id=1)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query(
    r"""
    WITH l AS (SELECT doc_id, source, i, string_split(text, chr(10))[i] AS line
               FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    shared AS (SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
    m AS (SELECT l.*, s.line IS NOT NULL AS gone FROM l LEFT JOIN shared s ON trim(l.line, ' ') = s.line)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
           md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_md5
    FROM m GROUP BY doc_id
    """
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_shared_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


@_query()
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@_query(
    r"""
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, role, text FROM conversations),
    k AS (SELECT conv_id, max(pos) FILTER (WHERE role = 'assistant') AS last_at, count(*) AS n FROM t GROUP BY conv_id),
    w AS (SELECT t.*, k.last_at, k.n,
                 CASE WHEN pos = last_at THEN coalesce((SELECT p.text FROM t p WHERE p.conv_id = t.conv_id AND p.role = 'assistant' AND p.pos < t.pos
                                                       ORDER BY p.pos DESC LIMIT 1), '') ELSE text END AS worse
          FROM t JOIN k USING (conv_id)),
    f AS (SELECT conv_id, coalesce(min(pos) FILTER (WHERE text <> worse), max(n)) AS cut FROM w GROUP BY conv_id),
    s AS (SELECT w.*, f.cut, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS c, '<|' || role || '|>' || chr(10) || worse || '<|end|>' || chr(10) AS r
          FROM w JOIN f USING (conv_id)),
    o AS (SELECT *, coalesce(sum(length(c)) FILTER (WHERE pos >= cut) OVER p, 0) AS cb, coalesce(sum(length(r)) FILTER (WHERE pos >= cut) OVER p, 0) AS rb
          FROM s WINDOW p AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id AS pair_id, CAST(any_value(cut) AS BIGINT) AS n_prompt_turns,
           coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE pos < cut), '') AS prompt,
           coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE pos >= cut), '') AS chosen,
           coalesce(string_agg((cb + 14) || ':' || (cb + length(c) - 1), ',' ORDER BY pos) FILTER (WHERE pos >= cut AND role = 'assistant'), '') AS chosen_spans,
           coalesce(string_agg(r, '' ORDER BY pos) FILTER (WHERE pos >= cut), '') AS rejected,
           coalesce(string_agg((rb + 14) || ':' || (rb + length(r) - 1), ',' ORDER BY pos) FILTER (WHERE pos >= cut AND role = 'assistant'), '') AS rejected_spans
    FROM o GROUP BY conv_id
    """
)
def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has single conversations, so each is paired with a worse end of its own."""
    return preference_format.format_sides(preference_format.repeated_answer(table(spark, sf_dir, "conversations")))


@_query()
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query(
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
    w AS (SELECT d.*, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
    f AS (SELECT w.part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
                 (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
                 + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
                 + 8 * (regexp_matches(text, '[#$%&*|]'))::INT + 16 * (w.doc_id > first_id)::INT AS mask
          FROM w LEFT JOIN labels l USING (doc_id)),
    m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, mask),
    x AS (SELECT unnest([0, 1, 2, 3, 4]) AS k),
    o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a JOIN x b ON b.k <> a.k JOIN x c ON c.k NOT IN (a.k, b.k) JOIN x d ON d.k NOT IN (a.k, b.k, c.k)
          JOIN x e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
    s AS (SELECT array_to_string(list_transform(ks, lambda k: chr(65 + k)), '') AS filter_order, k + 1 AS step,
                 coalesce(list_sum(list_transform(ks[1:k], lambda y: 1 << y)), 0)::INT AS earlier, 1 << ks[k + 1] AS own
          FROM o, x)
    SELECT part, filter_order, CAST(step AS INT) AS step,
           CAST(coalesce(sum(n) FILTER (WHERE mask & (earlier | own) = 0), 0) AS BIGINT) AS kept,
           CAST(coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS removed,
           CAST(coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier <> 0), 0) AS BIGINT) AS redundant,
           CAST(coalesce(sum(n) FILTER (WHERE mask = own), 0) AS BIGINT) AS unique_fails,
           CAST(coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS good_lost,
           CAST(coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0) AS BIGINT) AS toxic_lost,
           CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (WHERE mask & own <> 0), 0) AS BIGINT) AS shapley
    FROM m, s GROUP BY part, filter_order, step
    """
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query(
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term),
    n AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
    p AS (SELECT doc_id, term, m, count(*) AS tf
          FROM (SELECT doc_id, 25 + (75 * len(terms) * n_docs) // n_terms AS m, unnest(terms) AS term FROM d, n WHERE len(terms) > 0)
          WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term, m),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, n GROUP BY term),
    s AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
          FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, doc_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "search-index")
    ranked_search.build_index(table(spark, sf_dir, "documents"), path)
    return ranked_search.search(spark, path, table(spark, sf_dir, "benchmark"))


@_query()
def op12_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.half_replaced(table(spark, sf_dir, "documents"))


@_query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top; the other queries don't need it

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
