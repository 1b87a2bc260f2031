"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import bpe, htmltext, langid, lzprint, media, packing, secrets, sharding, simhash, substring
from seqloom.llm.common import table


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digest(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op2_bilstm_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_lz_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_local_search_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op6_byte_cnn_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def law_of_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the sequences of op4, which SQL can say: capacity, no gaps, no needless cuts."""
    return packing.packing_law(op4_local_search_packing(spark, sf_dir))


def law_of_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the shards of op7, which SQL can say: their sizes, and slots without gaps."""
    return sharding.shard_law(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_forest,
        op2_bilstm_main_text,
        op3_lz_phrase_fingerprint,
        op4_local_search_packing,
        op5_transducer_bpe,
        op6_byte_cnn_language_id,
        op7_two_pass_shuffle,
        op8_tiff_pages,
        op9_simhash_near_dedup,
        op10_prefix_suffix_trees,
        law_of_op4,
        law_of_op7,
    )
}

#: Of the others none can be put in DuckDB's SQL as a whole (forests, networks, tokenizers, image files, seeded permutations, XXH64); tests/llm hold
#: each against a brute-force version, the library it equals or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "law_of_op4": packing.LAW_SQL,
    "law_of_op7": sharding.LAW_SQL,
    "op10_prefix_suffix_trees": r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), labels AS (
    SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i,
           unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i : i + 49], ' ')))) AS h
    FROM words WHERE len(ws) >= 50
), least AS (
    SELECT h, min(doc_id) AS first_id FROM labels GROUP BY h
), marked AS (
    SELECT DISTINCT l.doc_id, l.i FROM labels l JOIN least USING (h) WHERE first_id < l.doc_id
), each AS (
    SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS w FROM words
), covered AS (
    SELECT e.doc_id, e.j, e.w, max(m.i) OVER (PARTITION BY e.doc_id ORDER BY e.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
    FROM each e LEFT JOIN marked m ON e.doc_id = m.doc_id AND e.j = m.i
), kept AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS t FROM covered GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words d LEFT JOIN kept k USING (doc_id)
""",
}
