"""A corpus pipeline of five of the operators. Each stage works on all that the one before it kept.

1. Language ID: documents without a recognisable language go (``und``: null text or no letter, or a score below ``LEAST_SCORE``).
2. SimHash near-dedup: of each component of near copies, the document with the least id stays.
3. Substring dedup: words in windows that also start in a document with a smaller id are cut; documents that were nothing else go.
4. Secret scans: secrets that the forest believes in are masked in the texts.
5. Best-fit packing: the documents as pieces in sequences of 2048 tokens.

All but the last return the columns of ``documents``. Between stages a table is written to the shared folder of the cluster, so a lost
executor costs no more than a stage. Null texts, empty tables, repeated rows and extra columns: as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import langid, packing, secrets, simhash, substring
from seqloom.llm.common import table
from seqloom.sources.shared import scratch

#: A text whose likeliest of the learned languages has no more than the others together is taken for none of them.
LEAST_SCORE = 0.5


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(substring.cut(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: A forest, two networks' worth of numpy and a tokenizer are not SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what the stages keep of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
