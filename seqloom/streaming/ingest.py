"""Extension: counts of a stream of reads, kept in a table of counts for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from seqloom.config import CountConfig
from seqloom.operators.kmers import kmer_code_counts, kmer_strings, within


def counting_writer(reads: DataFrame, path: str, checkpoint: str, cfg: CountConfig = CountConfig()) -> DataStreamWriter:
    """Each micro-batch's counts go to ``path/batch=N``, which a batch that runs again overwrites: every read counts once."""

    def write(batch: DataFrame, number: int) -> None:
        kmer_code_counts(batch, cfg.k, hpc=cfg.hpc).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current_counts(spark: SparkSession, path: str, cfg: CountConfig = CountConfig()) -> DataFrame:
    """kmer, cnt of all batches so far."""
    sums = spark.read.parquet(path).groupBy("hi", "lo").agg(F.sum("cnt").alias("cnt"))
    return kmer_strings(within(sums, cfg.min_freq, cfg.max_freq), cfg.k)
