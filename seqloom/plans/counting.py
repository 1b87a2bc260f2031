"""Whole runs: from files or a table of reads to counts, totals and statistics, with wall times."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.config import CountConfig
from seqloom.functions.sequence import NOT_BASES
from seqloom.operators import kmers as K
from seqloom.operators import superkmers as SK
from seqloom.sources import reads as R

log = logging.getLogger("seqloom")


def timed(name: str, action: Callable[[], object]) -> object:
    start = time.perf_counter()
    out = action()
    log.info("%s: %.2f s", name, time.perf_counter() - start)
    return out


def count_files(spark: SparkSession, paths: list[str], cfg: CountConfig = CountConfig(), via_super_kmers: bool = False) -> DataFrame:
    """kmer, cnt of all reads of at least k bases in the files."""
    return count_reads(R.read_sequences(spark, paths), cfg, via_super_kmers)


def count_reads(reads: DataFrame, cfg: CountConfig = CountConfig(), via_super_kmers: bool = False) -> DataFrame:
    """kmer, cnt. By super-k-mers packed blocks of them are shuffled; without, k-mers are, and long reads are cut into blocks first."""
    if via_super_kmers:
        return K.within(SK.count_by_partition(reads, cfg).select("kmer", "cnt"), cfg.min_freq, cfg.max_freq)
    own = R.normalized(reads, cfg.k)
    return K.count_kmers(own if cfg.hpc else R.in_blocks(own, cfg.k), cfg)


def count_spilled(spark: SparkSession, reads: DataFrame, path: str, cfg: CountConfig = CountConfig()) -> DataFrame:
    """kmer, cnt by way of packed super-k-mers in a folder for each partition, written to path and read back."""
    SK.spill(SK.super_kmer_blocks(reads, cfg), path)
    counts = K.kmer_strings(SK.count_blocks(SK.load_spilled(spark, path), cfg.k), cfg.k)
    return K.within(counts, cfg.min_freq, cfg.max_freq)


def metrics(reads: DataFrame, cfg: CountConfig = CountConfig()) -> DataFrame:
    """metric, value: what a run logs, as rows. Reads and bases as they come, and reads, k-mers, super-k-mers, their bytes and distinct k-mers as counted."""
    bases = F.regexp_replace("seq", NOT_BASES, "")
    raw = reads.agg(F.count(F.lit(1)).alias("reads_in"), F.coalesce(F.sum(F.length(bases)), F.lit(0)).alias("bases_in"))
    run = report(reads, cfg).select("reads", "kmer_cnt", "skm_cnt", "skm_bytes", "distinct_kmers", "part_max", "part_min")
    out = None
    for frame in (raw, run):
        rows = frame.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, frame.columns)), F.array(*[F.col(c).cast("long") for c in frame.columns]))).alias("metric", "value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def report(reads: DataFrame, cfg: CountConfig = CountConfig()) -> DataFrame:
    """One row of totals: reads, k-mers, super-k-mers, their bytes, distinct k-mers, and how even the partitions are."""
    stats = SK.partition_stats(reads, cfg)
    sums = stats.agg(F.sum("kmer_cnt").alias("kmer_cnt"), F.sum("skm_cnt").alias("skm_cnt"), F.sum("bytes").alias("skm_bytes"))
    loaded = R.normalized(reads, cfg.k).agg(F.count(F.lit(1)).alias("reads"))
    distinct = K.kmer_code_counts(reads, cfg.k, hpc=cfg.hpc).agg(F.count(F.lit(1)).alias("distinct_kmers"))
    even = SK.size_summary(stats).select(*[F.col(c).alias(f"part_{c}") for c in ("n", "avg", "max", "argmax", "min", "var", "std", "cv")])
    out = loaded
    for one in (sums, distinct, even):  # each has one row
        out = out.withColumn("_one", F.lit(1)).join(one.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out
