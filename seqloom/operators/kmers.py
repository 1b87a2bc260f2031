"""Counting k-mers: canonical or by strand, totals and frequency bounds.

Reads are spread over all cores, coded batch by batch in numpy and counted within a batch before the shuffle; the codes, one or two
longs, are the keys. A frequent k-mer, however hot, reaches the reducers as one row a task. Strings are made of the distinct codes only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.config import CountConfig
from seqloom.functions import vector
from seqloom.functions.batches import bounded
from seqloom.functions.sequence import decode

UINT32 = 4294967295
#: k-mers counted together before they leave the kernel, and reads that a kernel sees at once.
COUNTED, READS = 4_000_000, 1024
#: Input splits for each core from which reads stay where they are read.
ENOUGH = 2


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all shuffle partitions if the input makes few splits, as a small file may be a single task. Reads that come in splits enough, by
    the planner's estimate of their size, are not shuffled."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    splits = size // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if splits >= ENOUGH * spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def _coder(k: int, canonical: bool, hpc: bool) -> Callable:
    def emit(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> pa.RecordBatch:
        low = np.concatenate([p[0] for p in parts])
        high, low, counts = vector.tally(low, None if k <= 32 else np.concatenate([p[1] for p in parts]))
        return pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(counts)], ["hi", "lo", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            bases, offsets = vector.batch_bases(batch.column(0))
            if hpc:
                bases, offsets = vector.squeeze_runs(bases, offsets)
            at = vector.starts_of(offsets, k)
            for own, starts in vector.chunks_of(bases, at, k):
                held.append(vector.kmer_codes(own, starts, k, canonical))
                size += len(starts)
                if size >= COUNTED:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return run


def kmer_code_counts(reads: DataFrame, k: int = 21, canonical: bool = True, hpc: bool = False) -> DataFrame:
    """hi, lo, cnt of each distinct k-mer: lo holds the last 32 bases, hi those before. reads: seq, raw or normalized."""
    own = spread(reads.select("seq"))
    return own.mapInArrow(bounded(_coder(k, canonical, hpc), READS), "hi long, lo long, cnt long").groupBy("hi", "lo").agg(F.sum("cnt").alias("cnt"))


def kmer_strings(counts: DataFrame, k: int, *others: str) -> DataFrame:
    """kmer, cnt in place of the codes, after other columns that are kept."""
    kmer = decode(F.col("lo"), k) if k <= 32 else F.concat(decode(F.col("hi"), k - 32), decode(F.col("lo"), 32))
    return counts.select(*others, kmer.alias("kmer"), "cnt")


def count_kmers(reads: DataFrame, cfg: CountConfig = CountConfig(), canonical: bool = True) -> DataFrame:
    """kmer, cnt within the frequency bounds of cfg."""
    return kmer_strings(within(kmer_code_counts(reads, cfg.k, canonical, cfg.hpc), cfg.min_freq, cfg.max_freq), cfg.k)


def within(counts: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    """Counts from low to high, both included; on the counts, below the decoding of k-mers."""
    out = counts.where(F.col("cnt") >= low) if low > 1 else counts
    return out if high is None else out.where(F.col("cnt") <= high)


def clamped(counts: DataFrame, most: int = UINT32) -> DataFrame:
    return counts.withColumn("cnt", F.least("cnt", F.lit(most).cast("long")))


def totals(reads: DataFrame, k: int = 21) -> DataFrame:
    """distinct_kmers and total_kmers in one row."""
    counts = kmer_code_counts(reads, k)
    return counts.agg(F.count(F.lit(1)).alias("distinct_kmers"), F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total_kmers"))


def ordered(counts: DataFrame) -> DataFrame:
    """Counts sorted by k-mer within each partition; no shuffle. Codes of up to 31 bases are in the order of their bases."""
    return counts.sortWithinPartitions(*[c for c in ("part", "hi", "lo", "kmer") if c in counts.columns])


def ranked(counts: DataFrame) -> DataFrame:
    """Counts with each k-mer's rank, from 1, in the order of its partition by minimizer. counts: part, kmer, cnt."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("kmer")).cast("long"))


def spectrum(reads: DataFrame, k: int = 21) -> DataFrame:
    """Extension: how many distinct k-mers have each count."""
    return kmer_code_counts(reads, k).groupBy("cnt").agg(F.count(F.lit(1)).alias("kmers"))
