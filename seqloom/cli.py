"""spark-submit entry: count the k-mers of FASTA and FASTQ files."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from seqloom.config import FILTERS, CountConfig
from seqloom.operators import superkmers as SK
from seqloom.plans import counting
from seqloom.sources import reads as R


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seqloom", description=__doc__)
    p.add_argument("-read", nargs="+", required=True, help="files or patterns, plain or gzipped")
    p.add_argument("-k", type=int, default=21)
    p.add_argument("-p", type=int, default=7)
    p.add_argument("-skm", type=int, default=31, help="partitions by minimizer")
    p.add_argument("-hpc", type=int, default=0, choices=(0, 1))
    p.add_argument("-tmp", default=None, help="folder for packed super-k-mers, from which counts are made; without, Spark's shuffle holds what is counted")
    p.add_argument("-im", action="store_true", help="leave super-k-mers in memory and shuffle files even if -tmp is given")
    p.add_argument("-filter", default="default", choices=FILTERS)
    p.add_argument("-min", type=int, default=1, dest="min_freq")
    p.add_argument("-max", type=int, default=None, dest="max_freq")
    p.add_argument("-out", default=None, help="folder for the counts, Parquet")
    p.add_argument("-text", action="store_true", help="counts as text")
    p.add_argument("-lv", type=int, default=5, help="log level, 0 to 5")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=(logging.CRITICAL, logging.ERROR, logging.WARNING, logging.INFO, logging.INFO, logging.DEBUG)[min(5, max(0, args.lv))])
    logging.getLogger("py4j").setLevel(logging.WARNING)
    cfg = CountConfig(args.k, args.p, args.skm, args.filter, bool(args.hpc), args.min_freq, args.max_freq)
    spark = SparkSession.builder.appName("seqloom").getOrCreate()
    reads = R.read_sequences(spark, args.read)
    row = counting.timed("report", lambda: counting.report(reads, cfg).first())
    print(" ".join(f"{k}={v}" for k, v in row.asDict().items()))
    spilled = args.tmp and not args.im
    if args.out:
        counts = counting.count_spilled(spark, reads, args.tmp, cfg) if spilled else counting.count_reads(reads, cfg)
        counting.timed("counts", lambda: R.write_counts(counts, args.out, args.text))
    elif spilled:
        counting.timed("super-k-mers", lambda: SK.spill(SK.super_kmer_blocks(reads, cfg), args.tmp))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
