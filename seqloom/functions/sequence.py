"""Sequence functions as columns. Strings of bases sort as their codes do, so least() of strings is the numeric minimum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a base may be written as; N counts as A and so does U. Every other character is dropped.
NOT_BASES = "[^ACGTNUacgtnu]"

# P-mers that can't be minimizers, by filter.
INVALID = {"default": "^[AC][AC]A|AAA$", "signature": ".AA|^A[AC]A"}


def normalize(text: Column) -> Column:
    """Bases in upper case; characters are dropped before case is changed, as upper() can make letters of other characters."""
    return F.translate(F.upper(F.regexp_replace(text, NOT_BASES, "")), "NU", "AA")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def pmer_code(pmer: Column) -> Column:
    """Two bits a base, A 0 to T 3; up to 31 bases."""
    return F.conv(F.translate(pmer, "ACGT", "0123"), 4, 10).cast("long")


def decode(code: Column, k: int) -> Column:
    """The k bases (up to 32) of a code; of 32 bases, a negative code is read as unsigned."""
    if k == 32:  # conv() loses the least long
        return F.concat(decode(F.shiftrightunsigned(code, 32), 16), decode(code.bitwiseAND(F.lit(4294967295)), 16))
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def is_valid_pmer(pmer: Column, pmer_filter: str = "default") -> Column:
    if pmer_filter == "canonical":
        return pmer.isNotNull()
    return ~pmer.rlike(INVALID[pmer_filter])


def compress_runs(seq: Column) -> Column:
    """One base for each run of a base."""
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def run_starts(seq: Column) -> Column:
    """Where each run of a base starts, from 0."""
    at = F.sequence(F.lit(1), F.length(seq))
    first = F.filter(at, lambda i: (i == 1) | (seq.substr(i, F.lit(1)) != seq.substr(i - 1, F.lit(1))))
    return F.when(F.length(seq) > 0, F.transform(first, lambda i: i - 1)).otherwise(F.array().cast("array<int>"))


def partition_id(code: Column, parts: int) -> Column:
    """Of a minimizer's code: the complement in 32 bits, modulo the number of partitions."""
    return F.pmod(F.lit(4294967295) - code, F.lit(parts)).cast("int")


def packed_bytes(beg: Column, end: Column, k: int) -> Column:
    """Bytes that a super-k-mer takes at three bases a byte, aligned as in its read."""
    return F.floor((beg % 3 + (end - beg) + F.lit(k - 1)) / 3).cast("long") + 1
