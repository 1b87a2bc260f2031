"""Minimizers, super-k-mers, partitions by minimizer, their statistics, and counts by way of an exchange of packed super-k-mers.

The exchange moves about a byte a k-mer: super-k-mers go four bases a byte in blocks, one for each group of minimizers and some hundred thousand super-k-mers of a
task. A k-mer and its reverse complement have one minimizer, so a group holds all occurrences of its k-mers and is counted at one place. Groups are
made as many as k-mers need (``GROUP_KMERS`` each); a minimizer that is too frequent for one group is dealt to several tasks, whose counts are then added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.config import CountConfig
from seqloom.functions import vector
from seqloom.functions.batches import bounded
from seqloom.functions.sequence import decode, packed_bytes, partition_id
from seqloom.operators.kmers import COUNTED, READS, kmer_strings, spread
from seqloom.sources.shared import shared_dir

#: k-mers of a group, super-k-mers and bases that a task packs into one round of blocks.
GROUP_KMERS, BLOCK_SKMS, BLOCK_BASES = 4_000_000, 400_000, 16_000_000
#: Groups over size of which the list (16 bytes each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_GROUPS = 10_000
#: Files of a partition that is written, at most.
SPILL_FILES = 16

_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def _kernel(cfg: CountConfig, what: str) -> Callable:
    """A mapInArrow function over read_id, seq. what: minimizers, super_kmers (with their bases), runs (without) or packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            bases, offsets = vector.batch_bases(batch.column(1))
            if cfg.hpc:
                bases, offsets = vector.squeeze_runs(bases, offsets)
            if what == "minimizers":
                at = vector.starts_of(offsets, cfg.k)
                read = np.repeat(np.arange(len(ids)), np.maximum(np.diff(offsets) - cfg.k + 1, 0))
                mm = vector.minimizers(bases, at, cfg.k, cfg.p, cfg.pmer_filter)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(read)), pa.array(at - offsets[read]), pa.array(mm.astype(np.int64))], ["read_id", "pos", "code"])
                continue
            s = vector.super_kmers(bases, offsets, cfg.k, cfg.p, cfg.pmer_filter)
            cols = [ids.take(pa.array(s["read"])), pa.array(s["beg"]), pa.array(s["end"]), pa.array(s["mm"].astype(np.int64))]
            names = ["read_id", "beg", "end", "code"]
            if what == "super_kmers":
                lengths = s["end"] - s["beg"] + cfg.k - 1
                ends = np.concatenate([[0], np.cumsum(lengths)])
                spots = np.repeat(s["at"] - ends[:-1], lengths) + np.arange(ends[-1])
                letters = _LETTERS[bases[spots]] if len(spots) else np.zeros(0, np.uint8)
                cols.append(pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)).cast(pa.string()))
                names.append("bases")
            elif what == "packed":
                own = [vector.pack_read(bases[offsets[k] : offsets[k + 1]]) for k in range(len(ids))]
                cols.append(pa.array([vector.pack_super_kmer(own[r], int(b), int(e), cfg.k) for r, b, e in zip(s["read"], s["beg"], s["end"], strict=True)], pa.binary()))
                names.append("packed")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _mapped(reads: DataFrame, cfg: CountConfig, what: str, more: str = "") -> DataFrame:
    own = spread(reads.select("read_id", "seq"))
    return own.mapInArrow(bounded(_kernel(cfg, what), READS), "read_id long, beg long, end long, code long" + more)


def minimizers(reads: DataFrame, cfg: CountConfig = CountConfig()) -> DataFrame:
    """read_id, pos, mm: the minimizer of the k-mer at each position."""
    own = spread(reads.select("read_id", "seq"))
    return own.mapInArrow(bounded(_kernel(cfg, "minimizers"), READS), "read_id long, pos long, code long").select("read_id", "pos", decode(F.col("code"), cfg.p).alias("mm"))


def super_kmers(reads: DataFrame, cfg: CountConfig = CountConfig()) -> DataFrame:
    """read_id, beg, end (past the last k-mer), mm, part, bases, bytes."""
    rows = _mapped(reads, cfg, "super_kmers", ", bases string")
    return rows.select("read_id", "beg", "end", decode(F.col("code"), cfg.p).alias("mm"), partition_id(F.col("code"), cfg.parts).alias("part"), "bases", packed_bytes(F.col("beg"), F.col("end"), cfg.k).alias("bytes"))


def packed_super_kmers(reads: DataFrame, cfg: CountConfig = CountConfig()) -> DataFrame:
    """read_id, beg, part, packed: three bases a byte, tagged with their number."""
    rows = _mapped(reads, cfg, "packed", ", packed binary")
    return rows.select("read_id", "beg", partition_id(F.col("code"), cfg.parts).alias("part"), "packed")


def _packed_reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bases, offsets = vector.batch_bases(batch.column(1))
        data = [vector.pack_read(bases[a:b]).tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["read_id", "packed"])


def packed_reads(reads: DataFrame) -> DataFrame:
    """read_id, packed."""
    return spread(reads.select("read_id", "seq")).mapInArrow(bounded(_packed_reads, READS), "read_id long, packed binary")


def unpack(packed: DataFrame) -> DataFrame:
    """The bases of packed super-k-mers, beside the other columns."""
    names = packed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_LETTERS[vector.unpack_super_kmer(x)].tobytes().decode() for x in batch.column(names.index("packed")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "bases"])

    return packed.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in packed.dtypes) + ", bases string")


def partition_stats(reads: DataFrame, cfg: CountConfig = CountConfig()) -> DataFrame:
    """part, skm_cnt, kmer_cnt, bytes of every partition, empty ones with zeros. Sums are made before the shuffle."""
    rows = _mapped(reads, cfg, "runs")
    part = partition_id(F.col("code"), cfg.parts).alias("part")
    sums = rows.groupBy(part).agg(
        F.count(F.lit(1)).alias("skm_cnt"), F.sum(F.col("end") - F.col("beg")).alias("kmer_cnt"), F.sum(packed_bytes(F.col("beg"), F.col("end"), cfg.k)).alias("bytes")
    )
    every = reads.sparkSession.range(cfg.parts).select(F.col("id").cast("int").alias("part"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(sums, "part", "left").select("part", zero("skm_cnt"), zero("kmer_cnt"), zero("bytes"))


def size_summary(stats: DataFrame, column: str = "bytes") -> DataFrame:
    """n, avg (whole), max, argmax (the first), min, var about that mean, std, cv of the partitions' sizes."""
    x = F.col(column)
    one = stats.agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg(x)).cast("long").alias("avg"), F.max(x).alias("max"), F.min(x).alias("min"), F.max_by("part", F.struct(x, -F.col("part"))).alias("argmax"), F.collect_list(x).alias("_x"))
    # squared distances and not moments, which cancel; the number of partitions is a parameter, so their list is bounded
    apart = F.transform("_x", lambda v: (v - F.col("avg")).cast("double") * (v - F.col("avg")).cast("double"))
    var = F.aggregate(apart, F.lit(0.0), lambda a, v: a + v) / F.col("n")
    std = F.sqrt(var)
    cv = F.when(F.col("avg") > 0, std / F.col("avg")).otherwise(F.lit(0.0))
    return one.select("n", "avg", "max", "argmax", "min", F.round(var, 3).alias("var"), F.round(std, 3).alias("std"), F.round(cv, 6).alias("cv"))


def kmer_width(k: int) -> int:
    """Bytes of a k-mer's code: 4 to 16 bases, 8 to 32, 16 to 64."""
    return 4 if k <= 16 else 8 if k <= 32 else 16


def oversize(stats: DataFrame, k: int, memory: int, budget: int) -> DataFrame:
    """part, need (bytes to count it at once, with room for sorting), oversize: over budget by more than a tenth of memory is left."""
    need = (F.lit(2.5) * F.col("kmer_cnt") * F.lit(kmer_width(k))).cast("double")
    return stats.select("part", need.alias("need"), (F.lit(float(budget)) - need <= 0.1 * memory).alias("oversize"))


def group_partitions(stats: DataFrame, k: int, memory: int, budget: int, most: int) -> DataFrame:
    """part, batch, oversize: partitions in order, dealt to batches of at most ``most`` that fit the budget and leave a tenth of memory.

    A partition that fits no batch has one of its own. The number of partitions is a parameter, so their list is bounded."""
    sizes = oversize(stats, k, memory, budget).groupBy().agg(F.sort_array(F.collect_list(F.struct("part", "need", "oversize"))).alias("p"))
    spare = 0.1 * memory
    kind = "array<struct<part:int,batch:int,oversize:boolean>>"

    def step(a, x):
        joins = (a["n"] > 0) & (a["n"] < most) & (a["left"] - x["need"] > spare)
        batch = F.when(joins, a["batch"]).otherwise(a["batch"] + 1)
        left = F.when(joins, a["left"]).otherwise(F.lit(float(budget))) - x["need"]
        n = F.when(joins, a["n"] + 1).when(x["oversize"], F.lit(0)).otherwise(F.lit(1))
        row = F.struct(x["part"].alias("part"), batch.alias("batch"), x["oversize"].alias("oversize"))
        return F.struct(batch.alias("batch"), left.alias("left"), n.alias("n"), F.concat(a["out"], F.array(row)).alias("out"))

    start = F.struct(F.lit(-1).alias("batch"), F.lit(0.0).alias("left"), F.lit(0).alias("n"), F.array().cast(kind).alias("out"))
    return sizes.select(F.inline(F.aggregate("p", start, step, lambda a: a["out"])))


#: A block: super-k-mers of one group, as their lengths (unsigned 32-bit) and their bases, four a byte.
BLOCKS = "part int, sub int, kmers long, lengths binary, bases binary"


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _blocker(cfg: CountConfig, subs: int) -> Callable:
    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        before = np.cumsum([0, *(len(h[3]) for h in held)])
        codes, starts, lengths = (np.concatenate(x) for x in zip(*((c, a + n, size) for (c, a, size, _), n in zip(held, before, strict=False)), strict=True))
        part = (0xFFFFFFFF - codes.astype(np.int64)) % cfg.parts
        sub = (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % subs
        order = np.lexsort((sub, part))
        part, sub, lengths = part[order], sub[order], lengths[order]
        heads = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (sub[1:] != sub[:-1])]))
        data, at = vector.pack_groups(np.concatenate([h[3] for h in held]), starts[order], lengths, heads)
        kmers = np.add.reduceat(lengths - cfg.k + 1, heads)
        cuts = 4 * np.concatenate([heads, [len(lengths)]])
        cols = [pa.array(part[heads].astype(np.int32)), pa.array(sub[heads].astype(np.int32)), pa.array(kmers), _binary(lengths.astype("<u4").view(np.uint8), cuts), _binary(data, at)]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, skms, size = [], 0, 0
        for batch in batches:
            bases, offsets = vector.batch_bases(batch.column(0))
            if cfg.hpc:
                bases, offsets = vector.squeeze_runs(bases, offsets)
            s = vector.super_kmers(bases, offsets, cfg.k, cfg.p, cfg.pmer_filter)
            if len(s["mm"]):
                held.append((s["mm"].astype(np.uint64), s["at"], s["end"] - s["beg"] + cfg.k - 1, bases))
                skms, size = skms + len(s["mm"]), size + len(bases)
            if skms >= BLOCK_SKMS or size >= BLOCK_BASES:
                yield packed(held)
                held, skms, size = [], 0, 0
        if held:
            yield packed(held)

    return run


def super_kmer_blocks(reads: DataFrame, cfg: CountConfig = CountConfig(), group_kmers: int = GROUP_KMERS) -> DataFrame:
    """Super-k-mers as blocks: part, sub (a finer cut by minimizer), kmers, lengths, bases."""
    bytes_ = reads.agg(F.coalesce(F.sum(F.octet_length("seq")), F.lit(0)).alias("b")).first()["b"]
    subs = max(1, -(-bytes_ // (cfg.parts * group_kmers)))
    return spread(reads.select("seq")).mapInArrow(bounded(_blocker(cfg, subs), READS), BLOCKS)


def _group_counter(k: int) -> Callable:
    """Counts of the k-mers of a group's blocks, in ascending order."""

    def run(group: pa.Table) -> pa.Table:
        found, held, size = [], [], 0

        def settle() -> None:
            high, low, counts = vector.tally(np.concatenate([h[0] for h in held]), None if k <= 32 else np.concatenate([h[1] for h in held]))
            found.append((high, low, counts))

        for lengths, data in zip(group.column("lengths").to_pylist(), group.column("bases").to_pylist(), strict=True):
            bases, offsets = vector.unpack_group(data, np.frombuffer(lengths, "<u4"))
            for own, starts in vector.chunks_of(bases, vector.starts_of(offsets, k), k):
                held.append(vector.kmer_codes(own, starts, k))
                size += len(starts)
                if size >= COUNTED:
                    settle()
                    held, size = [], 0
        if held:
            settle()
        high, low, counts = found[0] if len(found) == 1 else vector.tally(*(np.concatenate([f[c] for f in found]) for c in (1, 0, 2)))
        part = pa.array(np.full(len(low), group.column("part")[0].as_py(), np.int32))
        return pa.table({"part": part, "hi": high.view(np.int64), "lo": low.view(np.int64), "cnt": counts})

    return run


def count_blocks(blocks: DataFrame, k: int = 21, group_kmers: int = GROUP_KMERS) -> DataFrame:
    """part, hi, lo, cnt of each distinct canonical k-mer. blocks must be cheap to read twice: a table, or a checkpoint."""
    sizes = blocks.groupBy("part", "sub").agg(F.sum("kmers").alias("n")).where(F.col("n") > 2 * group_kmers)
    large = sizes.select("part", "sub", F.ceil(F.col("n") / group_kmers).cast("long").alias("tasks")).persist()
    many = large.count()
    schema = "part int, hi long, lo long, cnt long"
    counted = lambda df, *keys: df.groupBy("part", "sub", *keys).applyInArrow(_group_counter(k), schema)
    if not many:
        return counted(blocks)
    told = blocks.join(F.broadcast(large) if many <= BROADCAST_GROUPS else large, ["part", "sub"], "left")
    apart = told.where("tasks IS NOT NULL").withColumn("task", F.pmod(F.xxhash64("lengths", "bases"), "tasks"))
    sums = counted(apart, "task").groupBy("part", "hi", "lo").agg(F.sum("cnt").alias("cnt"))
    return counted(told.where("tasks IS NULL").select(*blocks.columns)).unionByName(sums)


def code_counts_by_exchange(reads: DataFrame, cfg: CountConfig = CountConfig(), group_kmers: int = GROUP_KMERS) -> DataFrame:
    """part, hi, lo, cnt by an exchange of packed super-k-mers instead of k-mers."""
    shared_dir(reads.sparkSession)
    return count_blocks(super_kmer_blocks(reads, cfg, group_kmers).checkpoint(), cfg.k, group_kmers)


def count_by_partition(reads: DataFrame, cfg: CountConfig = CountConfig(), group_kmers: int = GROUP_KMERS) -> DataFrame:
    """part, kmer, cnt by way of super-k-mers; parts share no k-mer."""
    return kmer_strings(code_counts_by_exchange(reads, cfg, group_kmers), cfg.k, "part")


def partition_distinct(reads: DataFrame, cfg: CountConfig = CountConfig()) -> DataFrame:
    """part, distinct_kmers of every partition; their sum is the number of distinct k-mers."""
    sums = code_counts_by_exchange(reads, cfg).groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    every = reads.sparkSession.range(cfg.parts).select(F.col("id").cast("int").alias("part"))
    return every.join(sums, "part", "left").select("part", F.coalesce("_n", F.lit(0)).cast("long").alias("distinct_kmers"))


def spill(rows: DataFrame, path: str) -> None:
    """Super-k-mers, one by one or in blocks, in a folder for each partition, which several tasks write."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SPILL_FILES))
    rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part", salt).write.partitionBy("part").parquet(path)


def load_spilled(spark: SparkSession, path: str, part: int | None = None) -> DataFrame:
    """Spilled super-k-mers; of one partition, the others' files are not read."""
    rows = spark.read.parquet(path)
    return rows if part is None else rows.where(F.col("part") == part)
