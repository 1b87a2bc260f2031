"""Reads from text columns and from FASTA or FASTQ files, plain or gzipped.

Files are framed one by one: a file's last line may lack its line feed, lines may end in CR LF, FASTA sequences may span lines and FASTQ
quality lines may start with ``@``. Format and compression are inferred per file from its name.

Plain files are read in splits by Spark's text source, one scan for all files of a format. FASTA is cut at ``\\n>`` so that a record is never divided. In
FASTQ only line numbers tell records apart: the lines of each split are counted first, and each split then reads on from the number (modulo 4) and
the last line of the one before. Gzip, which can't be split, is streamed by a task a file, and the reads are dealt to all tasks if the files are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.batches import bounded
from seqloom.functions.sequence import normalize

#: Lines that a kernel sees at once.
LINES = 8192
#: Splits of which the numbers (about 150 bytes each) are broadcast; with more, files go through a task each.
BROADCAST_SPLITS = 200_000
#: Reads longer than this are counted in overlapping blocks.
BLOCK = 1 << 16


def documents_as_reads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """read_id, source (null), seq: the raw text as a read; null texts are no reads."""
    return df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("read_id"), F.lit(None).cast("string").alias("source"), F.col(text_col).alias("seq"))


def is_gzip(path: str) -> bool:
    return path[-1:] in "zZ" and bool(path)


def is_fasta(path: str) -> bool:
    """By the last letter of the name, before .gz if it ends so."""
    name = path[:-3] if is_gzip(path) else path
    return name[-1:] in "aA" and bool(name)


def list_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files at paths, of which each may be a pattern, through Spark's file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        found = place.getFileSystem(conf).globStatus(place)
        if not found:
            raise FileNotFoundError(path)
        for status in found:
            if status.isDirectory():
                out += [str(s.getPath()) for s in place.getFileSystem(conf).listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))]
            else:
                out.append(str(status.getPath()))
    return sorted(out)


def _fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.read.option("lineSep", "\n>").text(paths).select(F.input_file_name().alias("source"), F.regexp_replace("value", "^>", "").alias("v"))
    rows = rows.where(F.trim("v") != "")
    head = F.rtrim(F.regexp_extract("v", r"^([^\r\n]*)", 1))
    body = F.when(F.instr("v", "\n") > 0, F.expr("substring(v, instr(v, '\n') + 1)")).otherwise(F.lit(""))
    return rows.select("source", head.alias("name"), F.regexp_replace(body, r"\s", "").alias("seq"))


def _fastq_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits in order, as source, start of the split, line, number modulo 4 of its first line and the line before it: every fourth
    line's header and the sequence that follows it."""
    split, number, name = None, 0, ""
    for batch in batches:
        out: list[tuple[str, str, str]] = []
        for source, start, value, first, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (source, start) != split:
                split, number, name = (source, start), first, before or ""
            if number % 4 == 0:
                name = value
            elif number % 4 == 1:
                out.append((source, name.rstrip("\r\n ").removeprefix("@"), value.strip()))
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], ["source", "name", "seq"])


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("start"), "value")


def _split_numbers(lines: DataFrame) -> DataFrame:
    """source, start, first (the number modulo 4 of a split's first line) and before (the line before it). A split is read by one task in order."""
    at = F.monotonically_increasing_id()
    own = lines.withColumn("_at", at).groupBy("source", "start").agg(F.count(F.lit(1)).alias("_n"), F.max_by("value", "_at").alias("_last"))
    order = Window.partitionBy("source").orderBy("start")
    first = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 4
    return own.select("source", "start", first.cast("int").alias("first"), F.lag("_last").over(order).alias("before"))


def _fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    plain, zipped = [p for p in paths if not is_gzip(p)], [p for p in paths if is_gzip(p)]
    schema, frames = "source string, name string, seq string", []
    if plain:
        numbers = _split_numbers(_lines(spark, plain)).persist()
        if numbers.count() <= BROADCAST_SPLITS:
            lines = _lines(spark, plain).join(F.broadcast(numbers), ["source", "start"], "left")
            known = F.when(F.col("first").isNull(), F.raise_error(F.lit("a split of a FASTQ file changed while it was read"))).otherwise(F.col("first")).cast("int")
            lines = lines.select("source", "start", "value", known.alias("first"), "before")
        else:
            lines = _lines(spark, plain).withColumn("_at", F.monotonically_increasing_id()).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source")
            lines = lines.sortWithinPartitions("source", "start", "_at").select("source", F.lit(0).cast("long").alias("start"), "value", F.lit(0).alias("first"), F.lit(None).cast("string").alias("before"))
        frames.append(lines.mapInArrow(bounded(_fastq_lines, LINES), schema))
    if zipped:
        lines = _lines(spark, zipped).withColumns({"first": F.lit(0), "before": F.lit(None).cast("string")})
        rows = lines.mapInArrow(bounded(_fastq_lines, LINES), schema)
        frames.append(rows if len(zipped) >= 2 * spark.sparkContext.defaultParallelism else rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def read_sequences(spark: SparkSession, paths: str | list[str], min_length: int = 0) -> DataFrame:
    """read_id (from source and header, stable), source, name, seq of all files at paths; reads shorter than min_length are left out."""
    files = list_files(spark, [paths] if isinstance(paths, str) else paths)
    fasta, fastq = [f for f in files if is_fasta(f)], [f for f in files if not is_fasta(f)]
    out = _fasta(spark, fasta) if fasta else None
    if fastq:
        own = _fastq(spark, fastq)
        out = own if out is None else out.unionByName(own)
    out = out.where(F.length("seq") >= min_length)
    return out.select(F.xxhash64("source", "name", "seq").alias("read_id"), "source", "name", "seq")


def _write_text(rows: DataFrame, path: str, compression: str, ending: str | None) -> None:
    rows.write.option("compression", compression).text(path)
    if ending:  # a rename a file, one file a task; object stores copy
        spark = rows.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in system.listStatus(place):
            own = status.getPath()
            if own.getName().startswith("part-"):
                system.rename(own, own.suffix(ending))


def write_fasta(reads: DataFrame, path: str, id_col: str = "read_id", seq_col: str = "seq", compression: str = "none", ending: str | None = None) -> None:
    """One record a read, ``>id`` and its sequence on one line. Spark names the files, so give an ending that tells the format, or read them with ``fasta_at``."""
    _write_text(reads.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.col(seq_col)).alias("value")), path, compression, ending)


def write_fastq(reads: DataFrame, path: str, id_col: str = "read_id", seq_col: str = "seq", compression: str = "none", ending: str | None = None, line_end: str = "\n") -> None:
    """One record a read: ``@id``, its sequence, ``+`` and a quality of as many ``@``, which is the least favourable for readers."""
    record = F.concat_ws(line_end, F.concat(F.lit("@"), F.col(id_col).cast("string")), F.col(seq_col), F.lit("+"), F.repeat(F.lit("@"), F.length(seq_col)))
    _write_text(reads.select(F.concat(record, F.lit("\r" if line_end == "\r\n" else "")).alias("value")), path, compression, ending)


def fastq_at(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTQ files of any name below path; those that end in gz are gzipped."""
    return _fastq(spark, list_files(spark, [path]))


def fasta_at(spark: SparkSession, path: str) -> DataFrame:
    """Records of FASTA files of any name."""
    return _fasta(spark, [path])


def write_counts(counts: DataFrame, path: str, text: bool = False) -> None:
    """Counts as Parquet, or as lines of k-mer and count with a tab between."""
    if text:
        counts.select(F.concat_ws("\t", *counts.columns).alias("value")).write.text(path)
    else:
        counts.write.parquet(path)


def normalized(reads: DataFrame, k: int = 1) -> DataFrame:
    """read_id, source, seq of bases A, C, G and T only; reads shorter than k are left out."""
    return reads.select("read_id", "source", normalize(F.col("seq")).alias("seq")).where(F.length("seq") >= k)


def split_at_n(reads: DataFrame) -> DataFrame:
    """Extension: read_id, source, seq of the stretches between N and U, which ``normalized`` reads as A; a stretch has the id of its read."""
    bases = F.upper(F.regexp_replace("seq", "[^ACGTNUacgtnu]", ""))
    return reads.select("read_id", "source", F.explode(F.split(bases, "[NU]+")).alias("seq")).where(F.length("seq") > 0)


def in_blocks(reads: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Reads cut into blocks that overlap in k - 1 bases: each k-mer is in one block, and no task holds a whole chromosome's k-mers.

    Reads must be normalized. Not for super-k-mers, whose runs the cuts would part."""
    size = F.length("seq")
    at = F.explode(F.sequence(F.lit(0), F.greatest(size - k, F.lit(0)), F.lit(block))).alias("_at")
    long = reads.where(size > block + k).select("read_id", "source", "seq", at)
    long = long.select("read_id", "source", F.expr(f"substring(seq, _at + 1, {block + k - 1})").alias("seq"))
    return reads.where(size <= block + k).unionByName(long)
