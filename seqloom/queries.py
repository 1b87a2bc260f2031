"""The registered k-mer queries over ``documents`` as reads, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.config import CountConfig
from seqloom.functions import sequence as S
from seqloom.operators import kmers as K
from seqloom.operators import superkmers as SK
from seqloom.plans import counting
from seqloom.sources import reads as R
from seqloom.sources.shared import scratch

CFG = CountConfig()
#: Memory and budget by which partitions are called oversize, in bytes, and the most partitions in a batch.
MEMORY, BUDGET, STREAMS = 4_000_000, 2_000_000, 6
BATCH = 2000


def raw_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.documents_as_reads(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def reads(spark: SparkSession, sf_dir: str, k: int = 1) -> DataFrame:
    """Normalized reads, spread over all cores before the costly part."""
    return R.normalized(K.spread(raw_reads(spark, sf_dir)), k)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("read_id", "doc_id")


def q01_canonical_counts(spark, sf_dir):
    return K.count_kmers(raw_reads(spark, sf_dir), CFG)


def q02_totals(spark, sf_dir):
    return K.totals(raw_reads(spark, sf_dir), CFG.k)


def q03_frequency_bounds(spark, sf_dir):
    return K.count_kmers(raw_reads(spark, sf_dir), CountConfig(min_freq=2, max_freq=1000))


def q04_clamped_counts(spark, sf_dir):
    return K.clamped(K.count_kmers(raw_reads(spark, sf_dir), CFG))


def q05_stranded_repeats(spark, sf_dir):
    return K.count_kmers(raw_reads(spark, sf_dir), CountConfig(min_freq=2), canonical=False)


def q06_read_lengths(spark, sf_dir):
    return reads(spark, sf_dir, CFG.k).select(F.col("read_id").alias("doc_id"), F.length("seq").cast("long").alias("len"))


def q06_reads_total(spark, sf_dir):
    return reads(spark, sf_dir, CFG.k).agg(F.count(F.lit(1)).alias("reads"))


def q07_normalized(spark, sf_dir):
    return reads(spark, sf_dir, 0).select(F.col("read_id").alias("doc_id"), "seq")


def q08_reverse_complement(spark, sf_dir):
    return reads(spark, sf_dir, 0).select(F.col("read_id").alias("doc_id"), S.reverse_complement(F.col("seq")).alias("rc"))


def q09_run_compression(spark, sf_dir):
    out = reads(spark, sf_dir, 0).select(F.col("read_id").alias("doc_id"), S.compress_runs(F.col("seq")).alias("hpc"))
    return out.withColumn("len", F.length("hpc").cast("long"))


def q10_run_positions(spark, sf_dir):
    out = reads(spark, sf_dir, 1).select(F.col("read_id").alias("doc_id"), F.posexplode(S.run_starts(F.col("seq"))).alias("idx", "pos"))
    return out.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("pos").cast("long").alias("pos"))


def _pmers(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        counts = K.kmer_code_counts(raw_reads(spark, sf_dir), CFG.p, canonical=False)
        pmers = counts.select(S.decode(F.col("lo"), CFG.p).alias("pmer"))
        return pmers.select("pmer", S.pmer_code(F.col("pmer")).alias("code"), S.is_valid_pmer(F.col("pmer"), kind).alias("valid"))

    return query


def q14_minimizers(spark, sf_dir):
    return _named(SK.minimizers(raw_reads(spark, sf_dir), CFG))


def _super_kmers(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _named(SK.super_kmers(raw_reads(spark, sf_dir), CountConfig(pmer_filter=kind)))


def q16_partition_stats(spark, sf_dir):
    return SK.partition_stats(raw_reads(spark, sf_dir), CFG)


def q17_size_summary(spark, sf_dir):
    return SK.size_summary(SK.partition_stats(raw_reads(spark, sf_dir), CFG))


def q17_phase_totals(spark, sf_dir):
    return SK.partition_stats(raw_reads(spark, sf_dir), CFG).agg(F.sum("kmer_cnt").alias("kmer_cnt"), F.sum("skm_cnt").alias("skm_cnt"), F.sum("bytes").alias("skm_bytes"))


def q18_partition_distinct(spark, sf_dir):
    return SK.partition_distinct(raw_reads(spark, sf_dir), CFG)


def q18_counts_by_super_kmers(spark, sf_dir):
    return SK.count_by_partition(raw_reads(spark, sf_dir), CFG)


def q19_oversize(spark, sf_dir):
    return SK.oversize(SK.partition_stats(raw_reads(spark, sf_dir), CFG), CFG.k, MEMORY, BUDGET)


def q19_partition_batches(spark, sf_dir):
    return SK.group_partitions(SK.partition_stats(raw_reads(spark, sf_dir), CFG), CFG.k, MEMORY, BUDGET, STREAMS)


def q20_packed_reads(spark, sf_dir):
    return SK.packed_reads(raw_reads(spark, sf_dir)).select(F.col("read_id").alias("doc_id"), F.lower(F.hex("packed")).alias("hex"))


def q20_packed_super_kmers(spark, sf_dir):
    return SK.packed_super_kmers(raw_reads(spark, sf_dir), CFG).select(F.col("read_id").alias("doc_id"), "beg", "part", F.lower(F.hex("packed")).alias("hex"))


def _counts(k: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: K.count_kmers(raw_reads(spark, sf_dir), CountConfig(k=k))


def q22_length_order(spark, sf_dir):
    """Batches of at most 2,000 consecutive ids, in each the reads by length."""
    batch = F.floor(F.col("read_id") / BATCH).cast("long")
    rank = F.row_number().over(Window.partitionBy("batch").orderBy(F.length("seq"), "doc_id")).cast("long")
    rows = reads(spark, sf_dir, CFG.k).select(F.col("read_id").alias("doc_id"), "seq", batch.alias("batch"))
    return rows.select("doc_id", "batch", rank.alias("rank"))


def q18_counts_by_exchange(spark, sf_dir):
    """As q01, by an exchange of packed super-k-mers; groups so small that frequent minimizers are dealt to several tasks."""
    return SK.count_by_partition(raw_reads(spark, sf_dir), CFG, group_kmers=20_000).select("kmer", "cnt")


def q18_counts_by_spill(spark, sf_dir):
    return counting.count_spilled(spark, raw_reads(spark, sf_dir), scratch(spark, "super-kmers"), CFG)


def q18_exchange_k55(spark, sf_dir):
    return SK.count_by_partition(raw_reads(spark, sf_dir), CountConfig(k=55)).select("kmer", "cnt")


def q23_fasta_round_trip(spark, sf_dir):
    """Reads written as gzipped FASTA into the shared folder and read back."""
    path = scratch(spark, "fasta")
    R.write_fasta(reads(spark, sf_dir, 1), path, compression="gzip")
    back = R.fasta_at(spark, path)
    return back.select(F.col("name").cast("long").alias("doc_id"), "seq")


def _by_fastq(compression: str, line_end: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        path = scratch(spark, "fastq")
        R.write_fastq(reads(spark, sf_dir, 1), path, compression=compression, line_end=line_end)
        return R.fastq_at(spark, path).select(F.col("name").cast("long").alias("doc_id"), "seq")

    return query


def q23_mixed_files(spark, sf_dir):
    """Canonical counts of reads in files of all four kinds, read by one call; formats are told apart by name."""
    own, paths = reads(spark, sf_dir, 1), []
    for k, (write, compression, ending) in enumerate(((R.write_fasta, "none", ".fa"), (R.write_fasta, "gzip", ".fa.gz"), (R.write_fastq, "none", ".fastq"), (R.write_fastq, "gzip", ".fq.gz"))):
        paths.append(scratch(spark, "mixed"))
        write(own.where(F.pmod("read_id", F.lit(4)) == k), paths[k], compression=compression, ending=ending)
    return counting.count_files(spark, paths, CFG)


def q26_key_order(spark, sf_dir):
    return K.ranked(SK.count_by_partition(raw_reads(spark, sf_dir), CFG))


def q27_metrics(spark, sf_dir):
    return counting.metrics(raw_reads(spark, sf_dir), CFG)


def q28_split_at_n(spark, sf_dir):
    return K.count_kmers(R.split_at_n(raw_reads(spark, sf_dir)), CFG)


def q24_compressed_counts(spark, sf_dir):
    return K.count_kmers(raw_reads(spark, sf_dir), CountConfig(hpc=True))


def q25_spectrum(spark, sf_dir):
    return K.spectrum(raw_reads(spark, sf_dir), CFG.k)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q01_canonical_counts": q01_canonical_counts,
    "q02_totals": q02_totals,
    "q03_frequency_bounds": q03_frequency_bounds,
    "q04_clamped_counts": q04_clamped_counts,
    "q05_stranded_repeats": q05_stranded_repeats,
    "q06_read_lengths": q06_read_lengths,
    "q06_reads_total": q06_reads_total,
    "q07_normalized": q07_normalized,
    "q08_reverse_complement": q08_reverse_complement,
    "q09_run_compression": q09_run_compression,
    "q10_run_positions": q10_run_positions,
    "q11_pmers_default": _pmers("default"),
    "q12_pmers_signature": _pmers("signature"),
    "q13_pmers_canonical": _pmers("canonical"),
    "q14_minimizers": q14_minimizers,
    "q15_super_kmers": _super_kmers("default"),
    "q15_super_kmers_signature": _super_kmers("signature"),
    "q15_super_kmers_canonical": _super_kmers("canonical"),
    "q16_partition_stats": q16_partition_stats,
    "q17_size_summary": q17_size_summary,
    "q17_phase_totals": q17_phase_totals,
    "q18_partition_distinct": q18_partition_distinct,
    "q18_counts_by_super_kmers": q18_counts_by_super_kmers,
    "q19_oversize": q19_oversize,
    "q19_partition_batches": q19_partition_batches,
    "q20_packed_reads": q20_packed_reads,
    "q20_packed_super_kmers": q20_packed_super_kmers,
    "q21_counts_k16": _counts(16),
    "q21_counts_k32": _counts(32),
    "q21_counts_k55": _counts(55),
    "q22_length_order": q22_length_order,
    "q18_counts_by_exchange": q18_counts_by_exchange,
    "q18_counts_by_spill": q18_counts_by_spill,
    "q18_exchange_k55": q18_exchange_k55,
    "q23_fasta_round_trip": q23_fasta_round_trip,
    "q23_fastq_round_trip": _by_fastq("none", "\n"),
    "q23_fastq_gz_crlf": _by_fastq("gzip", "\r\n"),
    "q23_mixed_files": q23_mixed_files,
    "q24_compressed_counts": q24_compressed_counts,
    "q25_spectrum": q25_spectrum,
    "q26_key_order": q26_key_order,
    "q27_metrics": q27_metrics,
    "q28_split_at_n": q28_split_at_n,
}

# --- the same in SQL ---

_SEQ = "translate(upper(regexp_replace(text, '[^ACGTNUacgtnu]', '', 'g')), 'NU', 'AA')"
_READS = f"reads AS (SELECT doc_id, {_SEQ} AS seq FROM documents WHERE text IS NOT NULL)"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_SQUEEZED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g')"


def _code(x: str, n: int) -> str:
    return f"list_sum(list_transform(range(1, {n + 1}), lambda i: (strpos('ACGT', substr({x}, i, 1)) - 1) * (4 ** ({n} - i))))::BIGINT"


def _count_sql(k: int, canonical: bool = True, having: str = "", cnt: str = "count(*)::BIGINT", seq: str = "seq") -> str:
    kmer = f"least(x, {_RC.format('x')})" if canonical else "x"
    return f"""WITH {_READS}, own AS (SELECT {seq} AS seq FROM reads),
kmers AS (SELECT unnest(list_transform(range(1, length(seq) - {k - 2}), lambda i: substr(seq, i, {k}))) AS x FROM own WHERE length(seq) >= {k})
SELECT {kmer} AS kmer, {cnt} AS cnt FROM kmers GROUP BY 1 {having}"""


def _mm_lists(kind: str, k: int = CFG.k, p: int = CFG.p) -> str:
    bad = {"default": "^[AC][AC]A|AAA$", "signature": ".AA|^A[AC]A"}.get(kind)
    keep = lambda x: f"CASE WHEN regexp_matches({x}, '{bad}') THEN '{'T' * p}' ELSE {x} END" if bad else x
    return f"""{_READS}, xs AS (
    SELECT doc_id, seq, length(seq) AS n, list_transform(range(1, length(seq) - {p - 2}), lambda i: substr(seq, i, {p})) AS x FROM reads WHERE length(seq) >= {k}
), pm AS (
    SELECT doc_id, seq, n, list_transform(x, lambda y: least({keep('y')}, {keep(_RC.format('y'))})) AS pm FROM xs
), mins AS (
    SELECT doc_id, unnest(range(0, n - {k - 1})) AS pos, unnest(list_transform(range(1, n - {k - 2}), lambda i: list_min(pm[i : i + {k - p}]))) AS mm FROM pm
)"""


def _skm(kind: str, k: int = CFG.k, parts: int = CFG.parts) -> str:
    return f"""{_mm_lists(kind)}, flags AS (
    SELECT doc_id, pos, mm, CASE WHEN lag(mm) OVER w IS DISTINCT FROM mm THEN 1 ELSE 0 END AS f FROM mins WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), islands AS (
    SELECT doc_id, pos, mm, sum(f) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM flags
), runs AS (
    SELECT doc_id, min(pos) AS beg, max(pos) + 1 AS "end", any_value(mm) AS mm FROM islands GROUP BY doc_id, g
), skm AS (
    SELECT r.doc_id, beg::BIGINT AS beg, "end"::BIGINT AS "end", mm, ((4294967295 - {_code('mm', CFG.p)}) % {parts})::INTEGER AS part,
           substr(seq, (beg + 1)::BIGINT, ("end" - beg + {k - 1})::BIGINT) AS bases, (((beg % 3) + ("end" - beg) + {k - 1}) // 3 + 1)::BIGINT AS bytes, seq
    FROM runs r JOIN reads USING (doc_id)
), stats AS (
    SELECT p.part::INTEGER AS part, count(s.part)::BIGINT AS skm_cnt, coalesce(sum("end" - beg), 0)::BIGINT AS kmer_cnt, coalesce(sum(bytes), 0)::BIGINT AS bytes
    FROM range({parts}) p(part) LEFT JOIN skm s ON s.part = p.part GROUP BY p.part
)"""


def _pmer_sql(kind: str, p: int = CFG.p) -> str:
    bad = {"default": "^[AC][AC]A|AAA$", "signature": ".AA|^A[AC]A"}.get(kind)
    valid = f"NOT regexp_matches(pmer, '{bad}')" if bad else "true"
    return f"""WITH {_READS}, pm AS (SELECT DISTINCT unnest(list_transform(range(1, length(seq) - {p - 2}), lambda i: substr(seq, i, {p}))) AS pmer FROM reads WHERE length(seq) >= {p})
SELECT pmer, {_code('pmer', p)} AS code, {valid} AS valid FROM pm"""


_KMER_OF_SKM = f"SELECT part, unnest(list_transform(range(1, length(bases) - {CFG.k - 2}), lambda i: substr(bases, i, {CFG.k}))) AS x FROM skm"
_BYTE = "printf('%02x', ({0})::INTEGER)"
_BASE = "greatest(strpos('ACGT', substr(seq, (3 * j + {0})::BIGINT, 1)) - 1, 0)"

ORACLE_SQL: dict[str, str] = {
    "q01_canonical_counts": _count_sql(21),
    "q02_totals": f"WITH c AS ({_count_sql(21)}) SELECT count(*)::BIGINT AS distinct_kmers, coalesce(sum(cnt), 0)::BIGINT AS total_kmers FROM c",
    "q03_frequency_bounds": _count_sql(21, having="HAVING count(*) BETWEEN 2 AND 1000"),
    "q04_clamped_counts": _count_sql(21, cnt="least(count(*), 4294967295)::BIGINT"),
    "q05_stranded_repeats": _count_sql(21, canonical=False, having="HAVING count(*) >= 2"),
    "q06_read_lengths": f"WITH {_READS} SELECT doc_id, length(seq)::BIGINT AS len FROM reads WHERE length(seq) >= 21",
    "q06_reads_total": f"WITH {_READS} SELECT count(*)::BIGINT AS reads FROM reads WHERE length(seq) >= 21",
    "q07_normalized": f"WITH {_READS} SELECT doc_id, seq FROM reads",
    "q08_reverse_complement": f"WITH {_READS} SELECT doc_id, {_RC.format('seq')} AS rc FROM reads",
    "q09_run_compression": f"WITH {_READS}, h AS (SELECT doc_id, {_SQUEEZED.format('seq')} AS hpc FROM reads) SELECT doc_id, hpc, length(hpc)::BIGINT AS len FROM h",
    "q10_run_positions": f"""WITH {_READS}, spots AS (
    SELECT doc_id, unnest(range(0, length(seq))) AS pos, unnest(string_split(seq, '')) AS b FROM reads WHERE length(seq) > 0
), heads AS (SELECT doc_id, pos, b, lag(b) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM spots)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS idx, pos::BIGINT AS pos FROM heads WHERE before IS DISTINCT FROM b""",
    "q11_pmers_default": _pmer_sql("default"),
    "q12_pmers_signature": _pmer_sql("signature"),
    "q13_pmers_canonical": _pmer_sql("canonical"),
    "q14_minimizers": f"WITH {_mm_lists('default')} SELECT doc_id, pos::BIGINT AS pos, mm FROM mins",
    "q15_super_kmers": f'WITH {_skm("default")} SELECT doc_id, beg, "end", mm, part, bases, bytes FROM skm',
    "q15_super_kmers_signature": f'WITH {_skm("signature")} SELECT doc_id, beg, "end", mm, part, bases, bytes FROM skm',
    "q15_super_kmers_canonical": f'WITH {_skm("canonical")} SELECT doc_id, beg, "end", mm, part, bases, bytes FROM skm',
    "q16_partition_stats": f"WITH {_skm('default')} SELECT part, skm_cnt, kmer_cnt, bytes FROM stats",
    "q17_size_summary": f"""WITH {_skm('default')}, m AS (SELECT floor(avg(bytes))::BIGINT AS a FROM stats),
v AS (SELECT count(*)::BIGINT AS n, any_value(a) AS "avg", max(bytes)::BIGINT AS "max", min(bytes)::BIGINT AS "min", avg((bytes - a)::DOUBLE * (bytes - a)) AS v FROM stats, m)
SELECT n, "avg", "max", (SELECT min(part) FROM stats WHERE bytes = "max") AS argmax, "min", round(v, 3) AS "var", round(sqrt(v), 3) AS "std",
       CASE WHEN "avg" > 0 THEN round(sqrt(v) / "avg", 6) ELSE 0.0 END AS cv FROM v""",
    "q17_phase_totals": f"WITH {_skm('default')} SELECT sum(kmer_cnt)::BIGINT AS kmer_cnt, sum(skm_cnt)::BIGINT AS skm_cnt, sum(bytes)::BIGINT AS skm_bytes FROM stats",
    "q18_partition_distinct": f"""WITH {_skm('default')}, x AS ({_KMER_OF_SKM}), d AS (SELECT part, count(DISTINCT least(x, {_RC.format('x')})) AS n FROM x GROUP BY part)
SELECT p.part::INTEGER AS part, coalesce(n, 0)::BIGINT AS distinct_kmers FROM range({CFG.parts}) p(part) LEFT JOIN d ON d.part = p.part""",
    "q18_counts_by_super_kmers": f"WITH {_skm('default')}, x AS ({_KMER_OF_SKM}) SELECT part, least(x, {_RC.format('x')}) AS kmer, count(*)::BIGINT AS cnt FROM x GROUP BY 1, 2",
    "q19_oversize": f"WITH {_skm('default')} SELECT part, (2.5 * kmer_cnt * 8)::DOUBLE AS need, {BUDGET} - 2.5 * kmer_cnt * 8 <= {0.1 * MEMORY} AS oversize FROM stats",
    "q19_partition_batches": f"""WITH RECURSIVE {_skm('default')}, sizes AS (
    SELECT part, (2.5 * kmer_cnt * 8)::DOUBLE AS need, {BUDGET} - 2.5 * kmer_cnt * 8 <= {0.1 * MEMORY} AS oversize FROM stats
), dealt AS (
    SELECT part, 0 AS batch, {BUDGET}::DOUBLE - need AS room, CASE WHEN oversize THEN 0 ELSE 1 END AS n, oversize FROM sizes WHERE part = 0
    UNION ALL
    SELECT s.part, CASE WHEN d.n > 0 AND d.n < {STREAMS} AND d.room - s.need > {0.1 * MEMORY} THEN d.batch ELSE d.batch + 1 END,
           CASE WHEN d.n > 0 AND d.n < {STREAMS} AND d.room - s.need > {0.1 * MEMORY} THEN d.room ELSE {BUDGET}::DOUBLE END - s.need,
           CASE WHEN d.n > 0 AND d.n < {STREAMS} AND d.room - s.need > {0.1 * MEMORY} THEN d.n + 1 WHEN s.oversize THEN 0 ELSE 1 END, s.oversize
    FROM dealt d JOIN sizes s ON s.part = d.part + 1
) SELECT part, batch, oversize FROM dealt""",
    "q20_packed_reads": f"""WITH {_READS} SELECT doc_id, coalesce(array_to_string(list_transform(range(0, length(seq) // 3 + 1),
    lambda j: {_BYTE.format(f"least(3, length(seq) - 3 * j) * 64 + {_BASE.format(1)} * 16 + {_BASE.format(2)} * 4 + {_BASE.format(3)}")}), ''), '') AS hex FROM reads""",
    "q20_packed_super_kmers": f"""WITH {_skm('default')}, e AS (SELECT *, "end" + {CFG.k - 1} AS stop FROM skm) SELECT doc_id, beg, part, array_to_string(list_transform(range(beg // 3, stop // 3 + 1),
    lambda j: {_BYTE.format(f"(CASE WHEN j = stop // 3 THEN stop % 3 WHEN j = beg // 3 THEN 3 - beg % 3 ELSE 3 END) * 64 + {_BASE.format(1)} * 16 + {_BASE.format(2)} * 4 + {_BASE.format(3)}")}), '') AS hex FROM e""",
    "q21_counts_k16": _count_sql(16),
    "q21_counts_k32": _count_sql(32),
    "q21_counts_k55": _count_sql(55),
    "q22_length_order": f"""WITH {_READS} SELECT doc_id, (doc_id // {BATCH})::BIGINT AS batch,
    row_number() OVER (PARTITION BY doc_id // {BATCH} ORDER BY length(seq), doc_id)::BIGINT AS rank FROM reads WHERE length(seq) >= 21""",
    "q18_counts_by_exchange": _count_sql(21),
    "q18_counts_by_spill": _count_sql(21),
    "q18_exchange_k55": _count_sql(55),
    "q23_fasta_round_trip": f"WITH {_READS} SELECT doc_id, seq FROM reads WHERE length(seq) >= 1",
    "q23_fastq_round_trip": f"WITH {_READS} SELECT doc_id, seq FROM reads WHERE length(seq) >= 1",
    "q23_fastq_gz_crlf": f"WITH {_READS} SELECT doc_id, seq FROM reads WHERE length(seq) >= 1",
    "q23_mixed_files": _count_sql(21),
    "q24_compressed_counts": _count_sql(21, seq=_SQUEEZED.format("seq")),
    "q25_spectrum": f"WITH c AS ({_count_sql(21)}) SELECT cnt, count(*)::BIGINT AS kmers FROM c GROUP BY cnt",
    "q26_key_order": f"""WITH {_skm('default')}, x AS ({_KMER_OF_SKM}), c AS (SELECT part, least(x, {_RC.format('x')}) AS kmer, count(*)::BIGINT AS cnt FROM x GROUP BY 1, 2)
SELECT part, kmer, cnt, row_number() OVER (PARTITION BY part ORDER BY kmer)::BIGINT AS rank FROM c""",
    "q27_metrics": f"""WITH {_skm('default')}, x AS ({_KMER_OF_SKM}), m AS (
    SELECT (SELECT count(*) FROM reads) AS reads_in, (SELECT sum(length(seq)) FROM reads) AS bases_in, (SELECT count(*) FROM reads WHERE length(seq) >= 21) AS reads,
           sum(kmer_cnt) AS kmer_cnt, sum(skm_cnt) AS skm_cnt, sum(bytes) AS skm_bytes, (SELECT count(DISTINCT least(x, {_RC.format('x')})) FROM x) AS distinct_kmers,
           max(bytes) AS part_max, min(bytes) AS part_min FROM stats
), n AS (SELECT COLUMNS(*)::BIGINT FROM m) UNPIVOT n ON COLUMNS(*) INTO NAME metric VALUE value""",
    "q28_split_at_n": f"""WITH cut AS (SELECT unnest(regexp_split_to_array(upper(regexp_replace(text, '[^ACGTNUacgtnu]', '', 'g')), '[NU]+')) AS seq FROM documents WHERE text IS NOT NULL),
kmers AS (SELECT unnest(list_transform(range(1, length(seq) - 19), lambda i: substr(seq, i, 21))) AS x FROM cut WHERE length(seq) >= 21)
SELECT least(x, {_RC.format('x')}) AS kmer, count(*)::BIGINT AS cnt FROM kmers GROUP BY 1""",
}
