import gzip

from seqloom.operators import superkmers as SK
from seqloom.sources import reads as R


def write(path, text):
    data = text.encode()
    path.write_bytes(gzip.compress(data) if path.name.endswith("z") else data)


def test_format_by_name():
    assert [R.is_fasta(x) for x in ("a.fa", "a.fasta", "a.FA", "a.fna.gz", "a.fq", "a.fastq.gz", "a.fq.gz")] == [True, True, True, True, False, False, False]


def test_files(spark, tmp_path):
    write(tmp_path / "one.fa", ">r1\nACGT\n>r2 x\n\n>r3\nAC\nGT\nNN")  # several lines, no final line feed
    write(tmp_path / "two.fasta", ">r4\r\nTTTT\r\n>r5\r\nA\r\n")
    write(tmp_path / "three.fa.gz", ">r6\nGGGG\n")
    write(tmp_path / "four.fastq", "@q1\nACGTN\n+\n@@@@@\n@q2\nCC\n+\n@>\n")
    write(tmp_path / "five.fq.gz", "@q3\r\nTTT\r\n+\r\n@II\r\n@q4\r\nA\r\n+\r\nI")
    rows = R.read_sequences(spark, [f"{tmp_path}/*.f*"]).collect()
    got = {r.name: r.seq for r in rows}
    assert got == {"r1": "ACGT", "r2 x": "", "r3": "ACGTNN", "r4": "TTTT", "r5": "A", "r6": "GGGG", "q1": "ACGTN", "q2": "CC", "q3": "TTT", "q4": "A"}
    assert len({r.read_id for r in rows}) == len(rows) and all(r.source for r in rows)
    assert {r.name for r in R.read_sequences(spark, str(tmp_path), min_length=4).collect()} == {"r1", "r3", "r4", "r6", "q1"}


def test_splits_cut_no_record(spark, tmp_path):
    records = {f"r{k}": "ACGTTGCA" * (k % 40) + "\n" + "GG" * (k % 7) for k in range(3000)}
    write(tmp_path / "big.fa", "".join(f">{k}\n{v}\n" for k, v in records.items()))
    fastq = "".join(f"@{k}\n{v.replace(chr(10), '') or 'A'}\n+\n{'@' * max(1, len(v) - 1)}\n" for k, v in records.items())
    write(tmp_path / "big.fq", fastq)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for name in ("big.fa", "big.fq"):
            got = {r.name: r.seq for r in R.read_sequences(spark, f"{tmp_path}/{name}").collect()}
            assert got == {k: v.replace("\n", "") or ("A" if name == "big.fq" else "") for k, v in records.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_fastq_splits_anywhere(spark, tmp_path, monkeypatch):
    """Splits of about 100 bytes begin in headers, sequences, separators and qualities, some of them with an at sign."""
    records = [(f"r{k}", "ACGTTGCA"[: 1 + k % 8] * (k % 9) or "G") for k in range(400)]
    for name, end in (("a.fq", "\n"), ("b.fastq", "\r\n")):
        (tmp_path / name).write_bytes(end.join(f"@{name}{k}{end}{v}{end}+{k}{end}@{'+' * (len(v) - 1)}" for k, v in records).encode())
    write(tmp_path / "c.fq.gz", "\n".join(f"@c{k}\n{v}\n+\n{'@' * len(v)}" for k, v in records))
    want = sorted([(f"{n}{k}", v) for n in ("a.fq", "b.fastq", "c") for k, v in records])
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        assert sorted((r.name, r.seq) for r in R.read_sequences(spark, str(tmp_path)).collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    monkeypatch.setattr(R, "BROADCAST_SPLITS", 0)
    assert sorted((r.name, r.seq) for r in R.read_sequences(spark, str(tmp_path)).collect()) == want


def test_split_at_n(spark):
    reads = spark.createDataFrame([(1, None, "nACGNNu-tt"), (2, None, "NN"), (3, None, None), (4, None, "AC")], "read_id long, source string, seq string")
    assert sorted(tuple(r) for r in R.split_at_n(reads).select("read_id", "seq").collect()) == [(1, "ACG"), (1, "TT"), (4, "AC")]


def test_round_trips(spark, tmp_path):
    reads = spark.createDataFrame([(k, None, "ACGTTGCATTAGACGT" * 4) for k in range(9)], "read_id long, source string, seq string")
    R.write_fasta(reads, str(tmp_path / "out"), compression="gzip")
    assert sorted((int(r.name), r.seq) for r in R.fasta_at(spark, str(tmp_path / "out")).collect()) == [(r.read_id, r.seq) for r in reads.sort("read_id").collect()]
    rows = SK.super_kmers(reads)
    SK.spill(rows, str(tmp_path / "skm"))
    back = SK.load_spilled(spark, str(tmp_path / "skm"))
    assert back.select(rows.columns).exceptAll(rows).count() == 0 and back.count() == rows.count()
    part = rows.first().part
    one = SK.load_spilled(spark, str(tmp_path / "skm"), part)
    assert one.count() == rows.where(rows.part == part).count() and "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().toString()
    R.write_counts(rows.select("mm", "bytes"), str(tmp_path / "t"), text=True)
    assert "\t" in spark.read.text(str(tmp_path / "t")).first()[0]
