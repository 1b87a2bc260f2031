import pytest

from seqloom.cli import main, parser
from seqloom.config import CountConfig
from seqloom.operators import kmers as K
from seqloom.operators import superkmers as SK
from seqloom.plans import counting
from seqloom.streaming import ingest
from tests.test_sequence import random_reads


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(random_reads(), "read_id long, source string, seq string")


def test_both_ways_agree(spark, reads):
    want = sorted(map(tuple, K.count_kmers(reads).collect()))
    assert sorted(map(tuple, counting.count_reads(reads).collect())) == want
    assert sorted(map(tuple, counting.count_reads(reads, via_super_kmers=True).collect())) == want
    row = counting.report(reads).first()
    assert row.distinct_kmers == len(want) and row.kmer_cnt == sum(c for _, c in want) and row.part_n == 31
    squeezed = CountConfig(hpc=True)
    assert sorted(map(tuple, counting.count_reads(reads, squeezed).collect())) == sorted(map(tuple, counting.count_reads(reads, squeezed, True).collect()))


@pytest.mark.parametrize("k", [21, 55])
@pytest.mark.parametrize("group", [SK.GROUP_KMERS, 40])
def test_exchange_with_groups_over_size(spark, reads, monkeypatch, tmp_path, k, group):
    hot = spark.createDataFrame([(900 + n, None, "A" * 400 + "C" * (n % 3)) for n in range(30)] + [(990, None, None), (991, None, "")], reads.schema)
    every, cfg = reads.unionByName(hot), CountConfig(k=k, parts=5)
    monkeypatch.setattr(SK, "BLOCK_SKMS", 50)
    want = sorted(map(tuple, K.count_kmers(every, cfg).collect()))
    assert sorted(map(tuple, SK.count_by_partition(every, cfg, group).select("kmer", "cnt").collect())) == want
    monkeypatch.setattr(SK, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, SK.count_by_partition(every, cfg, group).select("kmer", "cnt").collect())) == want
    assert sorted(map(tuple, counting.count_spilled(spark, every, str(tmp_path / "s"), cfg).collect())) == want
    assert SK.count_by_partition(reads.limit(0), cfg, group).count() == 0


def test_reads_in_splits_enough_are_not_shuffled(spark, reads, tmp_path, monkeypatch):
    reads.write.parquet(str(tmp_path / "r"))
    table = spark.read.parquet(str(tmp_path / "r"))
    exchanges = lambda: K.spread(table)._jdf.queryExecution().optimizedPlan().toString().count("Repartition")
    assert exchanges() == 1
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert exchanges() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_metrics_and_key_order(spark, reads):
    got = {r.metric: r.value for r in counting.metrics(reads).collect()}
    row = counting.report(reads).first()
    assert got["distinct_kmers"] == row.distinct_kmers and got["skm_cnt"] == row.skm_cnt and got["reads_in"] == reads.count()
    own = K.ranked(SK.count_by_partition(reads)).collect()
    for part in {r.part for r in own}:
        rows = sorted((r.rank, r.kmer) for r in own if r.part == part)
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and [r[1] for r in rows] == sorted(r[1] for r in rows)


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(">1\n" + "ACGTTGCATTAGACGTACC" * 5 + "\n")
    assert main(["-read", str(tmp_path / "a.fa"), "-out", str(tmp_path / "out"), "-tmp", str(tmp_path / "skm"), "-min", "2"]) == 0
    assert "kmer_cnt=75" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "out")).where("cnt < 2").count() == 0 and (tmp_path / "skm").exists()
    args = parser().parse_args(["-read", "x", "y"])
    assert (args.read, args.k, args.p, args.skm) == (["x", "y"], 21, 7, 31)


def test_stream(spark, reads, tmp_path):
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.counting_writer(stream, str(tmp_path / "out"), str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = ingest.current_counts(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, K.count_kmers(reads).collect()))
