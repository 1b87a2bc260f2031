import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.config import CountConfig
from seqloom.functions import sequence as S
from seqloom.functions import vector as V
from seqloom.operators import kmers as K
from seqloom.operators import superkmers as SK
from seqloom.sources import reads as R

STRING = "AAAAAAAAACCCCCCCAAAAAAATGA"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def norm(s):
    return "".join(c for c in (s or "") if c in "ACGTNUacgtnu").upper().translate(str.maketrans("NU", "AA"))


def model_minimizers(seq, k, p, bad):
    import re

    keep = lambda x: "T" * p if bad and re.search(bad, x) else x
    pm = [min(keep(seq[i : i + p]), keep(rc(seq[i : i + p]))) for i in range(len(seq) - p + 1)]
    return [min(pm[i : i + k - p + 1]) for i in range(len(seq) - k + 1)]


def random_reads(n=60, seed=1):
    rng = random.Random(seed)
    return [(k, None, "".join(rng.choice("ACGTACGTNacgu-\ré") for _ in range(rng.choice([0, 5, 21, 40, 300])))) for k in range(n)] + [(n, None, "A" * 400), (n + 1, None, "ACACAC" * 30), (n + 2, None, "CCCG" + "A" * 60 + "GT" + "C" * 40)]


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(random_reads(), "read_id long, source string, seq string")


def test_base_map(spark):
    df = spark.createDataFrame([("ACGTNUacgtnu",)], "s string")
    assert df.select(S.pmer_code(S.normalize(F.col("s")))).first()[0] == int("012300012300", 4)
    assert df.select(S.complement(S.normalize(F.col("s")))).first()[0] == "TGCATTTGCATT"


@pytest.mark.parametrize(
    ("pmer", "default", "signature"),
    [("AAAAA", 0, 0), ("ACAGG", 0, 0), ("CAAGT", 0, 0), ("CCAGT", 0, 1), ("AGAGT", 1, 1), ("GTAAA", 0, 0), ("TTTTT", 1, 1), ("GAAGT", 1, 0), ("CGAAC", 1, 0)],
)
def test_filters(spark, pmer, default, signature):
    df = spark.createDataFrame([(pmer,)], "s string")
    got = df.select(*[S.is_valid_pmer(F.col("s"), f) for f in ("default", "signature", "canonical")]).first()
    assert tuple(got) == (bool(default), bool(signature), True)
    code = np.array([int(pmer.translate(str.maketrans("ACGT", "0123")), 4)], np.uint64)
    assert [bool(V._valid(code, 5, f)[0]) for f in ("default", "signature", "canonical")] == list(got)


def test_super_kmers_of_the_golden_string():
    bases, offsets = V.batch_bases(pa.array([STRING]))
    packed = V.pack_read(bases)
    assert packed.tolist() == [192, 192, 192, 213, 213, 208, 192, 195, 160]
    s = V.super_kmers(bases, offsets, 10, 5, "default")
    assert list(zip(s["beg"], s["end"], s["mm"])) == [(0, 1, 767), (1, 2, 703), (2, 8, 21), (8, 9, 85), (9, 14, 336), (14, 16, 255), (16, 17, 56)]
    assert [(4294967295 - int(m)) % 31 for m in s["mm"]] == [11, 13, 13, 11, 8, 27, 9]
    want = [[192, 192, 192, 85], [128, 192, 192, 149], [64, 192, 192, 213, 213, 144], [64, 213, 213, 208, 0], [213, 213, 208, 192, 131], [85, 208, 192, 195, 96], [144, 192, 195, 160]]
    for b, e, w in zip(s["beg"], s["end"], want):
        made = V.pack_super_kmer(packed, int(b), int(e), 10)
        assert list(made) == w and (V.unpack_super_kmer(made) == bases[b : e + 9]).all()
    s = V.super_kmers(bases, offsets, 10, 5, "signature")
    assert list(zip(s["beg"], s["end"], s["mm"])) == [(0, 1, 767), (1, 2, 703), (2, 8, 21), (8, 9, 85), (9, 13, 340), (13, 14, 1002), (14, 16, 255), (16, 17, 56)]
    s = V.super_kmers(bases, offsets, 10, 5, "canonical")
    assert list(zip(s["beg"], s["end"], s["mm"])) == [(0, 5, 0), (5, 6, 1), (6, 7, 5), (7, 8, 21), (8, 9, 85), (9, 10, 320), (10, 11, 256), (11, 17, 0)]
    codes = [1, 5, 21, 56, 85, 341, 1365, 5461, 21844, 87376, 262138, 262158, 344064, 348160, 349184, 349440, 349504]
    assert sorted(V.kmer_codes(bases, V.starts_of(offsets, 10), 10)[0].tolist()) == codes


def test_run_compression(spark):
    df = spark.createDataFrame([("AAACCGTT",), ("",), ("A",)], "s string")
    assert [tuple(r) for r in df.select(S.compress_runs(F.col("s")), S.run_starts(F.col("s"))).collect()] == [("ACGT", [0, 3, 5, 6]), ("", []), ("A", [0])]


@pytest.mark.parametrize("k", [1, 15, 21, 31, 32, 33, 55, 64])
@pytest.mark.parametrize("canonical", [True, False])
def test_counts_against_a_model(spark, reads, k, canonical):
    want = Counter()
    for _, _, s in random_reads():
        s = norm(s)
        want.update(min(x, rc(x)) if canonical else x for x in (s[i : i + k] for i in range(len(s) - k + 1)))
    got = {r.kmer: r.cnt for r in K.kmer_strings(K.kmer_code_counts(reads, k, canonical), k).collect()}
    assert got == dict(want)


@pytest.mark.parametrize(("kind", "bad"), [("default", "^[AC][AC]A|AAA$"), ("signature", ".AA|^A[AC]A"), ("canonical", None)])
@pytest.mark.parametrize(("k", "p"), [(21, 7), (10, 3), (16, 16), (40, 5)])
def test_super_kmers_against_a_model(spark, reads, kind, bad, k, p):
    cfg = CountConfig(k=k, p=p, pmer_filter=kind)
    want = {}
    for i, _, s in random_reads():
        s = norm(s)
        mins = model_minimizers(s, k, p, bad) if len(s) >= k else []
        runs = []
        for pos, m in enumerate(mins):
            if runs and runs[-1][2] == m:
                runs[-1][1] = pos + 1
            else:
                runs.append([pos, pos + 1, m])
        for b, e, m in runs:
            want[i, b] = (e, m, s[b : e + k - 1], (b % 3 + e - b + k - 1) // 3 + 1)
    rows = SK.super_kmers(reads, cfg).collect()
    assert {(r.read_id, r.beg): (r.end, r.mm, r.bases, r.bytes) for r in rows} == want and len(rows) == len(want)
    packed = {(r.read_id, r.beg): r for r in SK.unpack(SK.packed_super_kmers(reads, cfg)).collect()}
    assert {x: (r.bases, len(r.packed)) for x, r in packed.items()} == {x: v[2:] for x, v in want.items()}


def test_invariants(spark, reads):
    total = sum(max(0, len(norm(s)) - 20) for _, _, s in random_reads())
    counts = K.count_kmers(reads)
    assert counts.agg(F.sum("cnt")).first()[0] == total
    want = sorted(map(tuple, counts.collect()))
    back = spark.createDataFrame([(i, None, rc(norm(s))) for i, _, s in random_reads()], reads.schema)
    assert sorted(map(tuple, K.count_kmers(back).collect())) == want
    for cfg in (CountConfig(), CountConfig(p=5, parts=7, pmer_filter="signature"), CountConfig(p=16, parts=1, pmer_filter="canonical")):
        parted = SK.count_by_partition(reads, cfg)
        assert sorted((r.kmer, r.cnt) for r in parted.collect()) == want
        stats = SK.partition_stats(reads, cfg)
        assert stats.count() == cfg.parts and stats.agg(F.sum("kmer_cnt")).first()[0] == total
        assert SK.partition_distinct(reads, cfg).agg(F.sum("distinct_kmers")).first()[0] == len(want)
    assert sorted(map(tuple, K.count_kmers(R.in_blocks(R.normalized(reads, 21), 21, 37)).collect())) == want
    bounded = K.count_kmers(reads, CountConfig(min_freq=2, max_freq=5))
    assert sorted(map(tuple, bounded.collect())) == [r for r in want if 2 <= r[1] <= 5]
    assert {r.cnt for r in K.clamped(counts, 1).collect()} == {1}


def test_chunks_change_nothing(monkeypatch):
    bases, offsets = V.batch_bases(pa.array([r[2] for r in random_reads()]))
    at = V.starts_of(offsets, 21)
    whole = V.kmer_codes(bases, at, 21)[0], V.minimizers(bases, at, 21, 7, "default")
    monkeypatch.setattr(V, "CHUNK", 50)
    parts = np.concatenate([V.kmer_codes(b, a, 21)[0] for b, a in V.chunks_of(bases, at, 21)])
    assert (parts == whole[0]).all() and (V.minimizers(bases, at, 21, 7, "default") == whole[1]).all()


def test_size_summary(spark):
    sizes = [5, 9, 9, 0]
    stats = spark.createDataFrame(list(enumerate(sizes)), "part int, bytes long")
    r = SK.size_summary(stats).first()
    avg = sum(sizes) // 4
    var = sum((x - avg) ** 2 for x in sizes) / 4
    assert (r.n, r.avg, r.max, r.argmax, r.min, r["var"], r.std, r.cv) == (4, avg, 9, 1, 0, round(var, 3), round(var**0.5, 3), round(var**0.5 / avg, 6))


def test_empty_and_null(spark, reads):
    none = reads.limit(0)
    assert K.count_kmers(none).count() == 0 and SK.super_kmers(none).count() == 0 and SK.minimizers(none).count() == 0
    assert K.totals(none).first() == (0, 0) and SK.size_summary(SK.partition_stats(none)).first().max == 0
    odd = spark.createDataFrame([(1, None, None), (2, None, ""), (None, None, "ACGT" * 9)], reads.schema)
    assert K.totals(odd).first().total_kmers == 16 and SK.super_kmers(odd).agg(F.sum(F.col("end") - F.col("beg"))).first()[0] == 16


def test_config_checks():
    for bad in ({"k": 0}, {"k": 65}, {"p": 2}, {"p": 17}, {"k": 5, "p": 7}, {"parts": 0}, {"pmer_filter": "x"}, {"min_freq": 5, "max_freq": 2}):
        with pytest.raises(ValueError):
            CountConfig(**bad)


def test_groups_of_runs_pack_and_unpack():
    rng = np.random.default_rng(6)
    bases = rng.integers(0, 4, 900).astype(np.uint8)
    lengths = rng.integers(1, 40, 30)
    starts = rng.integers(0, 850, 30)
    heads = np.array([0, 1, 9, 29])
    data, at = V.pack_groups(bases, starts, lengths, heads)
    for g, (a, b) in enumerate(zip(heads, [*heads[1:], 30])):
        own, offsets = V.unpack_group(data[at[g] : at[g + 1]].tobytes(), lengths[a:b].astype("<u4"))
        for k in range(a, b):
            assert (own[offsets[k - a] : offsets[k - a + 1]] == bases[starts[k] : starts[k] + lengths[k]]).all()


def test_tally_adds_counts():
    low, high = np.array([5, 5, 2, 5], np.uint64), np.array([1, 0, 1, 1], np.uint64)
    assert [x.tolist() for x in V.tally(low, high)] == [[0, 1, 1], [5, 2, 5], [1, 1, 2]]
    assert [x.tolist() for x in V.tally(low, None, np.array([4, 1, 7, 1]))] == [[0, 0], [2, 5], [7, 6]]
    assert [len(x) for x in V.tally(low[:0], None)] == [0, 0, 0]
