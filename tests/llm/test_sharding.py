import zlib

from pyspark.sql import functions as F

from seqloom.llm import sharding


def frame(spark, n=500):
    rows = [(k, f"text é {k % 7} " * (k % 40), "x") for k in range(n)] + [(n, None, "y"), (n + 1, "", "y"), (None, "no id", "y"), (3, "same id", "y"), (4, "twice", "y"), (4, "twice", "y"), (n + 2, "long " * 100_000, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)


def test_digest_is_a_permutation_in_even_shards(spark):
    df = frame(spark)
    rows = sharding.shard_digest(df, 7).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
    by = {}
    for r in rows:
        assert (r.law, r.grown_shard) == ("rows", None)
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(7)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_order_is_mixed_and_repeats_itself(spark):
    df = frame(spark).where("doc_id IS NOT NULL")
    one, two = ([(r.doc_id, r.shard, r.slot) for r in sharding.shard_digest(df, 3).sort("shard", "slot", "doc_id").collect()] for _ in range(2))
    assert one == two
    ids = [x[0] for x in one]
    assert sum(a + 1 == b for a, b in zip(ids, ids[1:])) < 15
    other = [(r.doc_id, r.shard, r.slot) for r in sharding.shard_digest(df, 3, seed=1).sort("shard", "slot", "doc_id").collect()]
    assert other != one


def test_fewer_records_than_shards_and_none(spark):
    df = frame(spark).where("doc_id < 5 AND text NOT IN ('same id', 'twice')")
    rows = sharding.shard_digest(df, 40).collect()
    assert len(rows) == 5 and len({r.shard for r in rows}) == 5 and {r.slot for r in rows} == {0}
    assert sharding.shard_digest(df.limit(0)).count() == 0


def test_written_shards_hold_whole_records(spark, tmp_path):
    df = frame(spark)
    sharding.write_shards(df.withColumnRenamed("shard", "extra"), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out")).select("record.*")
    assert back.columns == ["doc_id", "text", "extra"] and back.exceptAll(df).count() == 0 == df.exceptAll(back.withColumnRenamed("extra", "shard")).count()
    native = sharding.shard_digest(df)._jdf.queryExecution().toString()
    assert not any(x in native for x in ("Python", "Pandas", "Arrow"))
    assert sharding.shard_digest(df).where(F.col("slot") < 0).count() == 0


def test_columns_without_an_order_travel_along(spark):
    df = frame(spark).selectExpr("doc_id", "text", "map(shard, doc_id) AS r", "array(map(1, text)) AS k", "parse_json('{}') AS v")
    out = sharding.shuffle_into_shards(df, 3)
    rows = out.selectExpr("record.doc_id", "map_keys(record.r)[0] AS shard", "shard AS s", "slot").collect()
    assert sorted((str(r[0]), r[1]) for r in rows) == sorted((str(r.doc_id), r.shard) for r in frame(spark).collect())
    assert len({(r.s, r.slot) for r in rows}) == len(rows)


def test_buckets_of_several_spans_and_their_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "SPAN", 5)
    df = frame(spark)
    out = sharding.shuffle_into_shards(df, 40, bucket_bytes=2000).selectExpr("shard * 1000 + slot AS p").collect()
    assert len({r.p for r in out}) == df.count()
    sharding.write_shards(df.withColumnRenamed("shard", "extra"), str(tmp_path / "o"), file_rows=50, shards=2)
    runs = spark.read.parquet(str(tmp_path / "o")).selectExpr("shard", "run", "slot div 50 = run AS ok")
    assert runs.where("NOT ok").count() == 0 and runs.select("shard", "run").distinct().count() == 12


def test_law_against_its_sql(spark):
    import duckdb

    for n in (500, 17):
        df = frame(spark, n) if n > 40 else frame(spark).where("doc_id < 17")
        documents = df.select("doc_id").toPandas()  # noqa: F841
        want = sorted(duckdb.sql(sharding.LAW_SQL).fetchall())
        assert sorted(map(tuple, sharding.shard_law(df).select("shard", "n_rows", "first_slot", "slots").collect())) == want
