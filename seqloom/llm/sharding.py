"""Sharding by a two-pass external shuffle, in DataFrame and SQL functions only.

Pass one scatters records uniformly into buckets of a size that fits in memory, by a seeded hash of their id and text. Pass two
shuffles each bucket by Fisher-Yates (Spark's ``shuffle(array, seed)``) and lays the buckets end to end: a random
permutation of all records, which is cut into shards of equal counts. Where a bucket starts is summed up over spans of ``SPAN`` buckets
and over the spans, so no task sees all buckets.

Law ``rows``: counts of shards differ by at most one.

Defined cases. Null text: size 16. Null ids hash as nulls do and are records like any other. Rows with one id and one text share a
bucket; equal rows are interchangeable and each is kept. An empty table gives an empty result. Extra columns travel along
whatever their names and types; the operator returns the record in one struct column, so nothing can clash. Ties do not arise: the order
within a bucket before its shuffle is by id, then the whole record, or its JSON form if it has columns that have no order, such as maps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType
from pyspark.sql.window import Window

from seqloom.llm.common import partitions_for

#: Bytes of text and overhead in a bucket, and the least number of buckets.
BUCKET_BYTES = 4 << 20
LEAST_BUCKETS = 64
#: Offsets of up to so many buckets (16 bytes each) are broadcast; of more, joined by a shuffle.
BROADCAST_BUCKETS = 200_000
#: Buckets whose counts are summed up in one group.
SPAN = 4096
#: Records in a file of a shard.
FILE_ROWS = 100_000


def record_size(text):
    """UTF-8 bytes of the text (null: none) plus 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(16)


def has_order(kind: DataType) -> bool:
    """Whether values of the type can be sorted."""
    if isinstance(kind, StructType):
        return all(has_order(f.dataType) for f in kind.fields)
    return has_order(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def _sorted_rows(rows, kind: StructType):
    """An array of records (k: the id, r: the whole) in an order that their contents decide."""
    if has_order(kind):
        return F.sort_array(rows)
    keyed = F.transform(rows, lambda x: F.struct(F.struct(x["k"].alias("k"), F.to_json(x["r"]).alias("j")).alias("o"), x["r"].alias("r")))
    by_key = F.array_sort(keyed, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    return F.transform(by_key, lambda x: F.struct(x["o"]["k"].alias("k"), x["r"].alias("r")))


def _offsets(counts: DataFrame) -> DataFrame:
    """_bucket, _offset: records in the buckets before it. counts: _bucket, _n of buckets that have any."""
    own = counts.withColumn("_span", F.expr(f"_bucket div {SPAN}"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for SPAN buckets, of BUCKET_BYTES each: 6,000 rows for 100 TB
    spans = own.groupBy("_span").agg(F.sum("_n").alias("_n")).select("_span", before(Window.orderBy("_span")).alias("_base"))
    inner = own.select("_span", "_bucket", before(Window.partitionBy("_span").orderBy("_bucket")).alias("_in"))
    return inner.join(spans, "_span").select("_bucket", (F.col("_base") + F.col("_in")).alias("_offset"))


def shuffle_into_shards(
    df: DataFrame, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """One row per record: ``record`` (a struct of all columns), ``shard`` int and ``slot`` long, gapless from 0 in its shard."""
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    total = df.agg(F.sum(record_size(text)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    rows, n_buckets = total["n"], max(LEAST_BUCKETS, -(-(total["b"] or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), key, text), F.lit(n_buckets)).alias("_bucket")
    offsets = _offsets(df.select(bucket).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")))

    # the seeded generator runs on through a partition: a fixed number of partitions and a fixed order of their buckets
    # make a task that runs again after a lost executor deal the same permutations
    n_parts = partitions_for(df.sparkSession)
    scattered = df.select(bucket, F.struct(key.alias("k"), F.struct("*").alias("r")).alias("_row")).repartition(n_parts, "_bucket")
    buckets = scattered.groupBy("_bucket").agg(_sorted_rows(F.collect_list("_row"), df.schema).alias("_rows")).sortWithinPartitions("_bucket")
    shuffled = buckets.select("_bucket", F.call_function("shuffle", F.col("_rows"), F.lit(seed)).alias("_rows"))
    placed = shuffled.join(F.broadcast(offsets) if n_buckets <= BROADCAST_BUCKETS else offsets, "_bucket")
    each = placed.select("_offset", F.posexplode("_rows").alias("_at", "_row"))
    at = F.col("_offset") + F.col("_at")
    shard = F.floor(at * F.lit(shards) / F.lit(max(rows, 1))) if rows * shards < 2**52 else F.expr(f"(_offset + _at) * {shards} div {rows}")
    each = each.select(F.col("_row.r").alias("record"), at.alias("_pos"), shard.cast("int").alias("shard"))
    first = F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")
    return each.select("record", "shard", (F.col("_pos") - first).cast("long").alias("slot"))


def shard_digest(df: DataFrame, shards: int = 40, seed: int = 42) -> DataFrame:
    """Per record: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: law ``rows`` has no growth)."""
    out = shuffle_into_shards(df, shards, seed)
    text = F.col("record.text")
    return out.select(
        F.col("record.doc_id").alias("doc_id"),
        record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, file_rows: int = FILE_ROWS, **how) -> None:
    """Writes the records of each shard below ``path/shard=N/run=M``: run M has slots M * file_rows and on, in slot order, so a shard is written by
    as many tasks as it has runs."""
    out = shuffle_into_shards(df, **how).withColumn("run", F.expr(f"slot div {file_rows}"))
    parts = partitions_for(df.sparkSession)
    out.repartition(parts, "shard", "run").sortWithinPartitions("shard", "run", "slot").write.partitionBy("shard", "run").parquet(path)


#: DuckDB SQL of the law: records of each shard and its slots from 0 without a gap.
LAW_SQL = """WITH n AS (SELECT count(*)::BIGINT AS n FROM documents)
SELECT s::INTEGER AS shard, ((s + 1) * n + 39) // 40 - (s * n + 39) // 40 AS n_rows, 0::BIGINT AS first_slot, ((s + 1) * n + 39) // 40 - (s * n + 39) // 40 AS slots FROM range(40) r(s), n
WHERE (s + 1) * n + 39 >= ((s * n + 39) // 40 + 1) * 40"""


def shard_law(df: DataFrame) -> DataFrame:
    """What ``LAW_SQL`` says, from the shards that were made: rows, the first slot and the number of different slots up to the last row's."""
    own = shuffle_into_shards(df).groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("_last"), F.count_distinct("slot").alias("slots"))
    return own.where((F.col("_last") == F.col("slots") - 1)).select("shard", "n_rows", "first_slot", "slots")
