"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has 64 bits. Fingerprints are split into six blocks; two that differ in at most three bits agree on at
least three whole blocks, so they meet under one of the 20 choices of three blocks (about 32 bits, hence few chance meetings
even among billions). A meeting group of more than ``GROUP`` fingerprints, as many variants of one template make, is split again by the same
principle: its free bits in four blocks, of which any pair of links agrees on one, until groups are small; after four such rounds
12 bits are free. Within a group distances are verified, and the group gives a spanning forest of its
links, never all pairs. Components of that forest are the components of the link graph.

Defined cases. Null or empty text and text without words: fingerprint zero, linked like any other. Fewer words than a shingle:
the whole sequence is the one shingle. Equal texts share a fingerprint, so copies of any number are one node. A null id
keeps its row, with its fingerprint; fingerprints that only rows without an id have are not linked, and their component is null. Repeated rows stay
repeated. Empty table: empty result. Texts of any length are read whole. Extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Renamed, id_and_text, map_batches, partitions_for, use_checkpoints
from seqloom.llm.components import components

WORDS, SEED, MOST_BITS = 3, 42, 3
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Most fingerprints that a task compares with each other, unless only 12 bits of them are free; rounds that split larger groups.
GROUP, ROUNDS = 20_000, 4
#: Tasks that the rows of a large group are dealt to while it is told from the others.
SALTS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-WORDS].tolist()]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - WORDS + 1
    stops = (ends[WORDS - 1 :] - 1).tolist()
    for k in range(0, n, 4096):
        part = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + 4096], stops[k : k + 4096], strict=True)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["_id", "_fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _fp (the fingerprint as a signed long) for each row."""
    return map_batches(id_and_text(df, id_col, text_col), _fingerprints, "_id long, _fp long")


def choices() -> list[int]:
    """The masks of all choices of len(BLOCKS) - MOST_BITS blocks."""
    starts = np.cumsum([0, *BLOCKS])
    masks = [((1 << w) - 1) << int(s) for w, s in zip(BLOCKS, starts, strict=False)]
    return [sum(x) for x in combinations(masks, len(BLOCKS) - MOST_BITS)]


def longer(mask: int) -> list[int]:
    """The mask with each of MOST_BITS + 1 blocks of its free bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in own) for own in np.array_split(free, MOST_BITS + 1)]


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs (member, first of its part) that span the link graph of these distinct fingerprints."""
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        first, queue, left = int(left[0]), [int(left[0])], left[1:]
        while queue and len(left):
            near = np.bitwise_count(fps[left] ^ fps[queue.pop()]) <= MOST_BITS
            if near.any():
                new = left[near].tolist()
                queue += new
                out += [(x, first) for x in new]
                left = left[~near]
    return out


def _linked(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
    cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
    bounds = np.concatenate([[0], cut, [len(cols[0])]])
    a, b = [], []
    for k in np.flatnonzero(np.diff(bounds) > 1):
        s, e = bounds[k], bounds[k + 1]
        order = np.argsort(cols[3][s:e], kind="stable")
        nodes = cols[3][s:e][order]
        for x, y in forest(cols[2][s:e][order].view(np.uint64)):
            a.append(nodes[y])
            b.append(nodes[x])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows _mask, _key, _fp, _node, sorted by the first two: the spanning links of each group, as nodes a, b."""
    kept: list[list[np.ndarray]] = []  # the group that is not whole yet
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        at = int(last[-1]) + 1 if len(last) else 0
        if at or kept and (kept[-1][0][-1], kept[-1][1][-1]) != (cols[0][0], cols[1][0]):
            yield _linked([*kept, [x[:at] for x in cols]])
            kept = []
        kept.append([x[at:] for x in cols])
    if kept:
        yield _linked(kept)


def _linked_rows(keyed: DataFrame) -> DataFrame:
    dealt = keyed.repartition(partitions_for(keyed.sparkSession), "_mask", "_key").sortWithinPartitions("_mask", "_key")
    return map_batches(dealt.select("_mask", "_key", "_fp", "_node"), _links, "a long, b long", 8192)


def block_links(nodes: DataFrame) -> DataFrame:
    """Links a, b that span the link graph of nodes: _fp, distinct, and _node, its number."""
    spark, masks, out = nodes.sparkSession, choices(), None
    explode = lambda of: F.explode(F.array(*[F.lit(_signed(m)) for m in of]))
    key = F.col("_fp").bitwiseAND(F.col("_mask")).alias("_key")
    keyed = nodes.select("_fp", "_node", explode(masks).alias("_mask")).select("_mask", key, "_fp", "_node")
    for _ in range(ROUNDS):
        large = keyed.groupBy("_mask", "_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP).checkpoint()
        if large.isEmpty():
            break
        salted = large.select("_mask", "_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long").alias("_salt"), F.lit(True).alias("_large"))
        told = keyed.withColumn("_salt", F.pmod(F.xxhash64("_fp"), F.lit(SALTS))).join(salted, ["_mask", "_key", "_salt"], "left").checkpoint()
        links = _linked_rows(told.where("_large IS NULL"))
        out = links if out is None else out.unionByName(links)
        # 20 masks, four times as many in each round
        wider = spark.createDataFrame([(_signed(m), [_signed(x) for x in longer(m)]) for m in masks], "_mask long, _wider array<long>")
        masks = [x for m in masks for x in longer(m)]
        keyed = told.where("_large").join(F.broadcast(wider), "_mask").select("_fp", "_node", F.explode("_wider").alias("_mask")).select("_mask", key, "_fp", "_node")
    links = _linked_rows(keyed)
    return links if out is None else out.unionByName(links)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _id, _fp and _component, the least id that links reach."""
    spark = df.sparkSession
    use_checkpoints(spark)
    prints = fingerprints(df, id_col, text_col).checkpoint()
    nodes = prints.groupBy("_fp").agg(F.min("_id").alias("_node")).checkpoint()
    roots = components(block_links(nodes.where("_node IS NOT NULL")))
    named = nodes.join(roots.withColumnRenamed("node", "_node"), "_node", "left").select("_fp", F.coalesce("root", "_node").alias("_component"))
    return prints.join(named, "_fp").select("_id", "_fp", "_component")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicate_digest(df: DataFrame) -> DataFrame:
    found = near_duplicates(df)
    return found.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document with the least id, unchanged. Rows that repeat an id are one document; rows without one stay."""
    own = Renamed(df)
    gone = near_duplicates(df, id_col, text_col).where("_id <> _component").select("_id").distinct()
    return own.back(own.frame.join(gone, own.at(id_col).cast("long") == F.col("_id"), "left_anti"))
