"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed as LZ78 does: each phrase is the longest phrase seen before in this text and one more code point. The set of phrases is hashed,
and its ``KEPT`` least hashes are the signature. The likeness of two signatures is the share that both hold among the ``KEPT`` least
hashes of either: an estimate of the Jaccard likeness of the phrase sets, exact where both have fewer.

``edited`` compares each text with an edited form of itself and with the next document in ascending order of ids. Documents are dealt to
ranges of ids, each in order, with one more row: the first document of the next range. So the text goes through one shuffle and a task
holds two documents at a time.

Defined cases. Null text counts as empty; its fingerprint is the empty string. Two empty fingerprints have likeness 1, an empty and another 0.
Rows that share an id stand in the order of their texts; null ids come first. A single document is its own next. Repeated rows
stay repeated. Empty table: empty result. Texts of any length are parsed whole. Extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import id_and_text, map_batches, partitions_for

KEPT = 128
#: Ranges of ids for each shuffle partition.
RANGES_EACH = 8
_LEAST = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(1 << 16, 2 * n)
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE, np.uint64))])
        _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), np.uint64))])
    return _powers, _inverses


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slice_hashes(text: str, bounds: list[int]) -> np.ndarray:
    """A hash for each text[bounds[k]:bounds[k + 1]] that depends on its content alone."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    powers, inverses = _tables(len(codes))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers[: len(codes)])])
    at = np.array(bounds)
    return _mix((sums[at[1:]] - sums[at[:-1]]) * inverses[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(_BASE))


def parse(text: str, start: int, known: set[str], bounds: list[int], most: int | None = None) -> list[str]:
    """Parses on from ``start`` and puts the ends of phrases in ``bounds``; with ``most`` it stops before the phrase that would end
    beyond. Returns the phrases that ``known`` got. Prefixes of known phrases are known, so the search starts from the last length."""
    i, n, last, new = start, len(text), 3, []
    most = n if most is None else most
    while i < n:
        j = min(i + last, n)
        if text[i:j] in known:
            j += 1
            while j <= n and text[i:j] in known:
                j += 1
        else:
            j -= 1
            while j > i and text[i:j] not in known:
                j -= 1
            j += 1
        last = j - i
        end = min(j, n)
        if end > most:
            break
        if j <= n:
            phrase = text[i:j]
            known.add(phrase)
            new.append(phrase)
        bounds.append(end)
        i = end
    return new


def signature(hashes: np.ndarray) -> np.ndarray:
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:KEPT]


def written(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype(">u4").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((counts[:KEPT] == 2).mean())


def fingerprint(text: str | None) -> str:
    bounds = [0]
    parse(text or "", 0, set(), bounds)
    return written(signature(slice_hashes(text or "", bounds)))


class Parsed:
    """A document's signature, and what is needed to parse its edited form from the edit on."""

    def __init__(self, text: str | None):
        self.text = text or ""
        n = len(self.text)
        self.cut = n - n // 4
        self.known: set[str] = set()
        self.bounds = [0]
        parse(self.text, 0, self.known, self.bounds, self.cut)
        full = [*self.bounds]
        for phrase in parse(self.text, full[-1], self.known, full):
            self.known.discard(phrase)
        hashes = slice_hashes(self.text, full)
        self.shared = hashes[: len(self.bounds) - 1]
        self.sig = signature(hashes)

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The edited text and its signature; the parse up to the edit is not done again."""
        text = self.text[: self.cut] + other[: len(self.text) - self.cut]
        bounds = [self.bounds[-1]]
        parse(text, bounds[0], self.known, bounds)
        rest = slice_hashes(text[bounds[0] :], [x - bounds[0] for x in bounds])
        return text, signature(np.concatenate([self.shared, rest]))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows _b, _look, _id, _text in order: a result for each row with _look 0, against the row that follows in its range."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    before: tuple | None = None
    for batch in batches:
        rows = []
        for b, look, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if before is not None and before[0] == b and before[1] and look:
                continue
            now = (b, look, key, Parsed(text))
            if before is not None and before[0] == b and not before[1]:
                own, other = before[3], now[3]
                edited, sig = own.edited(other.text)
                rows.append((before[2], len(own.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(own.sig), written(sig), likeness(own.sig, sig), likeness(own.sig, other.sig)))
            before = now
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _literal(values: list, kind: str) -> Column:
    """An array of values as one literal: the plan doesn't grow with their number."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most key, found in two steps of about sqrt(len(bounds)) comparisons."""
    if not bounds:
        return F.lit(0)
    m = max(1, round(len(bounds) ** 0.5))
    under = lambda values: F.size(F.filter(values, lambda x: x <= key))
    coarse = under(_literal(bounds[m - 1 :: m], "long"))
    return coarse * m + under(F.slice(_literal(bounds, "long"), coarse * m + 1, F.lit(m)))


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likeness to it and to the next document."""
    spark = df.sparkSession
    own = id_and_text(df, id_col, text_col).withColumn("_o", F.coalesce("_id", F.lit(_LEAST)))
    n_ranges = RANGES_EACH * partitions_for(spark)
    found = own.select("_o").approxQuantile("_o", [k / n_ranges for k in range(1, n_ranges)], 0.25 / n_ranges)
    bounds = sorted({int(x) for x in found})
    own = own.withColumn("_b", _range_of(F.col("_o"), bounds))
    # at most n_ranges rows, of which the number does not depend on the data
    heads = {r["_b"]: r["o"] for r in own.select("_b", "_o").groupBy("_b").agg(F.min("_o").alias("o")).collect()}
    order = sorted(heads)
    before = {b: order[k - 1] for k, b in enumerate(order)}
    size = len(bounds) + 1
    at = lambda values, kind: F.element_at(_literal([values.get(k) for k in range(size)], kind), F.col("_b") + 1)
    here = F.struct(F.col("_b"), F.lit(0).alias("_look"))
    ahead = F.struct(at(before, "int").alias("_b"), F.lit(1).alias("_look"))
    dealt = own.withColumn("_to", F.explode(F.when(F.col("_o") == at(heads, "long"), F.array(here, ahead)).otherwise(F.array(here))))
    dealt = dealt.select(F.col("_to._b").alias("_b"), F.col("_to._look").alias("_look"), "_o", "_id", "_text")
    dealt = dealt.repartition(partitions_for(spark), "_b").sortWithinPartitions("_b", "_look", "_o", "_text").select("_b", "_look", "_id", "_text")
    return map_batches(dealt, _compare, SCHEMA)
