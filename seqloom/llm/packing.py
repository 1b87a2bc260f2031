"""Packing documents into sequences of a fixed number of tokens: best fit, then swap-based local search.

A document is its token ids and one separator id. Only documents longer than a sequence are cut: into whole
sequences, of which the first piece may be shorter. Whole pieces fill a sequence each. The others are dealt by a seeded hash to
groups of about ``GROUP`` sequences, whatever the documents' lengths; a group is packed by best fit on falling lengths and then improved: moves of a document,
exchanges of one for one and of two for one between any two underfull bins, each raising the sum of squared fills, until bins run empty and
the least possible number of bins is reached or no move or exchange is left that raises it.
A group that reaches its least number leaves at most one bin that a packing of the whole corpus might save, a thousandth of its own.

Defined cases. Null text counts as empty: one separator. Rows with one id, or null ids, are documents of their own and stay. Ties
are broken by length, then id, then checksum. Empty table: empty result. Texts of any length are encoded whole. Extra columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm.bpe import byte_symbols
from seqloom.llm.common import id_and_text, map_batches

CAPACITY, SEPARATOR = 2048, 0
#: Sequences of a group, reckoned at TOKEN bytes a token, and documents at most.
GROUP, TOKEN, GROUP_ROWS = 1000, 4, 100_000
#: Bytes of words and ids that a worker remembers; beyond, it starts anew. Parts of more characters than LONG are encoded and forgotten.
REMEMBERED, LONG = 160 << 20, 64
#: Bytes that an entry takes besides its characters and ids.
ENTRY = 250

_RUN = re.compile(r"\s\s|^\s|\s$")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_encoders: dict[int, Encoder] = {}

# The pattern of byte-level tokenizers, and the characters of which no two Unicode versions differ in class.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LATIN = re.compile("[\x00-\u024f]*")


def _ranked(made: dict):
    """The same tokenizer by ranks, three times as fast on single words, if ids follow the order of merges; else None."""
    import tiktoken

    first, model = made.get("pre_tokenizer") or {}, made["model"]
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not made.get("normalizer")
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if not plain or None in merged or merged != sorted(merged) or any(model.get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges")):
        return None
    of = {c: b for b, c in enumerate(byte_symbols())}
    added = {t["content"] for t in made.get("added_tokens", [])}
    if any(c not in of for t in model["vocab"] if t not in added for c in t):
        return None
    ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    return tiktoken.Encoding("by_ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """The ids of a byte-level tokenizer of which no token spans the start of a space before a word.

    A text is cut at single spaces between other characters, and the ids of each part are remembered. ``special`` are contents of
    added tokens: texts that hold one are encoded as they are. Long parts go to the library, as ranks fail on long runs of white space.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _ranked(json.loads(spec))
        self.known: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.held = 0

    def _encoded(self, parts: set[str], lead: str) -> dict[str, bytes]:
        out, fresh = {}, list(parts)
        if self.ranked:
            encode = self.ranked.encode_ordinary
            for part in fresh:
                if len(part) <= LONG and _LATIN.fullmatch(part):
                    out[part] = _bytes(encode(lead + part))
            fresh = [x for x in fresh if x not in out]
        for k in range(0, len(fresh), 4096):
            some = fresh[k : k + 4096]
            for part, e in zip(some, self.tokenizer.encode_batch_fast([lead + x for x in some], add_special_tokens=False), strict=True):
                out[part] = _bytes(e.ids)
        return out

    def _ids(self, parts: list[str], lead: str) -> bytes:
        """Ids of parts, each with ``lead`` before it."""
        known = self.known[lead]
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            made = self._encoded(set(parts).difference(known), lead)
        out = b"".join([made[x] if x in made else known[x] for x in parts])
        short = {x: ids for x, ids in made.items() if len(x) <= LONG}
        size = sum(ENTRY + 2 * len(x) + len(ids) for x, ids in short.items())
        if self.held + size > REMEMBERED:
            self.held = 0
            for own in self.known.values():
                own.clear()
        if size <= REMEMBERED:
            known.update(short)
            self.held += size
        return out

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.special):
            return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = _BETWEEN.split(text) if _RUN.search(text) else text.split(" ")
        return self._ids(parts[:1], "") + self._ids(parts[1:], " ")


def encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(k, capacity) for k in range(head, n, capacity)]


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices. Each size, in falling order, goes to the fullest bin that has room for it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin has room r
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fitting = rooms >> sizes[k]
        if fitting:
            room = sizes[k] + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(k)
        by_room[room - sizes[k]].append(at)
        rooms |= 1 << (room - sizes[k])
    return bins


def _sums(items: list[int], sizes: list[int]) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
    """An item of each size in a bin, and two items of each sum of two. Sizes that differ are few: their sum is a capacity at most."""
    of: dict[int, list[int]] = {}
    for x in items:
        of.setdefault(sizes[x], []).append(x)
    two: dict[int, tuple[int, ...]] = {}
    for a, own in of.items():
        if len(own) > 1:
            two.setdefault(2 * a, (own[0], own[1]))
        for b, more in of.items():
            if a < b:
                two.setdefault(a + b, (own[0], more[0]))
    return {a: (own[0],) for a, own in of.items()}, two


class _Gives:
    """What bins can give, by reach: the sum given and the bin's room, so the largest sum it can then take. Of each reach the least sum is known."""

    def __init__(self, capacity: int):
        self.least = np.full(capacity + 1, capacity + 1, np.int32)
        self.heaps: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.holders: dict[tuple[int, int], dict[int, None]] = {}

    def add(self, at: int, room: int, sums: Iterable[int]) -> None:
        for s in sums:
            own = self.holders.setdefault((room + s, s), {})
            if not own:
                heapq.heappush(self.heaps[room + s], s)
                self.least[room + s] = self.heaps[room + s][0]
            own[at] = None

    def remove(self, at: int, room: int, sums: Iterable[int]) -> None:
        for s in sums:
            own = self.holders[room + s, s]
            del own[at]
            if not own:
                del self.holders[room + s, s]
                heap = self.heaps[room + s]
                while heap and (room + s, heap[0]) not in self.holders:
                    heapq.heappop(heap)
                self.least[room + s] = heap[0] if heap else len(self.least)

    def find(self, taken: int, room: int) -> tuple[int, int] | None:
        """The least sum to give for ``taken`` of a donor with that room so that squares grow, and its bin.

        The other bin gains ``taken`` less the sum: at most its room, so its reach is ``taken`` at least. The sum of squares rises if it then holds
        more than the donor did, so if its reach is less than ``taken`` and the donor's room.
        """
        window = self.least[taken : taken + room]
        if not len(window) or (s := int(window[k := int(window.argmin())])) >= taken:
            return None
        return s, next(iter(self.holders[taken + k, s]))


def local_search(bins: list[list[int]], sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins after moves and exchanges between all underfull ones. It ends at the least possible number of bins, or when no move or exchange
    of any two bins raises the sum of squared fills."""
    least = -(-sum(sizes) // capacity)
    bins = [list(b) for b in bins if b]
    count = len(bins)
    if count <= least:
        return bins
    fills = [sum(sizes[x] for x in b) for b in bins]
    sums = [_sums(b, sizes) for b in bins]
    # for one item a bin gives none, one or two; for two it gives one
    for_one, for_two = _Gives(capacity), _Gives(capacity)

    def enter(k: int, leave: bool = False) -> None:
        if 0 < fills[k] < capacity:
            one, two = sums[k]
            (for_one.remove if leave else for_one.add)(k, capacity - fills[k], {0, *one, *two})
            (for_two.remove if leave else for_two.add)(k, capacity - fills[k], one)

    for k in range(len(bins)):
        enter(k)
    changed = True
    while changed and count > least:
        changed = False
        for donor in sorted(range(len(bins)), key=lambda k: (fills[k], k)):
            while count > least and 0 < fills[donor] < capacity:
                enter(donor, leave=True)
                best = None
                for gives, held in ((for_one, sums[donor][0]), (for_two, sums[donor][1])):
                    for taken in sorted(held, reverse=True):
                        if best and taken <= best[0]:
                            break
                        if (found := gives.find(taken, capacity - fills[donor])) and (not best or taken - found[0] > best[0]):
                            best = taken - found[0], held[taken], *found
                if not best:
                    enter(donor)
                    break
                gain, take, s, other = best
                enter(other, leave=True)
                one, two = sums[other]
                give = () if not s else one[s] if s in one else two[s]
                bins[donor] = [x for x in bins[donor] if x not in take] + list(give)
                bins[other] = [x for x in bins[other] if x not in give] + list(take)
                for k, more in ((donor, -gain), (other, gain)):
                    fills[k] += more
                    sums[k] = _sums(bins[k], sizes)
                    enter(k)
                count -= not bins[donor]
                changed = True
    return [b for b in bins if b]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(spec, capacity: int, separator: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(spec.value)
        last = np.array([separator], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + last
                for piece, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((key, piece, start, n, zlib.crc32(own), own))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    return run


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents. tokenizer: path of a tokenizers file, read on the driver; keep_ids adds ids (unsigned 32-bit)."""
    with open(tokenizer, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    return map_batches(id_and_text(df, id_col, text_col), _cutter(spec, capacity, separator, keep_ids), PIECES + ", ids binary" * keep_ids)


def _packer(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending"), ("piece", "ascending")])
        base = group.column("_group")[0].as_py() << 32
        lengths = group.column("length").to_pylist()
        small = [k for k, n in enumerate(lengths) if n < capacity]
        sizes = [lengths[k] for k in small]
        bins = [[k] for k, n in enumerate(lengths) if n >= capacity]
        bins += [[small[x] for x in b] for b in local_search(best_fit(sizes, capacity), sizes, capacity)]
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for at, b in enumerate(bins):
            place = 0
            for k in sorted(b):
                sequence[k], offset[k] = base + at, place
                place += lengths[k]
        group = group.drop_columns(["_group"])
        return group.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, seed: int = 42, keep_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset."""
    cut = pieces(df, tokenizer, id_col, text_col, capacity, keep_ids=keep_ids)
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long")
    total = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-(total["bytes"] // TOKEN + total["rows"]) // (GROUP * capacity)), -(-total["rows"] // GROUP_ROWS))
    # all pieces of a document but the first are whole sequences, so any group will do for them
    grouped = cut.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "ids_crc32"), F.lit(groups)))
    return grouped.groupBy("_group").applyInArrow(_packer(capacity), PIECES + ", ids binary" * keep_ids + ", sequence_id long, offset long")


#: DuckDB SQL of what holds for every packing of ``documents``.
LAW_SQL = "SELECT count(*)::BIGINT AS documents, 0::BIGINT AS over_capacity, 0::BIGINT AS gaps, 0::BIGINT AS needless_cuts FROM documents"


def packing_law(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Documents, and pieces that run over a sequence's end, leave a gap or overlap in it, or were cut without need. Ids must be a key."""
    end = F.col("offset") + F.col("length")
    own = packed.withColumn("_before", F.coalesce(F.lag(end).over(Window.partitionBy("sequence_id").orderBy("offset")), F.lit(0)))
    own = own.withColumn("_next", F.coalesce(F.lead("start").over(Window.partitionBy("doc_id").orderBy("piece")), F.lit(-1)))
    count = lambda x, name: F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(name)
    short = (F.col("length") < capacity) & (F.col("piece") > 0) | (F.col("_next") >= 0) & (F.col("_next") != F.col("start") + F.col("length"))
    return own.agg(count(F.col("piece") == 0, "documents"), count(end > capacity, "over_capacity"), count(F.col("_before") != F.col("offset"), "gaps"), count(short, "needless_cuts"))
