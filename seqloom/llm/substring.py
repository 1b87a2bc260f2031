"""Substring dedup over whole texts by prefix-partitioned suffix trees: windows of words that also start in a document with a smaller id.

Every window of ``WINDOW`` words is the head of a suffix. A suffix tree over all of them is cut up by prefixes into groups that fit in memory:

1. Prefixes. A window's prefix is the run of ``PREFIX`` words in it with the least hash, the first of equals. Neighbouring windows mostly share it, so they
   make one row: a span of words with up to ``ROW_WINDOWS`` suffixes in it. Equal windows have equal prefixes. Prefixes found in one document
   only lead to no repeat and are dropped.
2. Lengthening. A prefix with more than ``GROUP`` rows is lengthened to ``LONGER`` words: to the right where the run starts in the first
   ``LEFT`` words of the window, else to the left by ``LEFT`` words, so the longer run is part of the window again. Longer prefixes of one document only are dropped.
3. Subtrees. The suffixes of a group are sorted by their words (ranks of 1, 3, 6, 12, 24, 48 and 50 words, each made of two of the ones before)
   and the words that neighbours have in common are counted. Suffixes between two counts under ``WINDOW`` hang from one internal node at that depth or
   below: they are a repeat if they come from two documents. Words are compared, not hashes, which only deal rows to groups.
4. A longer prefix that still has more than ``GROUP`` rows is a passage that many documents share. Its rows are split into parts of that size, whose
   subtrees are made apart. Their nodes meet by a hash of their words in packs of bounded size; a node of several parts is then proved:
   all parts send its words, and where one hash stands for several word sequences the nodes meet again by the words themselves. So no
   task holds a hot prefix or a hot passage whole.
5. Windows below a node in documents other than its least are marked, and the words they cover go.

Defined cases. Null text counts as empty: no words. Fewer words than a window: nothing to remove. A null id: nothing is removed and the text is
no source. Rows that share an id are one document with several texts: none of them has the smaller id, so they
remove nothing from one another. Repeated rows stay repeated, with equal results. Empty table: empty result. Texts of any length are read whole. Extra
columns are not read by ``marks``; ``cut`` returns them unchanged, whatever their names and types.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from seqloom.llm.common import ARROW_ROWS, Renamed, id_and_text, map_batches, partitions_for, use_checkpoints

WINDOW, PREFIX = 50, 8
#: Words left of the run that a prefix lengthened to the left has; words of one lengthened to the right.
LEFT = 22
LONGER = WINDOW - LEFT + 1
#: Rows of one prefix that make a subtree in memory, suffixes in a row (bits of a mask), and parts of a prefix to a pack of nodes.
GROUP, ROW_WINDOWS, PARTS_EACH = 1000, 62, 16
#: Subtrees are made of so many rows or bytes of spans in one go, and the group that ends them.
TOGETHER, TOGETHER_BYTES = 4096, 16 << 20
#: Bits of the hashes that deal suffixes and nodes; results don't depend on them.
HASH_BITS = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_tables[0]) <= n:
        size = max(1 << 16, 2 * n)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            _tables[k] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, base, np.uint64))])
    return _tables


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum(values * _powers(len(values))[0][: len(values)])])


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words [^\\x20\\x09-\\x0D]+ start and end."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(raw, np.uint8)], [True]])
    turns = np.flatnonzero(space[1:] != space[:-1])
    return turns[::2], turns[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    starts, ends = word_bounds(raw)
    sums = _sums(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1))
    back = _powers(len(raw))[1]
    return _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _BASE)


def _grams(sums: np.ndarray, at: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A hash for the run of n words at each place."""
    h = _mix((sums[at + n] - sums[at]) * _powers(len(sums))[1][at] + np.uint64(n))
    return h if bits == 64 else h & np.uint64((1 << bits) - 1)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal values, cut into runs of at most ``ROW_WINDOWS``."""
    turns = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    lengths = np.diff(np.concatenate([turns, [len(values)]]))
    pieces = -(-lengths // ROW_WINDOWS)
    own = np.repeat(turns, pieces)
    first = own + ROW_WINDOWS * (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return first, np.minimum(first + ROW_WINDOWS, own + np.repeat(lengths, pieces)) - 1


class Anchors:
    """Of a text: rows of consecutive windows with one prefix, as the prefix, the first and the last window."""

    def __init__(self, raw: bytes, bits: int = HASH_BITS):
        words = word_hashes(raw)
        self.n_words, self.bits = len(words), bits
        self.prefix = np.zeros(0, np.int64)
        if len(words) < WINDOW:
            return
        self.sums = _sums(words)
        self.grams = _grams(self.sums, np.arange(len(words) - PREFIX + 1), PREFIX, bits)
        least, size, wide = self.grams, 1, WINDOW - PREFIX + 1
        while size * 2 <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        self.least = np.minimum(least[: size - wide], least[wide - size :]) if wide > size else least
        self.first, self.last = _runs(self.least)
        self.prefix = self.least[self.first].view(np.int64)

    def longer(self) -> np.ndarray:
        """The lengthened prefix of each window."""
        windows, wide = np.arange(len(self.least)), WINDOW - PREFIX + 1
        # the first place from a window on that has its least hash: of each hash's places, in order, the next one
        order = np.lexsort((np.arange(len(self.grams)), self.grams))
        rank = np.empty(len(order), np.int64)
        values, of_gram = np.unique(self.grams, return_inverse=True)
        rank = of_gram[order].astype(np.int64) * len(order) + order
        at = order[np.searchsorted(rank, np.searchsorted(values, self.least) * len(order) + windows)]
        assert ((at >= windows) & (at < windows + wide)).all()
        right = at - windows < LEFT
        out = np.empty(len(windows), np.uint64)
        out[right] = _grams(self.sums, at[right], LONGER, self.bits)
        out[~right] = _grams(self.sums, at[~right] - LEFT, LEFT + PREFIX, self.bits)
        return out.view(np.int64)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _arrow(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], _names(schema))


def _anchors(bits: int):
    """_id, _text to _prefix, _id, _n: each prefix of a text once, with its number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Anchors(_raw(text), bits)
                if len(found.prefix):
                    own, n = np.unique(found.prefix, return_counts=True)
                    prefixes.append(own)
                    counts.append(n)
                    keys.append(np.full(len(own), key))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (prefixes, keys, counts)], ["_prefix", "_id", "_n"])

    return run


#: Rows of a prefix: its part of so many, id and hash of the text, first window, and the words from its first window to the end of its last.
SPANS = "_prefix long, _part long, _parts long, _id long, _sha long, _first long, _span binary"


def _spans(bits: int):
    """_id, _sha, _text, _shared (prefixes and their parts) to rows; those of a prefix with parts by its lengthened form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, sha, text, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = _raw(text)
                found = Anchors(raw, bits)
                if not len(found.prefix):
                    continue
                words, parts, longer = raw.split(), {x["_prefix"]: x["_parts"] for x in shared}, None
                for prefix, a, b in zip(found.prefix.tolist(), found.first.tolist(), found.last.tolist(), strict=True):
                    n = parts.get(prefix)
                    if n == 1:
                        rows.append((prefix, 0, 1, key, sha, a, b" ".join(words[a : b + WINDOW])))
                    elif n:
                        longer = found.longer() if longer is None else longer
                        firsts, lasts = _runs(longer[a : b + 1])
                        for x, y in zip((firsts + a).tolist(), (lasts + a).tolist(), strict=True):
                            rows.append((int(longer[x]), hash((key, sha, x)) % n, n, key, sha, x, b" ".join(words[x : y + WINDOW])))
            yield _arrow(SPANS, rows)

    return run


class Subtree:
    """The suffixes of spans, each at least a window long, as the leaves of a suffix tree cut off at depth ``WINDOW``.

    ``row``, ``place``: of each leaf its row and its window in it; ``order`` sorts leaves by their words, ``common`` is the number of words
    that each shares with the one before in that order (0 for the first), and ``node`` numbers the internal nodes at depth ``WINDOW`` or
    below that leaves hang from. Equal spans are sorted once.
    """

    def __init__(self, spans: list[bytes]):
        known: dict[bytes, int] = {}
        at = np.array([known.setdefault(x, len(known)) for x in spans], np.int64)
        words = b" ".join(known).split(b" ") if known else []
        self.words = sorted(set(words))
        rank = {w: k for k, w in enumerate(self.words)}
        self.ids = np.fromiter(map(rank.__getitem__, words), np.int64, len(words))
        lengths = np.array([x.count(b" ") + 1 for x in known], np.int64)
        starts, windows = np.cumsum(lengths) - lengths, lengths - WINDOW + 1
        first = np.cumsum(windows) - windows
        #: of each distinct window, its first word in ``ids``
        self.heads = np.repeat(starts - first, windows) + np.arange(int(windows.sum()))
        self._sort()
        # rows with equal spans have the leaves of the one that was sorted
        n = windows[at]
        self.row = np.repeat(np.arange(len(spans)), n)
        self.place = np.arange(len(self.row)) - np.repeat(np.cumsum(n) - n, n)
        self.leaf = np.repeat(first[at], n) + self.place
        self.node = self._nodes[self.leaf]

    def _sort(self) -> None:
        """Ranks of longer and longer runs: the rank of a pair of runs stands for the runs laid end to end."""
        ranks = {1: self.ids}

        def pair(size: int, half: int, at: np.ndarray | None = None) -> np.ndarray:
            left, right = (ranks[half], ranks[half][size - half :]) if at is None else (ranks[half][at], ranks[half][at + size - half])
            left = left[: len(right)]
            return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]

        self.order = self.common = self._nodes = np.zeros(0, np.int64)
        if not len(self.heads):
            return
        for size, half in ((2, 1), (3, 2), (6, 3), (12, 6), (24, 12), (48, 24)):
            ranks[size] = pair(size, half)
        whole = pair(WINDOW, 48, self.heads)
        self.order = np.argsort(whole, kind="stable")
        a, b = self.heads[self.order[:-1]], self.heads[self.order[1:]]
        same = np.zeros(len(a), np.int64)
        for size in (48, 24, 12, 6, 3, 1, 1):
            fits = np.flatnonzero(same + size <= WINDOW)
            same[fits] += size * (ranks[size][a[fits] + same[fits]] == ranks[size][b[fits] + same[fits]])
        self.common = np.concatenate([[0], same])
        self._nodes = np.empty(len(self.heads), np.int64)
        self._nodes[self.order] = np.cumsum(self.common < WINDOW) - 1

    def ends(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest id below each node. ids: of the rows."""
        n = int(self._nodes.max(initial=-1)) + 1
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(least, self.node, ids[self.row])
        np.maximum.at(most, self.node, ids[self.row])
        return least, most

    def masks(self, marked: np.ndarray, rows: int) -> np.ndarray:
        """Of each row a mask of its marked leaves."""
        out = np.zeros(rows, np.int64)
        np.bitwise_or.at(out, self.row[marked], np.int64(1) << self.place[marked])
        return out

    def one_of_each(self) -> np.ndarray:
        """The first word of one window below each node."""
        out = np.empty(int(self._nodes.max(initial=-1)) + 1, np.int64)
        out[self._nodes] = self.heads
        return out

    def labels(self, heads: np.ndarray, bits: int) -> np.ndarray:
        """A hash of the words of windows."""
        own, powers = word_hashes(b" ".join(self.words)), _powers(WINDOW)[0][:WINDOW]
        out = np.zeros(len(heads), np.uint64)
        for k in range(0, len(heads), 4096):
            runs = own[self.ids[heads[k : k + 4096, None] + np.arange(WINDOW)]]
            out[k : k + 4096] = _mix((runs * powers).sum(axis=1, dtype=np.uint64))
        return out if bits == 64 else out & np.uint64((1 << bits) - 1)

    def window(self, head: int) -> bytes:
        return b" ".join([self.words[k] for k in self.ids[head : head + WINDOW]])


def marked_by_tree(ids: np.ndarray, spans: list[bytes]) -> np.ndarray:
    """For each row a mask of its suffixes below a node that also has a smaller id."""
    tree = Subtree(spans)
    least, _ = tree.ends(ids)
    return tree.masks(np.flatnonzero(ids[tree.row] > least[tree.node]), len(ids))


#: kind 0: marks of a row; 1: a row of a prefix with several parts; 2: a pack of a part's nodes; 3: a node of several parts, with its words.
FOUND = "_kind int, _prefix long, _part long, _parts long, _id long, _sha long, _first long, _mask long, _data binary"
#: A node: the hash of its words, least and greatest id; as packs come back, in place of the latter the number of nodes of that hash.
_NODE = np.dtype([("label", "<u8"), ("least", "<i8"), ("most", "<i8")])


def _batch(n: int, **columns: object) -> pa.RecordBatch:
    cols = []
    for name, kind in (x.split() for x in FOUND.split(", ")):
        kind = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]
        value = columns.get(name)
        cols.append(pa.nulls(n, kind) if value is None else pa.array(np.full(n, value) if isinstance(value, int) else value, kind))
    return pa.RecordBatch.from_arrays(cols, _names(FOUND))


def _settled(rows: pa.Table, nodes: bool, bits: int) -> Iterator[pa.RecordBatch]:
    """Whole groups of (prefix, part): marks of those that are a prefix's only part; rows of the others, and with ``nodes`` packs of their nodes."""
    prefix, part, parts, ids, sha, first = (rows.column(k).to_numpy() for k in range(6))
    spans = rows.column(6).to_pylist()
    own = np.flatnonzero(parts == 1)
    if len(own):
        masks = marked_by_tree(ids[own], [spans[k] for k in own])
        own, masks = own[masks != 0], masks[masks != 0]
        yield _batch(len(own), _kind=0, _id=ids[own], _sha=sha[own], _first=first[own], _mask=masks)
    rest = np.flatnonzero(parts > 1)
    if not len(rest):
        return
    yield _batch(len(rest), _kind=1, _prefix=prefix[rest], _part=part[rest], _parts=parts[rest], _id=ids[rest], _sha=sha[rest], _first=first[rest], _data=[spans[k] for k in rest])
    if not nodes:
        return
    turns = np.flatnonzero((prefix[rest[1:]] != prefix[rest[:-1]]) | (part[rest[1:]] != part[rest[:-1]])) + 1
    for own in np.split(rest, turns):
        tree = Subtree([spans[k] for k in own])
        made = np.zeros(len(heads := tree.one_of_each()), _NODE)
        made["label"] = tree.labels(heads, bits)
        made["least"], made["most"] = tree.ends(ids[own])
        packs = -(-int(parts[own[0]]) // PARTS_EACH)
        pack = (made["label"] % np.uint64(packs)).astype(np.int64)
        used = np.unique(pack)
        # the pack's number stands in _first
        yield _batch(len(used), _kind=2, _prefix=int(prefix[own[0]]), _part=int(part[own[0]]), _first=used, _data=[made[pack == k].tobytes() for k in used])


def _subtrees(nodes: bool, bits: int):
    """Rows sorted by prefix and part; groups are held until they are whole and there are enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        held = size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            inner = np.flatnonzero((prefix != prefix[-1]) | (part != part[-1]))
            at = int(inner[-1]) + 1 if len(inner) else 0
            turned = at or kept and (kept[-1].column(0)[-1].as_py(), kept[-1].column(1)[-1].as_py()) != (prefix[0], part[0])
            if turned and (held + at >= TOGETHER or size + batch.nbytes >= TOGETHER_BYTES):
                yield from _settled(pa.Table.from_batches([*kept, batch.slice(0, at)]), nodes, bits)
                kept, held, size, batch = [], 0, 0, batch.slice(at)
            kept.append(batch)
            held += batch.num_rows
            size += batch.nbytes
        if kept:
            yield from _settled(pa.Table.from_batches(kept), nodes, bits)

    return run


def _merge(group: pa.Table) -> pa.Table:
    """Packs of one prefix and range of hashes, from all its parts: to each part, of its nodes those whose hash two documents have."""
    packs = [np.frombuffer(x, _NODE) for x in group.column("_data").to_pylist()]
    every = np.concatenate(packs)
    labels, at, counts = np.unique(every["label"], return_inverse=True, return_counts=True)
    least, most = np.full(len(labels), np.iinfo(np.int64).max), np.full(len(labels), np.iinfo(np.int64).min)
    np.minimum.at(least, at, every["least"])
    np.maximum.at(most, at, every["most"])
    out = []
    for own in packs:
        k = np.unique(np.searchsorted(labels, own["label"]))
        k = k[least[k] < most[k]]
        made = np.zeros(len(k), _NODE)
        made["label"], made["least"], made["most"] = labels[k], least[k], counts[k]
        out.append(made.tobytes())
    none = pa.nulls(len(out), pa.int64())
    return pa.table({"_prefix": group.column("_prefix"), "_part": group.column("_part"), "_least": none, "_data": pa.array(out, pa.binary())})


#: What comes back to a part: a pack of nodes (_least null) or, where a hash stands for several word sequences, the words of a node and their least id.
BACK = "_prefix long, _part long, _least long, _data binary"


def _part_marks(bits: int, prove: bool):
    """Rows of a part and what came back: the marks, and with ``prove`` the words of nodes whose hash other nodes have too."""

    def run(rows: pa.Table, back: pa.Table) -> pa.Table:
        ids = rows.column("_id").to_numpy()
        if not len(ids):
            return pa.Table.from_batches([_batch(0)])
        tree = Subtree(rows.column("_data").to_pylist())
        least, most = tree.ends(ids)
        heads = tree.one_of_each()
        labels = tree.labels(heads, bits)
        is_pack = back.column("_least").is_null().to_numpy()
        data, values = back.column("_data").to_pylist(), back.column("_least").to_pylist()
        packs = np.concatenate([np.zeros(0, _NODE), *(np.frombuffer(x, _NODE) for x, p in zip(data, is_pack, strict=True) if p)])
        packs = packs[np.argsort(packs["label"])]
        exact = {x: v for x, v, p in zip(data, values, is_pack, strict=True) if not p}
        whole, several = least.copy(), np.zeros(len(heads), bool)
        if len(packs):
            at = np.minimum(np.searchsorted(packs["label"], labels), len(packs) - 1)
            met = packs["label"][at] == labels
            whole[met] = np.minimum(whole[met], packs["least"][at[met]])
            several = met & (packs["most"][at] > 1)
        proofs = [(k, tree.window(int(heads[k]))) for k in np.flatnonzero(several)] if prove or exact else []
        for k, words in proofs:
            whole[k] = exact.get(words, whole[k])
        masks = tree.masks(np.flatnonzero(ids[tree.row] > whole[tree.node]), len(ids))
        own = np.flatnonzero(masks)
        out = [_batch(len(own), _kind=0, _id=ids[own], _sha=rows.column("_sha").to_numpy()[own], _first=rows.column("_first").to_numpy()[own], _mask=masks[own])]
        if prove and proofs:
            k = np.array([k for k, _ in proofs])
            place = rows.column("_prefix")[0].as_py(), rows.column("_part")[0].as_py()
            # the hash stands in _parts, the least id of the part in _id
            out.append(_batch(len(k), _kind=3, _prefix=place[0], _part=place[1], _parts=labels[k].view(np.int64), _id=least[k], _data=[w for _, w in proofs]))
        return pa.Table.from_batches(out)

    return run


def _of_parts(rows: DataFrame, packs: DataFrame, bits: int) -> DataFrame:
    """Marks of the rows of prefixes with several parts, from all nodes of all parts."""
    merged = packs.groupBy("_prefix", "_first").applyInArrow(_merge, BACK).checkpoint()
    by_part = rows.groupBy("_prefix", "_part")
    found = by_part.cogroup(merged.groupBy("_prefix", "_part")).applyInArrow(_part_marks(bits, True), FOUND).checkpoint()
    proofs = found.where("_kind = 3").select("_prefix", F.col("_parts").alias("_label"), "_part", F.col("_id").alias("_own"), F.col("_data").alias("_words"))
    mixed = proofs.groupBy("_prefix", "_label").agg(F.min("_words").alias("_a"), F.max("_words").alias("_b")).where("_a <> _b").select("_prefix", "_label").checkpoint()
    if mixed.isEmpty():
        return found.where("_kind = 0")
    open_ = proofs.join(mixed, ["_prefix", "_label"])
    least = open_.groupBy("_prefix", "_words").agg(F.min("_own").alias("_least"))
    exact = open_.join(least, ["_prefix", "_words"]).select("_prefix", "_part", "_least", F.col("_words").alias("_data"))
    both = merged.unionByName(exact)
    return by_part.cogroup(both.groupBy("_prefix", "_part")).applyInArrow(_part_marks(bits, False), FOUND).where("_kind = 0")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions_for(rows.sparkSession), "_prefix", "_part").sortWithinPartitions("_prefix", "_part")


def marks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = HASH_BITS) -> DataFrame:
    """_id, _sha (a hash of the text) and _windows: structs of the first window and a mask of marked windows from there on."""
    spark = df.sparkSession
    use_checkpoints(spark)
    parts = lambda n: F.ceil(n / GROUP).cast("long").alias("_parts")
    docs = id_and_text(df, id_col, text_col).where("_id IS NOT NULL")
    anchors = map_batches(docs, _anchors(bits), "_prefix long, _id long, _n long").checkpoint()
    counts = anchors.groupBy("_prefix").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b"), F.sum("_n").alias("_rows")).where("_a <> _b")
    shared = counts.select("_prefix", parts(F.col("_rows"))).checkpoint()
    own = anchors.select("_prefix", "_id").join(shared, "_prefix").groupBy("_id").agg(F.collect_set(F.struct("_prefix", "_parts")).alias("_shared"))
    texts = docs.join(own, "_id").select("_id", F.xxhash64("_text").alias("_sha"), "_text", "_shared")
    # rows of prefixes to be lengthened come out as they went in: their parts spread them before they are counted
    found = map_batches(_dealt(map_batches(texts, _spans(bits), SPANS)), _subtrees(False, bits), FOUND, TOGETHER).checkpoint()
    marked = found.where("_kind = 0")
    long = found.where("_kind = 1").select("_prefix", "_part", "_id", "_sha", "_first", F.col("_data").alias("_span"))
    if not long.isEmpty():
        # a group of (prefix, part) has about GROUP rows, so neither the sums nor the join meet a hot key
        some = long.groupBy("_prefix", "_part").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b"), F.count(F.lit(1)).alias("_n"))
        every = some.groupBy("_prefix").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.sum("_n").alias("_n")).where("_a <> _b")
        sizes = some.select("_prefix", "_part").join(every.select("_prefix", parts(F.col("_n"))), "_prefix")
        rows = long.join(sizes, ["_prefix", "_part"])
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("_id", "_sha", "_first"), "_parts")).select(*_names(SPANS))
        deep = map_batches(_dealt(rows), _subtrees(True, bits), FOUND, TOGETHER).checkpoint()
        marked = marked.unionByName(deep.where("_kind = 0"))
        packs = deep.where("_kind = 2").select("_prefix", "_part", "_first", "_data")
        if not packs.isEmpty():
            marked = marked.unionByName(_of_parts(deep.where("_kind = 1").select("_prefix", "_part", "_id", "_sha", "_first", "_data"), packs, bits))
    return marked.groupBy("_id", "_sha").agg(F.collect_set(F.struct("_first", "_mask")).alias("_windows"))


def removed(n_words: int, windows: list) -> np.ndarray:
    """Which words marked windows cover. windows: pairs of a first window and a mask."""
    gone = np.zeros(n_words + 1, np.int64)
    for first, mask in windows:
        at = first
        while mask:
            low = (mask & -mask).bit_length() - 1
            gone[at + low] += 1
            gone[min(n_words, at + low + WINDOW)] -= 1
            mask &= mask - 1
    return np.cumsum(gone)[:n_words] > 0


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, sha, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            marked = [(w["_first"], w["_mask"]) for w in windows]
            gone = removed(max(a + m.bit_length() for a, m in marked) + WINDOW - 1, marked)
            turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            rows += [(key, sha, a, b - a) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
        yield _arrow("_id long, _sha long, start long, words long", rows)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _sha (a hash of the text), start and words: each longest run of words of a document that repeats cover, by numbers of words."""
    return map_batches(marks(df, id_col, text_col), _span_rows, "_id long, _sha long, start long, words long")


def _kept(text: str | None, windows: list | None) -> tuple[int, int, bytes]:
    """Number of words, of removed ones, and the kept ones joined by a space."""
    words = _raw(text).split()
    if not windows:
        return len(words), 0, b" ".join(words)
    gone = removed(len(words), [(w["_first"], w["_mask"]) for w in windows])
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, *_kept(text, windows)) for key, text, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        sha = pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())
        yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), sha], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup_digest(df: DataFrame, bits: int = HASH_BITS) -> DataFrame:
    docs = id_and_text(df, "doc_id", "text")
    found = marks(df, bits=bits).withColumnRenamed("_id", "_key").withColumnRenamed("_sha", "_hash")
    joined = docs.join(found, (F.col("_id") == F.col("_key")) & (F.xxhash64("_text") == F.col("_hash")), "left").select("_id", "_text", "_windows")
    return map_batches(joined, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _kept_texts(texts: pa.Array, windows: pa.Array) -> pa.Array:
    """The kept words of texts joined by a space; texts without marks as they are."""
    out = [pa.array([], pa.string())]
    for k in range(0, len(texts), ARROW_ROWS):
        own = texts.slice(k, ARROW_ROWS).to_pylist()
        for i, marked in enumerate(windows.slice(k, ARROW_ROWS).to_pylist()):
            if marked:
                own[i] = _kept(own[i], marked)[2].decode("utf-8", "surrogatepass")
        out.append(pa.array(own, pa.string()))
    return pa.concat_arrays(out)


def cut(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with repeats cut from its texts: kept words joined by a space; texts without repeats unchanged. Empty texts go,
    among them those that were nothing but repeats; other rows and columns stay as they are."""
    own, found = Renamed(df), marks(df, id_col, text_col)
    key, text = own.at(id_col).cast("long"), own.at(text_col).cast("string")
    joined = own.frame.join(found, (key == F.col("_id")) & (F.xxhash64(text) == F.col("_sha")), "left")
    # not deterministic to the planner, so that it isn't run again for the filter
    kept = F.arrow_udf(_kept_texts, StringType()).asNondeterministic()
    out = own.back(joined, {text_col: kept(text, F.col("_windows"))})
    return out.where(F.col(f"`{text_col}`").isNull() | (F.length(F.col(f"`{text_col}`")) > 0))
