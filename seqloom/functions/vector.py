"""Numpy kernels over whole Arrow batches of reads, and nothing row by row.

A batch is one array of base codes (0 to 3) with offsets. Codes of k-mers come from log2(k) shifts and ors of windows of
doubled length; sliding minima come the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BAD = 255
_CODES = np.full(256, BAD, np.uint8)
for _letters, _code in (("AaNnUu", 0), ("Cc", 1), ("Gg", 2), ("Tt", 3)):
    _CODES[np.frombuffer(_letters.encode(), np.uint8)] = _code
#: Bases that are worked on at once: it bounds a kernel's memory however long reads and batches are.
CHUNK = 1 << 21
ALL_T = {p: (1 << 2 * p) - 1 for p in range(1, 17)}


def batch_bases(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the bases of a string column and offsets of its rows; other characters are dropped, null is empty."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    codes = _CODES[raw]
    good = codes != BAD
    before = np.concatenate([[0], np.cumsum(good)])
    return codes[good], before[at - at[0]]


def squeeze_runs(bases: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One base for each run within a read."""
    keep = np.ones(len(bases), bool)
    keep[1:] = bases[1:] != bases[:-1]
    starts = offsets[:-1]
    keep[starts[starts < len(bases)]] = True
    return bases[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def window_codes(bases: np.ndarray, k: int) -> np.ndarray:
    """The code of bases[i:i + k] for each i, k up to 32, as unsigned 64 bits; reads are not told apart."""
    n = len(bases) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size = bases.astype(np.uint64), 1
    out, done = None, 0
    while True:
        if k & size:
            part = power[done : done + n]
            out = part.copy() if out is None else out << np.uint64(2 * size) | part
            done += size
        if done == k:
            return out
        power = power[: len(power) - size] << np.uint64(2 * size) | power[size:]
        size *= 2


def starts_of(offsets: np.ndarray, k: int) -> np.ndarray:
    """Positions at which a k-mer starts and ends in the same read."""
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    first = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    return first + np.arange(counts.sum())


def chunks_of(bases: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of the bases, overlapping in k - 1, with the starts of k-mers in each; starts must ascend."""
    for begin in range(0, len(bases), CHUNK):
        a, b = np.searchsorted(at, (begin, begin + CHUNK))
        if b > a:
            yield bases[begin : begin + CHUNK + k - 1], at[a:b] - begin


def kmer_codes(bases: np.ndarray, at: np.ndarray, k: int, canonical: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Codes of the k-mers that start at ``at``: low 32 bases, and for k over 32 the bases above."""
    def both(own: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        if k <= 32:
            return window_codes(own, k)[where], None
        return window_codes(own[k - 32 :], 32)[where], window_codes(own, k - 32)[where]

    low, high = both(bases, at)
    if not canonical:
        return low, high
    other = (3 - bases[::-1]).astype(np.uint8)
    low2, high2 = both(other, len(bases) - k - at)
    if high is None:
        return np.minimum(low, low2), None
    less = (high2 < high) | (high2 == high) & (low2 < low)
    return np.where(less, low2, low), np.where(less, high2, high)


def _valid(codes: np.ndarray, p: int, pmer_filter: str) -> np.ndarray:
    if pmer_filter == "canonical":
        return np.ones(len(codes), bool)
    top = codes >> np.uint64(2 * (p - 3))
    if pmer_filter == "default":
        # AAA, ACA, CAA and CCA in front, AAA behind
        return ~(np.isin(top, (0, 4, 16, 20)) | (codes & np.uint64(63) == 0))
    ok = ~np.isin(top, (0, 4))
    for k in range(p - 2):
        ok &= (codes >> np.uint64(2 * k)) & np.uint64(15) != 0
    return ok


def minimizers(bases: np.ndarray, at: np.ndarray, k: int, p: int, pmer_filter: str) -> np.ndarray:
    """The least valid p-mer of either strand in each k-mer that starts at ``at``, ascending; all T where none is valid."""
    return np.concatenate([np.zeros(0, np.uint64), *(_minimizers(b, a, k, p, pmer_filter) for b, a in chunks_of(bases, at, k))])


def _minimizers(bases: np.ndarray, at: np.ndarray, k: int, p: int, pmer_filter: str) -> np.ndarray:
    fill = np.uint64(ALL_T[p])
    forward = window_codes(bases, p)
    back = window_codes((3 - bases[::-1]).astype(np.uint8), p)[::-1]
    least = np.minimum(np.where(_valid(forward, p, pmer_filter), forward, fill), np.where(_valid(back, p, pmer_filter), back, fill))
    size, wide = 1, k - p + 1
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = wide - size
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return least[at]


def super_kmers(bases: np.ndarray, offsets: np.ndarray, k: int, p: int, pmer_filter: str) -> dict[str, np.ndarray]:
    """Maximal runs of k-mers with one minimizer: row of the read, first and past-the-last k-mer, minimizer, first base."""
    at = starts_of(offsets, k)
    own = minimizers(bases, at, k, p, pmer_filter)
    read = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - k + 1, 0))
    cut = np.flatnonzero((own[1:] != own[:-1]) | (read[1:] != read[:-1])) + 1
    first = np.concatenate([[0], cut]) if len(own) else np.zeros(0, np.int64)
    last = np.concatenate([cut, [len(own)]])[: len(first)]
    beg = at[first] - offsets[read[first]]
    return {"read": read[first], "beg": beg, "end": beg + last - first, "mm": own[first], "at": at[first]}


def pack_read(bases: np.ndarray) -> np.ndarray:
    """Three bases a byte from the left; the two high bits are their number. The last byte holds fewer, none if whole bytes end the read."""
    n = len(bases)
    rows = np.zeros((n // 3 + 1, 3), np.uint8)
    rows.reshape(-1)[:n] = bases
    counts = np.minimum(3, n - 3 * np.arange(len(rows))).astype(np.uint8)
    return counts << 6 | rows[:, 0] << 4 | rows[:, 1] << 2 | rows[:, 2]


def pack_super_kmer(packed: np.ndarray, beg: int, end: int, k: int) -> bytes:
    """Bytes of the packed read from the one of base ``beg``: the first is tagged with the bases from there on (its low ones), the
    last with those up to the end (its high ones), none if the end is at a byte's."""
    stop = end - 1 + k
    own = packed[beg // 3 : stop // 3 + 1].copy()
    own[0] = own[0] & 63 | (3 - beg % 3) << 6
    own[-1] = own[-1] & 63 | stop % 3 << 6
    return own.tobytes()


def unpack_super_kmer(data: bytes) -> np.ndarray:
    """The bases of a packed super-k-mer."""
    raw = np.frombuffer(data, np.uint8)
    rows = np.stack([raw >> 4 & 3, raw >> 2 & 3, raw & 3], axis=1)
    counts = raw >> 6
    flat = rows.ravel()
    tail = int(counts[-1])
    return flat[3 - int(counts[0]) : 3 * (len(raw) - 1) + tail].astype(np.uint8)


def pack_groups(bases: np.ndarray, starts: np.ndarray, lengths: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bases one after the other, four bases a byte; each group of runs (``heads`` are the first ones) begins at a byte. Returns the
    bytes and where groups start in them, and the end."""
    ends = np.cumsum(lengths)
    spots = np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
    sizes = np.add.reduceat(lengths, heads) if len(heads) else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(-(-sizes // 4))])
    flat = np.zeros(4 * int(at[-1]), np.uint8)
    flat[np.arange(len(spots)) + np.repeat(4 * at[:-1] - (np.cumsum(sizes) - sizes), sizes)] = bases[spots]
    rows = flat.reshape(-1, 4)
    return rows[:, 0] << 6 | rows[:, 1] << 4 | rows[:, 2] << 2 | rows[:, 3], at


def unpack_group(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bases of a group and offsets of its runs."""
    raw = np.frombuffer(data, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return np.stack([raw >> 6, raw >> 4 & 3, raw >> 2 & 3, raw & 3], axis=1).ravel()[: offsets[-1]], offsets


def tally(low: np.ndarray, high: np.ndarray | None, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes in ascending order, as high and low parts, with the sums of their counts (of one each by default)."""
    if high is None and counts is None:
        low, sums = np.unique(low, return_counts=True)
        return np.zeros(len(low), np.uint64), low, sums.astype(np.int64)
    high = np.zeros(len(low), np.uint64) if high is None else high
    order = np.lexsort((low, high))
    low, high = low[order], high[order]
    if not len(low):
        return high, low, np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
    sums = np.diff(np.concatenate([head, [len(low)]])) if counts is None else np.add.reduceat(counts[order], head)
    return high[head], low[head], sums.astype(np.int64)
