"""BPE with word ends: frequent words by a minimal acyclic transducer, all others by exact merging.

The words of all texts are counted, split just as they are for encoding; workers count in memory of bounded size and Spark adds up. The
most frequent are compiled, with their ids, into a minimal acyclic automaton: equal suffixes share states, and the number of words
that each edge passes over turns a path into the word's rank, under which its ids stand. The automaton is a few MB; it is broadcast
as bytes, and each worker maps it into memory from a file of its own that is unlinked at once. Words are looked up many at a time. A
word that it doesn't hold is merged by rank, as the library does.

Tokenizers of this kind: NFC, white space as one space, lower case; then words by a pattern that never spans white space; byte-level symbols;
merges with ``</w>`` on a word's last symbol; added tokens found in the raw text first.

Defined cases. Null text counts as empty: no ids, empty decoded text. Null ids and repeated rows stay as they are. An empty table gives
an empty result, with an empty lexicon. Ties between frequent words go to the one that sorts first in UTF-8. Texts and words of any length are
encoded whole. Extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import id_and_text, map_batches

#: At most so many words are compiled, of so many bytes at most; all others are merged.
LEXICON_WORDS, LONGEST = 40_000, 48
#: A worker hands on its counts when it has so many parts of texts, or has read so many characters since it last did.
COUNTED, READ = 400_000, 16 << 20
#: Characters of texts that are encoded at once, so that many new words are looked up and merged together; a longer text goes on its own.
TOGETHER = 1 << 20
#: Longest word, in bytes, that is merged without a heap.
SHORT = 40
#: Bytes of parts of texts and words that a worker remembers; beyond, it starts anew. Parts of more characters than LONG are coded and forgotten.
REMEMBERED, LONG = 224 << 20, 64
#: Bytes that an entry takes besides its characters.
ENTRY = 450

# The pattern and the white space of the tokenizer's file, and its end-of-word mark.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
END = "</w>"

_SPLIT = re.compile(f"[^{WHITE}]+")
_ODD = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible in Latin-1, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merger:
    """Ids of a word by exact merging."""

    def __init__(self, spec: str):
        made = json.loads(spec)
        self.vocab: dict[str, int] = made["model"]["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(made["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.strings = {v: k for k, v in self.vocab.items()} | {v: k for k, v in self.special.items()}
        self.symbols = byte_symbols()
        number: dict[str, int] = {}
        for x in [*self.symbols, *(x + END for x in self.symbols), *(x for a, b in self.ranks for x in (a, b, a + b))]:
            number.setdefault(x, len(number) + 1)  # 0 stands after a word's end
        pairs = np.array(sorted((number[a] << 32 | number[b], r) for (a, b), r in self.ranks.items()), np.int64).reshape(-1, 2)
        self.keys, self.rank_of = pairs.T.copy()
        self.joined = np.zeros(len(made["model"]["merges"]), np.int64)
        for (a, b), r in self.ranks.items():
            self.joined[r] = number[a + b]
        self.ids = np.array([-1, *(self.vocab.get(x, -1) for x in number)])

    def __call__(self, word: bytes) -> list[int]:
        parts = [self.symbols[b] for b in word]
        parts[-1] += END
        merged = self._short(parts) if len(parts) <= SHORT else self._long(parts)
        return [self.vocab[p] for p in merged if p is not None and p in self.vocab]

    def _short(self, parts: list[str]) -> list[str]:
        """Looks over all pairs for each merge: the faster way for few."""
        get, never = self.ranks.get, len(self.ranks)
        ranks = [get(x, never) for x in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < never:
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((parts[k - 1], parts[k]), never)
            if k < len(ranks):
                ranks[k] = get((parts[k], parts[k + 1]), never)
        return parts

    def many(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: short ones are merged together, each by its least pair in a round."""
        out = [[] if not w else self(w) if len(w) > SHORT else None for w in words]
        own = np.array([k for k, ids in enumerate(out) if ids is None], np.int64)
        if not len(own) or not len(self.keys):
            return [self(w) if ids is None else ids for w, ids in zip(words, out, strict=True)]
        lengths = np.array([len(words[k]) for k in own])
        columns, never = np.arange(lengths.max() + 1), len(self.joined)
        parts = np.zeros((len(own), len(columns)), np.int64)
        parts[columns < lengths[:, None]] = np.frombuffer(b"".join([words[k] for k in own]), np.uint8) + np.int64(1)
        parts[np.arange(len(own)), lengths - 1] += 256

        def ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[at] == key, self.rank_of[at], never)

        ranks = ranked(parts[:, :-1], parts[:, 1:])
        while len(own):
            at, rows = ranks.argmin(1), np.arange(len(own))
            least = ranks[rows, at]
            done = least == never
            if done.any():
                for k, ids in zip(own[done].tolist(), self.ids[parts[done]].tolist(), strict=True):
                    out[k] = [x for x in ids if x >= 0]
                own, parts, ranks, at, least = (x[~done] for x in (own, parts, ranks, at, least))
                rows = np.arange(len(own))
            source = columns + (columns > at[:, None])
            parts = np.take_along_axis(parts, np.minimum(source, len(columns) - 1), 1)
            ranks = np.take_along_axis(ranks, np.minimum(source[:, :-1], len(columns) - 2), 1)
            parts[rows, at] = self.joined[least]
            ranks[rows, at] = ranked(parts[rows, at], parts[rows, at + 1])
            rows, at = rows[at > 0], at[at > 0]
            ranks[rows, at - 1] = ranked(parts[rows, at - 1], parts[rows, at])
        return out

    def _long(self, parts: list[str | None]) -> list[str | None]:
        """Keeps pairs in a heap."""
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, a, b = heapq.heappop(queue)
            m = after[k]
            if parts[k] != a or m >= n or parts[m] != b:
                continue
            parts[k], parts[m], after[k] = a + b, None, after[m]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(queue, (r, x, parts[x], parts[y]))
        return parts


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The automaton as bytes: numbers of edges, states, words and ids, then the arrays that ``Lexicon`` maps."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []

    def settled(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(states)
            states.append((final, edges))
        return register[key]

    path: list[list] = [[False, []]]  # of the last word: a state for each prefix, its edges settled but for the last
    labels = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            path[-1][1].append((labels[len(path) - 1], settled(final, edges)))

    ordered = sorted(words)
    for word in ordered:
        shared = 0
        while shared < min(len(word), len(labels)) and word[shared] == labels[shared]:
            shared += 1
        close(shared)
        labels = word
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
    close(0)
    root = settled(*path[0])
    reach = []
    for final, edges in states:  # a state's edges lead to states settled before it
        reach.append(final + sum(reach[t] for _, t in edges))
    keys, targets, skips = [], [], []
    for state, (final, edges) in enumerate(states):
        passed = int(final)
        for label, target in edges:
            keys.append(state << 8 | label)
            targets.append(target)
            skips.append(passed)
            passed += reach[target]
    ids = [words[w] for w in ordered]
    offsets = np.cumsum([0, *map(len, ids)])
    head = np.array([len(keys), len(states), len(ordered), offsets[-1], root, 0], "<u4")
    arrays = [head, keys, targets, skips, [f for f, _ in states], offsets, [x for own in ids for x in own]]
    return b"".join(np.array(a, "<u4").tobytes() for a in arrays)


class Lexicon:
    """A compiled automaton, mapped into memory."""

    def __init__(self, data: bytes):
        handle, path = tempfile.mkstemp(prefix="lexicon")
        with os.fdopen(handle, "wb") as file:
            file.write(data)
        mapped = np.memmap(path, "<u4", "r").view(np.ndarray)
        os.unlink(path)
        edges, states, words, ids, self.root, _ = map(int, mapped[:6])
        cut = np.cumsum([6, edges, edges, edges, states, words + 1, ids])
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = (mapped[a:b] for a, b in zip(cut, cut[1:], strict=False))

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, or None where the automaton doesn't accept it."""
        out: list[list[int] | None] = [None] * len(words)
        own = [k for k, w in enumerate(words) if 0 < len(w) <= LONGEST]
        if not own or not len(self.keys):
            return out
        lengths = np.array([len(words[k]) for k in own])
        letters = np.zeros((len(own), int(lengths.max())), np.uint8)
        letters[np.arange(letters.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(words[k] for k in own), np.uint8)
        state, rank, alive = np.full(len(own), self.root, np.uint32), np.zeros(len(own), np.int64), np.arange(len(own))
        for c in range(letters.shape[1]):
            alive = alive[lengths[alive] > c]
            key = state[alive] << np.uint32(8) | letters[alive, c]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            state[alive[~ok]], lengths[alive[~ok]] = np.uint32(self.root), -1
            alive, at = alive[ok], at[ok]
            rank[alive] += self.skips[at]
            state[alive] = self.targets[at]
        for k in np.flatnonzero((lengths > 0) & (self.final[state] == 1)):
            out[own[k]] = self.ids[self.offsets[rank[k]] : self.offsets[rank[k] + 1]].tolist()
        return out


class Splitter:
    """Cuts texts at added tokens, what is between them at white space into parts, and parts into words."""

    def __init__(self, special: Iterable[str]):
        self.pattern = regex.compile(WORD_PATTERN)
        self.marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def pieces(self, text: str) -> list[str]:
        """What is between added tokens and, at odd places, these."""
        return self.marks.split(text) if self.marks and self.marks.search(text) else [text]

    def cut(self, piece: str) -> list[str]:
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
        return _SPLIT.findall(piece) if _ODD.search(piece) else piece.split()

    def split(self, part: str) -> list[str]:
        """The words of a part, or of parts with white space between them."""
        return self.pattern.findall(part.replace("Σ", "σ").lower())


class Coder(Splitter):
    """Encodes texts and decodes ids. Parts of texts between white space are remembered with their ids and decoded tokens."""

    def __init__(self, spec: str, lexicon: bytes):
        self.merge, self.lexicon = Merger(spec), Lexicon(lexicon)
        super().__init__(self.merge.special)
        self.parts: dict[str, tuple[str, str]] = {}
        self.words: dict[str, tuple[str, str]] = {}
        self.held = 0

    def _keep(self, known: dict[str, tuple[str, str]], made: dict[str, tuple[str, str]]) -> None:
        short = {x: v for x, v in made.items() if len(x) <= LONG}
        size = ENTRY * len(short) + sum([2 * (len(x) + len(v[1])) + len(v[0]) for x, v in short.items()])
        if self.held + size > REMEMBERED:
            self.held = 0
            self.parts.clear()
            self.words.clear()
        if size <= REMEMBERED:
            known.update(short)
            self.held += size

    def _coded(self, parts: Iterable[str]) -> tuple[dict[str, tuple[str, str]], dict[str, tuple[str, str]]]:
        """The parts, and the words in them that were not known."""
        found = {p: [p.lower()] if p.isascii() and p.isalpha() else self.split(p) for p in parts}
        words = {w for own in found.values() for w in own}
        fresh = list(words.difference(self.words))
        raw = [w.encode("utf-8", "surrogatepass") for w in fresh]
        strings, of = self.merge.strings, {w: self.words[w] for w in words if w in self.words}
        looked_up = self.lexicon.find(raw)
        merged = iter(self.merge.many([data for data, ids in zip(raw, looked_up, strict=True) if ids is None]))
        for word, ids in zip(fresh, looked_up, strict=True):
            ids = next(merged) if ids is None else ids
            of[word] = " ".join(map(str, ids)), " ".join([strings[x] for x in ids])
        made = {part: of[own[0]] if len(own) == 1 else (" ".join([of[w][0] for w in own]), " ".join([of[w][1] for w in own])) for part, own in found.items()}
        return made, {w: of[w] for w in fresh}

    def _together(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        known, special = self.parts, self.merge.special
        cut = [[[(str(special[x]), x)] if k % 2 else self.cut(x) for k, x in enumerate(self.pieces(text))] for text in texts]
        parts = set().union(*[piece for own in cut for piece in own[::2]])
        made, words = self._coded(parts.difference(known))
        here = made | {x: known[x] for x in parts if x not in made}
        for own in cut:
            found: list[tuple[str, str]] = []
            for k, piece in enumerate(own):
                found += piece if k % 2 else map(here.__getitem__, piece)
            yield " ".join([a for a, _ in found]), " ".join([b for _, b in found])
        self._keep(self.words, words)
        self._keep(known, made)

    def many(self, texts: Iterable[str]) -> Iterator[tuple[str, str]]:
        """Of each text: decimal ids joined by spaces, and the decoded text."""
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > TOGETHER:
                yield from self._together(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        yield from self._together(group)

    def __call__(self, text: str) -> tuple[str, str]:
        return next(iter(list(self.many([text]))))


def _counting(special: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, parts, read = Splitter(special), Counter(), 0

        def words() -> pa.RecordBatch:
            alike: dict[int, list[str]] = defaultdict(list)
            for part, n in parts.items():
                alike[n].append(part)
            counts: dict[str, int] = Counter(splitter.split(" ".join(alike.pop(1, []))))
            get = counts.get
            for n, own in alike.items():
                for word in splitter.split(" ".join(own)):
                    counts[word] = get(word, 0) + n
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            return made.filter(pc.less_equal(pc.binary_length(made.column(0)), LONGEST))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in splitter.pieces(text or "")[::2]:
                    parts.update(splitter.cut(piece))
                read += len(text or "")
                if len(parts) >= COUNTED or read >= READ:
                    yield words()
                    parts.clear()
                    read = 0
        yield words()

    return run


def frequent_words(df: DataFrame, spec: str, most: int = LEXICON_WORDS) -> dict[bytes, list[int]]:
    """The ``most`` most frequent words of all texts, of those of up to ``LONGEST`` bytes, with their ids."""
    merge = Merger(spec)
    counts = map_batches(df.select("_text"), _counting(list(merge.special)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # Under coalesce the limit is taken by executors; as the last step the driver would get as many words from each partition.
    top = counts.orderBy(F.desc("n"), "word").limit(most).coalesce(1).collect()
    raw = [r["word"].encode() for r in top]
    return dict(zip(raw, merge.many(raw), strict=True))


_coders: dict[int, Coder] = {}
SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _coding(spec, lexicon, digest: bool):
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((spec.value, lexicon.value))
        if key not in _coders:
            _coders.clear()
            _coders[key] = Coder(spec.value, lexicon.value)
        coder = _coders[key]
        for batch in batches:
            ids, decoded, counts = [], [], []
            for a, b in coder.many([text or "" for text in batch.column(1).to_pylist()]):
                counts.append(a.count(" ") + 1 if a else 0)
                ids.append(sha(a) if digest else a)
                decoded.append(sha(b) if digest else b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [x.split()[0] for x in (DIGEST if digest else SCHEMA).split(", ")])

    return run


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by spaces) and decoded; with ``digest`` the last two as SHA-256 of what was made.

    tokenizer: path of a tokenizers file, read on the driver."""
    own = id_and_text(df, id_col, text_col)
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    context = df.sparkSession.sparkContext
    lexicon = compile_lexicon(frequent_words(own, spec))
    return map_batches(own, _coding(context.broadcast(spec), context.broadcast(lexicon), digest), DIGEST if digest else SCHEMA)
