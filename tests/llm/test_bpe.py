import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from seqloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH, encoding="utf-8").read()


def test_automaton_is_minimal_and_exact():
    words = {w.encode(): [k, k + 1][: 1 + k % 2] for k, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "é", "a"])}
    lex = bpe.Lexicon(bpe.compile_lexicon(words))
    assert lex.find(list(words)) == list(words.values())
    assert lex.find([b"", b"ta", b"tapsx", b"zz", b"x" * 99]) == [None] * 5
    assert len(lex.final) == 8  # 22 without shared suffixes
    assert bpe.Lexicon(bpe.compile_lexicon({})).find([b"a"]) == [None]


def texts(rng):
    out = ["", " ", "ΟΔΥΣΣΕΥΣ ΑΣ", "İstanbul Ǆ", "x\x1cy \x1c z", "it's we'll <|endoftext|>The<|startoftext|> end", "élève", "１２ 34½ ١", "🙂🙂👩‍👩‍👧 ok", "a" * 5000, "   b\u0085c", "##$$ %%-- don't"]
    return out + ["".join(rng.choice("abéñ .,'0ÀΣ\n 🙂s") for _ in range(rng.randint(1, 60))) for _ in range(400)]


def test_equals_the_library():
    tok, rng = Tokenizer.from_file(PATH), random.Random(8)
    coder = bpe.Coder(SPEC, bpe.compile_lexicon({w: bpe.Merger(SPEC)(w) for w in (b"the", b"ok", b"ab")}))
    for t in texts(rng):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert coder(t) == (" ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)), repr(t)


def test_long_and_short_words_are_merged_alike():
    rng, merge = random.Random(3), bpe.Merger(SPEC)
    for n in (1, 2, 3, 7, 20, 200):
        for _ in range(40):
            symbols = [merge.symbols[b] for b in bytes(rng.choice(b"aaabcdeth\xc3\xa9") for _ in range(n))]
            symbols[-1] += bpe.END
            assert merge._short(list(symbols)) == [p for p in merge._long(list(symbols)) if p is not None]


def test_memory_is_bounded_in_bytes(monkeypatch):
    tok, rng = Tokenizer.from_file(PATH), random.Random(4)
    coder = bpe.Coder(SPEC, bpe.compile_lexicon({}))

    def same(t):
        ids = tok.encode(t, add_special_tokens=False).ids
        return coder(t) == (" ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False))

    assert all(same("".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(5000))) for _ in range(10))
    assert coder.held < 1000
    monkeypatch.setattr(bpe, "REMEMBERED", 30_000)
    for _ in range(30):
        assert same("often seen words " + " ".join("".join(rng.choice("abcde.") for _ in range(9)) for _ in range(20)) + " " + "z" * 70)
        assert coder.held <= 30_000 and (len(coder.parts) + len(coder.words)) * bpe.ENTRY <= coder.held


def test_operator_against_the_library(spark, monkeypatch):
    tok, rng = Tokenizer.from_file(PATH), random.Random(9)
    rows = [(k, t, 0) for k, t in enumerate(texts(rng))] + [(None, "null id", 0), (1, None, 0), (2, "twice", 0), (2, "twice", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, bpe.encode(df, PATH, digest=True).collect()), key=key) == sorted(want, key=key)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def word_counts(rows):
    """By the tokenizers library's own splitting."""
    tok, counts, byte = Tokenizer.from_file(PATH), Counter(), {c: b for b, c in enumerate(bpe.byte_symbols())}
    for t in rows:
        for piece in (t or "").replace("<|startoftext|>", "<|endoftext|>").split("<|endoftext|>"):
            for word, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(piece)):
                raw = bytes(byte[c] for c in word)
                counts[raw] += len(raw) <= bpe.LONGEST
    return +counts


def test_words_of_all_texts_are_counted(spark):
    rng = random.Random(12)
    rows = [f"w{rng.choice('abcdefgh')}{rng.choice('xyzé')} Common, k{chr(97 + k % 26)}q's{chr(98 + k % 25)}" for k in range(6000)]
    rows[::1000] = ["seldom " * 400 + "z" * 60 + " z" * 7 + chr(0xE9) * 30] * 6  # of few texts, but often
    rows += [*texts(rng), None]
    df = spark.createDataFrame(list(enumerate(rows)), "_id long, _text string")
    want = word_counts(rows)
    for most in (1, 40, 100_000):
        got = bpe.frequent_words(df, SPEC, most=most)
        assert list(got) == sorted(want, key=lambda w: (-want[w], w))[:most]
    merge = bpe.Merger(SPEC)
    assert got == {w: merge(w) for w in want}


def test_counts_in_pieces_add_up(monkeypatch):
    rows = texts(random.Random(13)) * 3
    batches = [pa.record_batch([pa.array(rows[k : k + 50])], ["_text"]) for k in range(0, len(rows), 50)]
    for parts, read in ((1, 1 << 30), (37, 1 << 30), (1 << 30, 90), (1 << 30, 1 << 30)):
        monkeypatch.setattr(bpe, "COUNTED", parts)
        monkeypatch.setattr(bpe, "READ", read)
        counts = Counter()
        for batch in bpe._counting(list(bpe.Merger(SPEC).special))(iter(batches)):
            for word, n in zip(*batch.to_pydict().values(), strict=True):
                counts[word.encode()] += n
        assert counts == word_counts(rows)


def test_words_merged_together_and_alone_are_alike():
    rng = random.Random(14)
    pairs = [[a, b + end] for a in ("a", "b", "c", "ab", "ca", "abc", "bb") for b in ("a", "b", "c", "ca", "bb") for end in ("", bpe.END)]
    rng.shuffle(pairs)  # pairs of joined parts may come before those that join them
    own = {"model": {"vocab": {x: k for k, x in enumerate(sorted({"".join(p) for p in pairs} | set("abc")))}, "merges": [*pairs, pairs[3]]}, "added_tokens": []}
    for spec, letters in ((SPEC, b"aaabcdeth\xc3\xa9s"), (json.dumps(own), b"abcabcd")):
        merge = bpe.Merger(spec)
        words = [bytes(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 5, 9, 20, bpe.SHORT, bpe.SHORT + 1, 90)))) for _ in range(600)]
        assert merge.many(words) == [merge(w) for w in words]
        assert merge.many([]) == [] and merge.many(words[:1]) == [merge(words[0])]
    none = bpe.Merger(json.dumps({"model": {"vocab": {"a": 0, "a</w>": 1}, "merges": []}, "added_tokens": []}))
    assert none.many([b"aa", b"ba"]) == [[0, 1], [1]]


def test_texts_together_and_alone_are_alike(monkeypatch):
    rng = random.Random(15)
    rows = texts(rng) + ["", "x" * 300, ""]
    coder = bpe.Coder(SPEC, bpe.compile_lexicon({}))
    want = [coder(t) for t in rows]
    for together in (1, 100, 1 << 20):
        monkeypatch.setattr(bpe, "TOGETHER", together)
        assert list(bpe.Coder(SPEC, bpe.compile_lexicon({})).many(rows)) == want
    assert list(bpe.Coder(SPEC, bpe.compile_lexicon({})).many([])) == []
