import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from seqloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def valid(bins, sizes, capacity):
    return sorted(x for b in bins for x in b) == list(range(len(sizes))) and all(sum(sizes[x] for x in b) <= capacity for b in bins)


def test_best_fit_and_search_keep_every_item():
    rng = random.Random(1)
    for n in (0, 1, 2, 50, 700):
        sizes = [rng.randint(1, 99) for _ in range(n)]
        start = packing.best_fit(sizes, 100)
        found = packing.local_search(start, sizes, 100)
        assert valid(start, sizes, 100) and valid(found, sizes, 100)
        assert -(-sum(sizes) // 100) <= len(found) <= len(start)


def test_search_empties_bins_that_best_fit_leaves():
    # three bins of 40 + 30 + 30, put down as best fit never would have to
    sizes = [40, 40, 40, 30, 30, 30, 30, 30, 30]
    bins = [[0, 1], [2, 3], [4, 5], [6, 7], [8]]
    assert len(packing.local_search(bins, sizes, 100)) < len(bins)
    sizes = [60, 50, 50, 40, 50, 50]
    assert len(packing.local_search([[0], [1, 3], [2, 4], [5]], sizes, 100)) == 3


def test_search_raises_squares_and_matches_the_optimum_often():
    rng, reached = random.Random(2), 0
    for _ in range(30):
        sizes = []
        for _ in range(12):  # bins that can be filled whole
            a, b = sorted(rng.sample(range(1, 100), 2))
            sizes += [a, b - a, 100 - b]
        rng.shuffle(sizes)
        bins = [[k] for k in range(len(sizes))]
        found = packing.local_search(bins, sizes, 100)
        assert valid(found, sizes, 100) and len(found) < len(bins)
        reached += len(packing.local_search(packing.best_fit(sizes, 100), sizes, 100)) <= 13
    assert reached >= 28


def test_encoder_equals_the_library():
    tok, enc = Tokenizer.from_file(PATH), packing.Encoder(open(PATH, encoding="utf-8").read())
    rng = random.Random(4)
    texts = ["", " ", "a  b \n c", "  lead", "x\x1cy \x1c z", "tail ", "\n\n a", "it's  we'll 's", "<|endoftext|> a b", "\xa0 a\xa0b  c", "ab　 c d'd 12 3"]
    texts += ["".join(rng.choice("ab é'\n\t 1. 🙂") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(enc(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_pack_against_brute_force(spark):
    tok, rng = Tokenizer.from_file(PATH), random.Random(6)
    texts = [None, "", "word " * 9000] + [" ".join(rng.choice(["the", "longer", "x9"]) for _ in range(rng.randint(1, 900))) for _ in range(80)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "a b", 1), (5, texts[5], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(3)
    got = packing.pack(df, PATH).collect()
    assert packing.pack(df.limit(0), PATH).count() == 0
    whole = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for k, t, _ in rows}
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(whole)
    for key, own in by.items():
        copies = 2 if key == 5 else 1
        assert sum(r.length for r in own) == copies * len(whole[key])
        assert all(r.length == 2048 for r in own if r.piece) and len({r.piece for r in own}) == -(-len(whole[key]) // 2048)
    for placed in sequences.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(sequences) <= 1 + -(-sum(len(v) for v in whole.values()) // 2048) + 1


def raises_squares(a, b, sizes, capacity):
    """Whether a move, or an exchange of one for one, two for one or one for two, of two bins raises the sum of squared fills."""
    fill_a, fill_b = sum(sizes[x] for x in a), sum(sizes[x] for x in b)
    for k, give in ((1, 0), (1, 1), (2, 1), (1, 2)):
        for take in combinations(a, k):
            for back in combinations(b, give):
                gain = sum(sizes[x] for x in take) - sum(sizes[x] for x in back)
                if 0 < gain <= capacity - fill_b and fill_b + gain > fill_a:
                    return True
    return False


def test_search_ends_at_the_least_number_or_where_no_pair_of_bins_can_raise_squares():
    rng = random.Random(8)
    for low, high, n in ((400, 1000, 500), (300, 700, 400), (90, 700, 60), (1, 2048, 90)):
        sizes = [rng.randint(low, high) for _ in range(n)]
        found = packing.local_search(packing.best_fit(sizes), sizes)
        assert valid(found, sizes, 2048)
        if len(found) > -(-sum(sizes) // 2048):
            assert not any(raises_squares(a, b, sizes, 2048) for a in found for b in found if a is not b)


def test_search_empties_more_bins_than_a_few_donors_hold():
    rng, sizes = random.Random(5), []
    for _ in range(1365):  # triples that fill a bin
        a = rng.randint(500, 860)
        b = rng.randint(500, 1648 - a)
        sizes += [a, b, 2048 - a - b]
    start = packing.best_fit(sizes)
    found = packing.local_search(start, sizes)
    assert valid(found, sizes, 2048) and len(start) - len(found) > 48


def unspaced(rng, n):
    return "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))


def test_memory_is_bounded_in_bytes(monkeypatch):
    tok, enc, rng = Tokenizer.from_file(PATH), packing.Encoder(open(PATH, encoding="utf-8").read()), random.Random(7)
    for text in [unspaced(rng, 9000) for _ in range(30)] + [" " * 300_000, "a" * 70_000, "\t\n " * 20_000, "x " + "y" * 65 + " y"]:
        assert enc(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert enc.held < 1000
    monkeypatch.setattr(packing, "REMEMBERED", 20_000)
    for _ in range(40):
        text = " ".join(str(rng.random()) for _ in range(30)) + " " + unspaced(rng, 80)
        assert enc(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert enc.held <= 20_000 and sum(len(x) for x in enc.known.values()) * packing.ENTRY <= enc.held


def test_groups_follow_tokens_and_the_law_holds(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["the", "word", "ok"]) for _ in range(rng.choice([0, 5, 300, 5000])))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group, limit, many in ((1000, 100_000, False), (20, 100_000, True), (1000, 30, True)):
        monkeypatch.setattr(packing, "GROUP", group)
        monkeypatch.setattr(packing, "GROUP_ROWS", limit)
        packed = packing.pack(df, PATH).cache()
        assert (packed.selectExpr("count(DISTINCT sequence_id div 4294967296) AS n").first().n > 1) == many
        assert tuple(packing.packing_law(packed).first()) == (300, 0, 0, 0)
        broken = packed.selectExpr("doc_id", "piece", "start", "length", "sequence_id", "offset + (doc_id = 5)::long AS offset")
        assert packing.packing_law(broken).first().gaps >= 1
