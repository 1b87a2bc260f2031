import hashlib
import random

from seqloom.llm import lzprint


def plain_phrases(text):
    known, out, have = set(), set(), ""
    for c in text:
        have += c
        if have not in known:
            known.add(have)
            out.add(have)
            have = ""
    return out | ({have} if have else set())


def plain_likeness(a, b):
    hashed = lambda s: {int(lzprint.slice_hashes(p, [0, len(p)])[0]) >> 32 for p in plain_phrases(s)}
    x, y = hashed(a), hashed(b)
    if not x or not y:
        return float(len(x) == len(y))
    x, y = set(sorted(x)[: lzprint.KEPT]), set(sorted(y)[: lzprint.KEPT])
    least = sorted(x | y)[: lzprint.KEPT]
    return sum(v in x and v in y for v in least) / len(least)


def test_parse_finds_the_phrases_of_lz78():
    rng = random.Random(3)
    for n in (0, 1, 5, 300, 5000):
        text = "".join(rng.choice("abé ") for _ in range(n))
        bounds = [0]
        lzprint.parse(text, 0, set(), bounds)
        assert {text[a:b] for a, b in zip(bounds, bounds[1:])} == plain_phrases(text)


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["the ", "of ", "añ", "x\n"]) for _ in range(rng.choice([0, 1, 3, 40, 400]))) for _ in range(60)]
    rows = [(3 * i, t, "clash") for i, t in enumerate(texts)] + [(None, "none", "x"), (9, None, "x"), (500, "last " * 3000, "x"), (500, "last " * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = sorted((tuple(r) for r in lzprint.edited(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted([(r[0], r[1]) for r in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(want)
    out = []
    for k, (key, text) in enumerate(want):
        text, other = text or "", want[(k + 1) % len(want)][1] or ""
        q = len(text) // 4
        edit = text[: len(text) - q] + other[:q]
        out.append((key, len(text), hashlib.sha256(edit.encode()).hexdigest(), lzprint.fingerprint(text), lzprint.fingerprint(edit), plain_likeness(text, edit), plain_likeness(text, other)))
    assert got == sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_empty_and_single(spark):
    df = spark.createDataFrame([(7, "a b c a b c a b c")], "doc_id long, text string")
    assert lzprint.edited(df.limit(0)).count() == 0
    row = lzprint.edited(df).first()
    assert row.near_next == 1.0 and lzprint.fingerprint(None) == ""
