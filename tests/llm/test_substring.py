import hashlib
import random
import re
from collections import defaultdict

import pytest

from seqloom.llm import substring


def brute(rows):
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    least = defaultdict(lambda: float("inf"))
    for k, w in words:
        for i in range(len(w) - 49 if k is not None else 0):
            least[tuple(w[i : i + 50])] = min(least[tuple(w[i : i + 50])], k)
    out = []
    for k, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 49 if k is not None else 0):
            if least[tuple(w[i : i + 50])] < k:
                gone[i : i + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((k, len(w), sum(gone), " ".join(kept)))
    return sorted(out, key=str)


def rows_with_repeats():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 400)] + [["ha"] * 120]
    rows = []
    for k in range(120):
        text = [word() for _ in range(rng.choice([0, 3, 60, 300]))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            text += p + [word() for _ in range(rng.randint(0, 9))]
        if rng.random() < 0.2 and len(text) > 60:
            text[rng.randrange(len(text))] = "CHANGED"
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(text)))
    rows += [(200 + k, rows[7][1]) for k in range(5)] + [(300, None), (301, ""), (None, rows[9][1]), (5, rows[80][1]), (6, rows[6][1]), (302, "\xa0".join(["w"] * 70)), (303, "z " * 30_000)]
    return rows


@pytest.mark.parametrize(("group", "bits"), [(1000, 64), (40, 64), (3, 64), (3, 6), (1000, 0), (40, 0)])
def test_against_brute_force(spark, monkeypatch, group, bits):
    """Groups of a few rows make long prefixes and parts; hashes of few bits, or of none, must not change results."""
    monkeypatch.setattr(substring, "GROUP", group)
    rows = rows_with_repeats()
    if bits < 64:  # every window then meets all others
        rows = rows[:40] + rows[120:-1]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, _windows string").repartition(6)
    got = sorted(map(tuple, substring.dedup_digest(df, bits).collect()), key=str)
    want = sorted(((k, n, g, hashlib.sha256(t.encode()).hexdigest()) for k, n, g, t in brute(rows)), key=str)
    assert got == want and sum(r[2] for r in got) > 1000


def test_cut_keeps_columns_and_clean_texts(spark):
    rows = rows_with_repeats()
    df = spark.createDataFrame([(*r, "x", "y", {"k": k}) for k, r in enumerate(rows)], "doc_id long, text string, _mark_id string, _windows string, _id map<string,int>")
    out = substring.cut(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = []
    for (k, t), (_, _, gone, kept) in zip(sorted(rows, key=str), sorted_like(rows), strict=True):
        text = t if not gone else kept
        if text is None or text:
            want.append((k, text))
    assert got == sorted(want, key=str)
    assert substring.dedup_digest(df.limit(0)).count() == 0


def test_spans_are_the_runs_that_go(spark):
    rows = [r for r in rows_with_repeats() if r[0] is not None and r[0] not in (5, 6)]
    got = defaultdict(set)
    for r in substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r._id] |= set(range(r.start, r.start + r.words))
    assert {k: len(v) for k, v in got.items()} == {k: gone for k, _, gone, _ in brute(rows) if gone}


def sorted_like(rows):
    found = defaultdict(list)
    for k, n, g, t in brute(rows):
        found[k].append((k, n, g, t))
    out = []
    for k, t in sorted(rows, key=str):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        at = next(i for i, r in enumerate(found[k]) if r[1] == n)
        out.append(found[k].pop(at))
    return out


def lcp(a, b):
    n = 0
    while n < substring.WINDOW and a[n] == b[n]:
        n += 1
    return n


def test_leaves_are_sorted_suffixes():
    rng = random.Random(3)
    texts = [[rng.choice(["a", "b", "cc"]) for _ in range(rng.randint(50, 70))] for _ in range(8)] + [["a"] * 90, ["a"] * 60]
    tree = substring.Subtree([" ".join(t).encode() for t in [*texts, texts[0]]])
    leaves = [[w.decode() for w in tree.window(h).split()] for h in tree.heads]
    order = [leaves[k] for k in tree.order]
    assert order == sorted(leaves)
    assert tree.common.tolist() == [0] + [lcp(a, b) for a, b in zip(order, order[1:])]
    every = [[*texts, texts[0]][r][p : p + 50] for r, p in zip(tree.row, tree.place)]
    assert len(every) == sum(len(t) - 49 for t in [*texts, texts[0]])
    assert len({(n, *w) for n, w in zip(tree.node, every)}) == len({tuple(w) for w in every}) == len(set(tree.node))


def test_longer_prefixes_are_in_their_windows():
    rng = random.Random(5)
    words = [rng.choice("abc") for _ in range(300)] + ["x", "y", "z"] * 60
    found = substring.Anchors(" ".join(words).encode())
    longer = found.longer()
    of = defaultdict(set)
    for k in range(len(words) - 49):
        of[tuple(words[k : k + 50])].add(longer[k])
    assert len(longer) == len(words) - 49 and all(len(v) == 1 for v in of.values())
