import random
import re

import numpy as np
import pytest
import xxhash

from seqloom.llm import components, simhash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = {k: k for k in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def test_fingerprints():
    rng = random.Random(2)
    texts = [None, "", " \n", "one", "Two Words", "É é A a", "x\xa0y z", "W " * 10_000] + [" ".join(rng.choice(["The", "of", "é", "b\x1cc", "dd"]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_masks_cover_every_pair_of_three_bits():
    rng = np.random.default_rng(1)
    masks = np.array(simhash.choices(), np.uint64)
    assert len(masks) == 20
    for _ in range(3000):
        bits = rng.choice(64, 3, replace=False)
        diff = np.uint64(sum(1 << int(b) for b in bits))
        assert ((masks & diff) == 0).any()


def test_longer_masks_cover_what_is_free():
    masks = simhash.choices()
    for _ in range(simhash.ROUNDS):
        masks = [x for m in masks for x in simhash.longer(m)]
        assert all(any(d & x == 0 for x in simhash.longer(m)) for m in masks[:40] for d in (0, 1 << 63, 7, 1 << 40 | 1 << 20 | 1) if d & m == 0)
    assert min(m.bit_count() for m in masks) >= 64 - 12


def test_forest_spans_what_pairs_link():
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(8)]
    fps = sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for s in seeds for _ in range(25)})
    want = plain_components(dict(enumerate(fps)))
    parent = list(range(len(fps)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in simhash.forest(np.array(fps, np.uint64)):
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {k: root(k) for k in range(len(fps))} == want


@pytest.mark.parametrize("limit", [components.ONE_TASK_EDGES, 0])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "ONE_TASK_EDGES", limit)
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(7, 7), (9, 8), (8, 9)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("group", [simhash.GROUP, 3])
def test_operator_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(6)
    texts = [None, "", "only", "only"]
    for _ in range(25):
        words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(150)]
        for _ in range(rng.randint(1, 6)):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = "edit"
            texts.append(" ".join(own))
    rows = [(k, t, 0) for k, t in enumerate(texts)] + [(None, texts[5], 0), (5, texts[5], 0), (None, "alone without an id", 0)]
    df = spark.createDataFrame([(*r, {"a": 1}) for r in rows], "doc_id long, text string, component_id int, _id map<string,int>")
    want = plain_components({k: plain_fingerprint(t) for k, t, _ in rows if k is not None})
    got = simhash.near_duplicate_digest(df).collect()
    assert len(got) == len(rows) and len(set(want.values())) < len(want) - 15
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.fingerprint == f"{plain_fingerprint(texts[r.doc_id]):016x}"
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted([str(want[5]), "None"])
    assert simhash.near_duplicate_digest(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {None, *want.values()}
