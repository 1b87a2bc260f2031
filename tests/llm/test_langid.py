import random

import numpy as np
import pytest

from seqloom.llm import langid


def small_network():
    rng = np.random.default_rng(4)
    mask = langid._masks()
    return langid.Network(("a", "b", "c"), rng.normal(size=(256, langid.DIM)), rng.normal(size=mask.shape) * mask, rng.normal(size=mask.shape[1]), rng.normal(size=(mask.shape[1], 3)), rng.normal(size=3))


def plain_scores(net, window):
    """One window, filter by filter and place by place, as far as the widest filter fits."""
    vectors = [net.emb[b] for b in window]
    hidden = []
    for f in range(net.conv.shape[1]):
        width = langid.WIDTHS[f // langid.FILTERS]
        kernel = net.conv[: width * langid.DIM, f].reshape(width, langid.DIM)
        found = [sum(float(kernel[w] @ vectors[at + w]) for w in range(width)) for at in range(len(window) - max(langid.WIDTHS) + 1)]
        hidden.append(max(0.0, max(found) + net.bias[f]))
    out = [sum(h * net.out[f, k] for f, h in enumerate(hidden)) + net.out_bias[k] for k in range(3)]
    top = np.exp(np.array(out) - max(out))
    return top / top.sum()


def test_scores_against_plain_convolution(monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 2)
    net, rng = small_network(), np.random.default_rng(5)
    windows = rng.integers(0, 256, (5, 24)).astype(np.uint8)
    assert langid.scores(net, windows) == pytest.approx(np.stack([plain_scores(net, w) for w in windows]))


def test_windows_cover_the_whole_text():
    for n in (1, 23, 24, 25, 48, 100):
        text = bytes(range(n))
        assert {x for w in langid.windows_of(text, 24) for x in w.tolist()} - {32} == set(text) - {32}
        assert len(langid.windows_of(text, 24)) == -(-n // 24)


def test_languages_are_bounded_and_columns_travel_along(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["the", "of", "and"] if k % 2 else ["und", "der", "mit"]) for _ in range(40)), "en" if k % 2 else "de", {"k": k}) for k in range(80)]
    rows += [(100 + k, "rare words", f"junk{k}", None) for k in range(30)] + [(200, "12", "en", None), (201, None, "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred map<string,int>")
    assert {lang for _, lang in langid.sample(df, languages=2)} == {"de", "en"}
    kept = langid.keep_known(df, 0.0)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {200, 201}
    assert langid.keep_known(df.limit(0), 0.5).count() == 0
