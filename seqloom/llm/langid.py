"""Language identification by a byte convolutional network in numpy.

A text is cut into windows of ``WINDOW`` bytes over its whole length. Filters of several widths run over byte vectors, each
filter keeps its maximum in a window, and softmax over these maxima gives the window's languages. A text's scores are
the mean over its windows.

Training reads a bounded sample: about ``PER_LANGUAGE`` documents of each language, drawn by a seeded hash of the id from the
rows that may be learned from, and of each at most ``WINDOWS_EACH`` windows. Of a column with more than ``LANGUAGES`` different values the most frequent
are learned, so neither sample nor network grows with what else stands in it. The network is a few tens of kB.

Defined cases. Null text or one without a letter: ``und``, score 0. Null languages are never learned from. No row to learn from:
every text is ``und``. One language only: every text with a letter has it. Ties go to the language that sorts first. Repeated
rows stay repeated; a null id counts as held out of nothing (its ``held_out`` is false) and is not learned from. Texts of any length are read whole. Extra columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from seqloom.llm.common import ARROW_ROWS, Renamed, map_batches

WINDOW, DIM, WIDTHS, FILTERS = 192, 8, (2, 3, 4, 5), 10
PER_LANGUAGE, LANGUAGES, WINDOWS_EACH, LEAST_BYTES = 400, 100, 4, 24
#: Windows in one product of matrices.
CHUNK = 512


@dataclass(frozen=True)
class Network:
    """emb: 256 x DIM; conv: (max width * DIM) x filters, zero where a filter is narrower; out: filters x languages."""

    langs: tuple[str, ...]
    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows_of(text: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text in rows of ``size`` bytes; the last row also holds what came before it if the text is long enough."""
    raw = np.frombuffer(text, np.uint8)
    n = max(1, -(-len(raw) // size))
    if len(raw) < size:
        return np.pad(raw, (0, size - len(raw)), constant_values=32).reshape(1, size)
    whole = raw[: len(raw) // size * size].reshape(-1, size)
    return whole if len(whole) == n else np.concatenate([whole, raw[None, -size:]])


def _columns(windows: np.ndarray, net_emb: np.ndarray) -> np.ndarray:
    """Windows x positions x (max width * DIM): the byte vectors that the filters see at each position."""
    wide = max(WIDTHS)
    vectors = net_emb[windows]
    view = np.lib.stride_tricks.sliding_window_view(vectors.reshape(len(windows), -1), wide * DIM, axis=1)
    return np.ascontiguousarray(view[:, ::DIM])


def _masks() -> np.ndarray:
    mask = np.zeros((max(WIDTHS) * DIM, len(WIDTHS) * FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def scores(net: Network, windows: np.ndarray) -> np.ndarray:
    """Windows x languages."""
    out = np.empty((len(windows), len(net.langs)))
    for k in range(0, len(windows), CHUNK):
        cols = _columns(windows[k : k + CHUNK], net.emb)
        n, at, _ = cols.shape
        top = (cols.reshape(n * at, -1) @ net.conv).reshape(n, at, -1).max(axis=1)
        out[k : k + n] = _softmax(np.maximum(top + net.bias, 0) @ net.out + net.out_bias)
    return out


def train(samples: list[tuple[bytes, str]], seed: int = 42, epochs: int = 14, batch: int = 64, rate: float = 0.01) -> Network:
    """Adam on cross-entropy. samples: windows of bytes and their language."""
    rng = np.random.default_rng(seed)
    langs = tuple(sorted({x for _, x in samples}))
    x = np.stack([windows_of(t)[0] for t, _ in samples])
    y = np.array([langs.index(v) for _, v in samples])
    mask, m = _masks(), len(WIDTHS) * FILTERS
    par = [
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        (rng.normal(0, 0.25, mask.shape) * mask).astype(np.float32),
        np.zeros(m, np.float32),
        rng.normal(0, 0.3, (m, len(langs))).astype(np.float32),
        np.zeros(len(langs), np.float32),
    ]
    first, second, step = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    weight = (1 / np.maximum(1, np.bincount(y, minlength=len(langs))))[y]
    weight *= len(y) / weight.sum()
    wide = max(WIDTHS)
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            emb, conv, bias, out, out_bias = par
            bytes_, cols = x[own], _columns(x[own], emb)
            n, at, _ = cols.shape
            act = cols.reshape(n * at, -1) @ conv
            act = act.reshape(n, at, m)
            where = act.argmax(axis=1)
            top = np.take_along_axis(act, where[:, None], 1)[:, 0] + bias
            hid = np.maximum(top, 0)
            p = _softmax(hid @ out + out_bias)
            p[np.arange(n), y[own]] -= 1
            p = (p * weight[own, None] / n).astype(np.float32)
            grad_hid = (p @ out.T) * (top > 0)
            seen = cols[np.arange(n)[:, None], where]  # n x m x (wide * DIM)
            grad_conv = np.einsum("nm,nmd->dm", grad_hid, seen) * mask
            back = (grad_hid[:, :, None] * conv.T[None]).reshape(n, m, wide, DIM)
            grad_emb = np.zeros_like(emb)
            spots = bytes_[np.arange(n)[:, None, None], where[:, :, None] + np.arange(wide)]
            np.add.at(grad_emb, spots.ravel(), back.reshape(-1, DIM))
            grads = [grad_emb, grad_conv, grad_hid.sum(0), hid.T @ p, p.sum(0)]
            step += 1
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q, g, a, b in zip(par, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= (pace * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return Network(langs, *par)


def may_learn(doc_id, lang):
    """Rows to learn from: crc32 of the id as text is not 0 modulo 5, and the language is known."""
    return lang.isNotNull() & (F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0)


def sample(df: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 42, languages: int = LANGUAGES) -> list[tuple[bytes, str]]:
    """Windows and their languages from about ``per_language`` documents of each language: bounded, and collected to train on."""
    rows = df.select(F.col("doc_id"), F.col("lang"), F.col("text")).where(may_learn(F.col("doc_id"), F.col("lang")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return []
    rates = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_language / n))])
    luck = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chars = F.length("text")
    cut = [F.substring("text", F.greatest(F.lit(1), (chars * F.lit(k) / F.lit(WINDOWS_EACH)).cast("int") + 1), F.lit(WINDOW)) for k in range(WINDOWS_EACH)]
    drawn = rows.where(F.col("text").isNotNull() & (luck < rates[F.col("lang")])).select("doc_id", "lang", F.array(*cut).alias("cut"))
    drawn = drawn.withColumn("cut", F.array_distinct("cut"))
    out = []
    for r in sorted(drawn.collect(), key=lambda r: (r["doc_id"], r["lang"], r["cut"])):
        for c in r["cut"]:
            if sum(x.isalpha() for x in c) >= 8 or len(r["cut"]) == 1 and any(x.isalpha() for x in c):
                raw = c.encode("utf-8", "surrogatepass")
                out.append((raw[:WINDOW], r["lang"]))
                if len(raw) >= 2 * LEAST_BYTES and len(out) % 4 == 0:  # short texts are learned as well
                    out.append((raw[: LEAST_BYTES + len(out) % LEAST_BYTES], r["lang"]))
    return out


def predict(net: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, values = ["und"] * len(texts), [0.0] * len(texts)
    spots, parts = [], []
    for k, text in enumerate(texts):
        if net is not None and text and any(c.isalpha() for c in text):
            parts.append(windows_of(text.encode("utf-8", "surrogatepass")))
            spots.append(k)
    if spots:
        ends = np.cumsum([len(p) for p in parts])
        found = scores(net, np.concatenate(parts))
        sums = np.add.reduceat(found, np.concatenate([[0], ends[:-1]]), axis=0) / np.diff(ends, prepend=0)[:, None]
        best = sums.argmax(axis=1)
        for k, b, v in zip(spots, best, sums, strict=True):
            names[k], values[k] = net.langs[b], float(min(1.0, max(0.0, v[b])))
    return names, values


def _predictor(net: Network | None, at: int):
    """A mapInArrow function that adds lang_pred and score to the batch; column ``at`` is the text, dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values = predict(net, batch.column(at).to_pylist())
            cols = [c for k, c in enumerate(batch.columns) if k != at]
            fields = [f for k, f in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(values, pa.float64())], [*fields, "lang_pred", "score"])

    return run


def identify(df: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of doc_id, text, lang."""
    learned = sample(df, seed=seed)
    net = train(learned, seed) if learned else None
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").alias("_text"))
    return map_batches(own, _predictor(net, 2), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(df: DataFrame, least: float, seed: int = 42) -> DataFrame:
    """Rows whose text has a language with a score of at least ``least``, unchanged and with all their columns, of whatever names and types."""
    learned = sample(df, seed=seed)
    net = train(learned, seed) if learned else None

    def known(texts: pa.Array) -> pa.Array:
        out = []
        for k in range(0, len(texts), ARROW_ROWS):
            names, values = predict(net, texts.slice(k, ARROW_ROWS).to_pylist())
            out += [n != "und" and v >= least for n, v in zip(names, values, strict=True)]
        return pa.array(out, pa.bool_())

    own = Renamed(df)
    return own.back(own.frame.where(F.arrow_udf(known, BooleanType())(own.at("text").cast("string"))))
