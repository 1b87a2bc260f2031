import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from seqloom.llm import langid, simhash
from tests.llm.test_substring import brute

HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    parts = {"en": "the of and ing tion here over with that".split(), "fr": "leç que être ê dans une ément où".split()}
    line = lambda lang, n: " ".join(rng.choice(parts[lang]) + rng.choice(parts[lang]) + rng.choice("abcdefg") for _ in range(n))
    passage = line("en", 70)
    rows = []
    for k in range(150):
        lang = rng.choice(["en", "fr"])
        text = line(lang, rng.randint(20, 200))
        if k % 9 == 0:
            text += " " + passage
        if k % 10 == 0:
            text += f'\ntoken = "{HEX}" {line(lang, 5)}'
        rows.append((k, text, lang, f"src{k % 3}", len(text)))
    rows += [(200 + k, rows[k][1], rows[k][2], "src0", 1) for k in range(10)]
    rows += [(300, None, "en", "src0", 0), (301, "", "en", "src0", 0), (302, "123 456 !!", None, None, 9), (303, passage, "en", "src1", 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_stages_against_brute_force(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "substring_dedup", "secret_scan", "best_fit_packing"]
    texts = {r[0]: r[1] for r in rows}

    docs = stages["language_id"](spark, docs, path).checkpoint()
    got = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and got == {k: t for k, t in texts.items() if k not in (300, 301, 302)}

    docs = stages["near_dedup"](spark, docs, path).checkpoint()
    prints, parent = {k: simhash.fingerprint(t) for k, t in got.items()}, {k: k for k in got}
    for _ in got:
        for a in got:
            for b in got:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    parent[a] = parent[b] = min(parent[a], parent[b])
        if all(parent[parent[x]] == parent[x] for x in got):
            break
    want = {k: t for k, t in got.items() if parent[k] == k}
    got = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and got == want and not any(200 <= k < 300 for k in got)

    docs = stages["substring_dedup"](spark, docs, path).checkpoint()
    want = {k: (kept if gone else got[k]) for k, _, gone, kept in brute(list(got.items()))}
    got = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and got == {k: t for k, t in want.items() if t} and 303 not in got

    docs = stages["secret_scan"](spark, docs, path).checkpoint()
    want = {k: re.sub(HEX, "[SECRET]", t) for k, t in got.items()}
    got = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and got == want and any("[SECRET]" in t for t in got.values())

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {(k, zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for k, t in got.items()}
    packed = stages["best_fit_packing"](spark, docs, path).collect()
    assert {(r.doc_id, r.ids_crc32) for r in packed} == want
    run = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, packed))


def test_stages_with_clashing_names_and_types(spark, corpus):
    path, rows = corpus
    extra = {"_id": "map('a', doc_id)", "_fp": "source", "_sha": "1", "_windows": "array(1)", "_mark_id": "doc_id", "_flags": "source", "_k": "2", "column0": "map(1, text)", "_component": "3", "`a b.c`": "4"}
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id % 5 = 0 OR doc_id >= 200").selectExpr("*", *[f"{v} AS {k}" for k, v in extra.items()])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path).checkpoint()
        assert docs.columns == columns and docs.count() > 20, name
        assert docs.where("_mark_id <> doc_id OR _id['a'] <> doc_id OR `a b.c` <> 4").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() >= docs.count()


def test_language_on_held_out_rows(spark):
    df = spark.read.parquet(f"{os.environ.get('SEQLOOM_DATA', '/root/testdata')}/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    found = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(spark):
    rows = [(k, "the of and here with that " * 9, "en") for k in range(30)] + [(50, None, "en"), (51, "", None), (52, "42 !?", "en"), (None, "the", None), (53, "é", "en"), (1, "of " * 99_999, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in langid.identify(df).collect()}
    assert {r[1] for r in got if r[0] in (50, 51, 52)} == {"und"} and (None, "en", False) in got and {r[1] for r in got if r[0] in (1, 53)} == {"en"}
    assert {r.lang_pred for r in langid.identify(df.where("lang IS NULL")).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0
