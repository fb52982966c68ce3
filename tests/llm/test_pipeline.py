"""The pipeline against a plain version of every stage, written from the stated rules."""

import random
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

from tabfid.llm import secrets  # noqa: E402

from . import cases, test_decontaminate, test_minhash, test_quality_rules  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain(rows, bench):
    rows = [r for r, ok in zip(rows, test_quality_rules.verdicts(rows)) if ok]
    component = {(d, s): c for (d, s, c) in test_minhash.brute([r[:2] for r in rows])}
    rows = [r for r in rows if component[(r[0], len(test_minhash.shingle_set(r[1])))] == r[0]]
    rows = [r for r in rows if not test_decontaminate.brute(r[1], bench)[1]]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for d, t, lang, source, n in rows:
        new = secrets.redact(t)
        ids = sp.encode(new)
        out.append((d, new, lang, source, n if new == t else len(new), tuple(ids), sp.decode(ids)))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    rows = []
    for i in range(150):
        t = cases.sentence(rng, rng.randrange(10, 60), 4000)
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t)))
    for i in range(150, 170):  # near copies, symbols, secrets
        d = rows[rng.randrange(150)]
        rows.append((i, d[1] + " tail", d[2], d[3], 1))
    rows += [(170, "### ".join(cases.sentence(rng, 60).split()), "en", "a", 1), (171, "", "en", "a", 0), (172, None, None, None, None)]
    rows += [(173, cases.sentence(rng, 30, 4000) + ' api_key = "Abcd1234Efgh5678"', "en", "a", 99)]
    rows += [(174, "again and again and on we go now " * 10, "en", "a", 5)]
    bench = [(0, " ".join(rows[7][1].split()[:10])), (1, cases.sentence(rng, 20, 4000)), (2, None)]
    return rows, bench


def test_run(spark, corpus, tmp_path):
    rows, bench = corpus
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "decoded"]
    got = got.collect()
    want = plain(rows, bench)
    assert Counter((*r[:5], tuple(r["ids"]), r["decoded"]) for r in got) == Counter(want)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert 60 < len(want) < 150 and 7 not in {r[0] for r in want} and 170 not in {r[0] for r in want}


def test_stages_of_an_empty_table(spark, corpus, tmp_path):
    spark.createDataFrame(corpus[1], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], SCHEMA + ", __was string, __k1 string, extra int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:len(docs.columns)] == docs.columns, name
        assert out.collect() == []


def test_stages_keep_clashing_columns(spark, corpus, tmp_path):
    spark.createDataFrame(corpus[1], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(*r, "a", "b", 3, "i", "n", "d") for r in corpus[0]]
    docs = spark.createDataFrame(rows, SCHEMA + ", __was string, __K1 string, kept int, IDS string, n_tokens string, decoded string")
    docs = docs.repartition(2).cache()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns + (["__ids", "__n_tokens", "__decoded"] if name == "sentencepiece" else [])
        assert {tuple(r[5:11]) for r in got.collect()} == {("a", "b", 3, "i", "n", "d")}, name
