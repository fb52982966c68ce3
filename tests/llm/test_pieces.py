import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tabfid.llm import pieces

from . import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts_like_the_library():
    p = pieces.Pieces(open(PATH, "rb").read())
    rng = random.Random(3)
    letters = "aaabeéin ▁ \t\n\x00ﬁÀÀ你好😀zth01.:/<0x0A>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x400, 0xD7FF), 101])) for _ in range(30)) for _ in range(1000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 999, "\n" * 99, "<s></s><unk>", "▁▁a ▁", "", " "]
    for t in texts:
        ids = LIBRARY.encode(t)
        assert p.encode(t).tolist() == ids, t
        assert p.decode(p.encode(t)) == LIBRARY.decode(ids), t


def test_small_caches_change_nothing(monkeypatch):
    for name, n in (("MAX_PARTS", 3), ("MAX_PAIRS", 2), ("MAX_PART_CHARS", 4)):
        monkeypatch.setattr(pieces, name, n)
    p = pieces.Pieces(open(PATH, "rb").read())
    for _, text, *_ in cases.documents():
        if text and len(text) < 5000:
            assert p.encode(text).tolist() == LIBRARY.encode(text)


def test_table(spark):
    rows = cases.documents()
    docs = cases.table(spark)
    got = pieces.encode_documents(docs, PATH, back="back").collect()
    want = sorted((str(r[0]), r[1] or "", tuple(LIBRARY.encode(r[1] or ""))) for r in rows)
    assert sorted((str(r["doc_id"]), r["text"] or "", tuple(r["ids"])) for r in got) == want
    assert all(r["back"] == LIBRARY.decode(list(r["ids"])) for r in got)
    assert pieces.encode_documents(cases.table(spark, []), PATH).collect() == []


def test_decoding_a_column(spark):
    model = pieces.read_model(spark, PATH)
    d = spark.createDataFrame([(1, LIBRARY.encode("Café 你好 x")), (2, []), (3, None)], "n int, ids array<int>")
    got = d.select("n", pieces.decoded(F.col("ids"), model).alias("t")).orderBy("n").collect()
    assert [r["t"] for r in got] == ["Café 你好 x", "", ""]
