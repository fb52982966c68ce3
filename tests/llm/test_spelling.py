import random
import re
import zlib
from collections import Counter

import pytest

from tabfid.llm import spelling

from . import cases


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=5):
    form, rows = {}, {}
    for w, n in counts.items():
        around = sorted((-m, v) for v, m in counts.items() if near(w, v))
        if around and -around[0][0] >= ratio * n:
            form[w] = around[0][1]
        rows[w] = [len(around)]
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, rows[w][0], counts.get(form.get(w)))
    return out


def got(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in rows}


def plain_counts(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


@pytest.mark.parametrize("per_range", [50_000, 7, 1])
def test_few_letters(spark, monkeypatch, per_range):
    monkeypatch.setattr(spelling, "RANGE", per_range)
    rng = random.Random(per_range)
    words = {"".join(rng.choice("aab") for _ in range(rng.randrange(1, 8))) for _ in range(40)}
    words |= {"é" * k for k in (5, 6, 7)} | {"aaaaaa", "aaaaaaa", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500}
    counts = {w: rng.choice([5, 6, 30, 160, 900, 5000]) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert got(spelling.variants(df)) == brute(counts)


def test_chains_and_ties(spark):
    counts = {"aaaaaa": 100_000, "aaaaab": 20_000, "aaaabb": 4_000, "aaabbb": 800, "aabbbb": 160, "abbbbb": 32, "bbbbbb": 6,
              "tiedxa": 50, "tiedxb": 50, "tiedxc": 10, "lonely": 7}
    want = brute(counts)
    assert want["bbbbbb"][1] == "aaaaaa" and want["tiedxc"][0] == "tiedxa"
    assert got(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"))) == want
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"), ratio=1)


def test_documents(spark):
    rng = random.Random(2)
    vocabulary = ["Straße", "ÀÉÎõü×", "letters", "letterS", "leters", "abcdef", "abcdefg", "short", "q" * 300] + [
        "".join(rng.choice("etaoin") for _ in range(rng.randrange(5, 9))) for _ in range(150)]
    rows = [(rng.choice([i, i, None]), " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(900)]
    rows += [(1, None), (2, ""), (3, "1234 _-_"), rows[0], rows[0], (5, "repeat " * 40_000)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id bigint, text string, word string, n bigint").repartition(5)
    counts = plain_counts(rows)
    counted = spelling.word_counts(docs)
    assert {r["word"]: r["n"] for r in counted.collect()} == counts
    typos = {w for w in counts if w not in {v.lower() for v in vocabulary} | {"repeat"}}
    assert typos
    assert got(spelling.variants(counted)) == brute(counts)


def test_nothing_to_count(spark):
    assert got(spelling.variants(spelling.word_counts(cases.table(spark, [])))) == {}
    assert got(spelling.variants(spelling.word_counts(cases.table(spark)))) == brute(plain_counts([r[:2] for r in cases.documents()]))
