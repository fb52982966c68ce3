import random
from collections import Counter, defaultdict

import pytest

from tabfid.llm import common
from tabfid.llm import substring_dedup as s

from . import cases


def brute(rows):
    """Counter of (doc_id, n_words, n_removed, kept text)."""
    first = defaultdict(lambda: float("inf"))
    docs = [(float("inf") if d is None else d, d, cases.SPACE_WORDS.findall(t or "")) for d, t in rows]
    for rank, _, w in docs:
        for i in range(len(w) - 49):
            k = tuple(w[i:i + 50])
            first[k] = min(first[k], rank)
    out = Counter()
    for rank, d, w in docs:
        gone = {p for i in range(len(w) - 49) if first[tuple(w[i:i + 50])] < rank for p in range(i, i + 50)}
        out[(d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))] += 1
    return out


def corpus():
    rng = random.Random(9)
    passage, other = cases.sentence(rng, 80, 9000), cases.sentence(rng, 50, 9000)
    rows = [(i, cases.sentence(rng, rng.randrange(0, 90), 9000) + " " + passage + " " + cases.sentence(rng, rng.randrange(0, 90), 9000))
            for i in range(60)]
    rows += [(100 + i, other + " " + cases.sentence(rng, 30) + " " + other + " " + passage) for i in range(10)]
    rows += [(200, "same " * 300), (201, "same " * 200), (202, "same " * 50), (203, "same " * 49)]
    rows += [(300, " ".join(passage.split()[:50])), (301, " ".join(passage.split()[:49])), (302, passage.replace(" ", "\n\t"))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [s.HOT, 3])
def test_like_brute_force(spark, monkeypatch, hot):
    """With minimisers gathered, and hot ones hashed."""
    monkeypatch.setattr(s.covered_ranges, "__defaults__", ("doc_id", "text", hot))
    rows = corpus() + [r[:2] for r in cases.documents()]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id bigint, text string, t1 string")
    got = s.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute(rows)


def test_super_kmers_hold_every_window_once():
    rng = random.Random(1)
    for n in (0, 49, 50, 51, 120, 700):
        w = [b"w%d" % rng.randrange(50) for _ in range(n)]
        m, starts = s.super_kmers(w)
        if n < 50:
            assert not len(m)
            continue
        assert starts[0] == 0 and (starts[1:] > starts[:-1]).all() and starts[-1] <= n - 50
        for i in range(n - 49):  # the minimiser is a function of the window alone
            own, _ = s.super_kmers(w[i:i + 50])
            assert own[0] == m[starts.searchsorted(i, "right") - 1]


def test_empty(spark):
    assert s.remove_repeats(cases.table(spark, []).drop("n_words")).collect() == []
    with pytest.raises(ValueError):
        s.remove_repeats(cases.table(spark))


def test_hot_windows_and_long_super_kmers(spark, monkeypatch):
    """One window in very many texts, and texts of a repeated word, by every path of the join and in pieces."""
    rng = random.Random(12)
    passage = cases.sentence(rng, 70, 5000)
    rows = [(i, f"{cases.sentence(rng, 20, 5000)} {passage} {cases.sentence(rng, 20, 5000)}") for i in range(60)]
    rows += [(100 + i, "same " * (700 + i) + cases.sentence(rng, 5)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = sorted(map(tuple, s.remove_repeats(docs).drop("text").collect()))
    monkeypatch.setattr(s, "PIECE", 16)
    monkeypatch.setattr(s, "join_heavy", lambda *a: common.join_heavy(*a, heavy=5))
    frame = s.covered_ranges
    monkeypatch.setattr(s, "covered_ranges", lambda *a: frame(*a, hot=3))
    assert sorted(map(tuple, s.remove_repeats(docs).drop("text").collect())) == plain
    monkeypatch.setattr(s, "join_heavy", lambda *a: common.join_heavy(*a, heavy=5, limit=0))
    assert sorted(map(tuple, s.remove_repeats(docs).drop("text").collect())) == plain
    assert all(r[2] >= 70 for r in plain if 0 < r[0] < 60)
