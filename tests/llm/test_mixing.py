import random
import re
from collections import Counter, defaultdict

import pytest

from tabfid.llm import mixing
from tabfid.llm.queries import weight_schedule

from . import cases

SCHEMA = "doc_id bigint, text string, source string, position string, size int, n long, start string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, "s") for r in rows], SCHEMA)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, share=1.5):
    """By resharing the excess until no source is above twice its size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            return {**out, **{s: left * weight[s] / total for s in open_}}
        out.update({s: 2.0 * sizes[s] for s in full})
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def check(rows, got):
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((d, s, size(t)) for d, t, s in rows)
    sizes, taken, most = Counter(), Counter(), Counter()
    for d, t, s in rows:
        sizes[s] += size(t)
        most[s] = max(most[s], size(t))
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert r["taken"] == len(r["positions"]) * r["size"] and len(r["positions"]) <= 2
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6
    return got


def key(rows):
    return Counter((r["doc_id"], r["source"], r["size"], r["taken"], tuple(r["positions"])) for r in rows)


def test_targets_hot_source_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    rng = random.Random(4)
    rows = [(i, cases.sentence(rng, rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", "é", "z", None])) for i in range(1500)]
    rows += [(7000 + i, "one", "tiny") for i in range(3)] + [rows[3]] * 40 + [(None, "same text here", "b")] * 70
    docs = frame(spark, rows)
    got = check(rows, mixing.assign(docs, weight_schedule(docs)).collect())
    firsts = [r["positions"][0] for r in got if r["positions"]]
    assert firsts == sorted(firsts) and not any(r["positions"] for r in got[len(firsts):])
    again = docs.repartition(9)
    assert key(mixing.assign(again, weight_schedule(again)).collect()) == key(got)


def test_demand_follows_the_schedule(spark):
    """Words of a source up to a point of the training are the integral of its weights up to there."""
    rows = [(i, "w " * 5, "abc"[i % 3]) for i in range(9000)]
    docs = frame(spark, rows)
    got = check(rows, mixing.assign(docs, weight_schedule(docs)).collect())
    run = {"a": lambda t: (4 * t - t * t) / 3, "b": lambda t: t * t, "c": lambda t: t}
    at = defaultdict(list)
    for r in got:
        at[r["source"]] += r["positions"]
    for s, ps in at.items():
        for t in (0.1, 0.25, 0.5, 0.9):
            assert sum(p <= t for p in ps) / len(ps) == pytest.approx(run[s](t), abs=2e-3)


def test_training_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PARTS", 3)
    rng = random.Random(6)
    rows = [(i, cases.sentence(rng, rng.randrange(0, 30)), rng.choice(["a", "b", None])) for i in range(200)]
    rows += [(None, "again and again", "b")] * 50 + [(1, None, "a"), (2, "", None)]
    docs = frame(spark, rows)
    one = Counter((r["doc_id"], r["source"], p) for r in mixing.assign(docs, weight_schedule(docs)).collect() for p in r["positions"])
    mix = mixing.training_rows(docs, weight_schedule(docs))
    assert mix.columns == [*docs.columns, "__position"]
    out = mix.collect()
    assert Counter((r["doc_id"], r["source"], r["__position"]) for r in out) == one
    assert [r["__position"] for r in out] == sorted(r["__position"] for r in out)
    text = Counter((d, t, s) for d, t, s in rows)
    assert all((r["doc_id"], r["text"], r["source"]) in text and r["position"] == "p" for r in out)


def test_edges(spark):
    rows = [(d, t, s) for d, t, _, s, *_ in cases.documents()]
    docs = frame(spark, rows)
    check(rows, mixing.assign(docs, weight_schedule(docs)).collect())
    empty = frame(spark, [])
    assert mixing.assign(empty, weight_schedule(empty)).collect() == []
    assert mixing.training_rows(empty, weight_schedule(empty)).collect() == []
    blank = frame(spark, [(1, None, "a"), (2, " ", "a")])
    assert [r["taken"] for r in mixing.assign(blank, weight_schedule(blank)).collect()] == [0, 0]
    other = spark.createDataFrame([("b", 0.0, 1.0), ("b", 1.0, 1.0), ("a", 0.0, 0.0), ("a", 1.0, 0.0)], "source string, at double, weight double")
    got = mixing.assign(frame(spark, [(1, "x y", "a"), (2, "x y", "b"), (3, "z", None)]), other).collect()
    assert {r["source"]: r["taken"] for r in got} == {"a": 0, "b": 4, None: 0}
