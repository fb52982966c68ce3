import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from tabfid.llm import sharding

from . import cases


def check(rows, got, shards, near):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(slots) <= set(range(shards))
    load = np.bincount([r["shard"] for r in got], weights=[r["size"] for r in got], minlength=shards)
    assert load.max() - load.min() <= near * load.mean() + max((r["size"] for r in got), default=0)
    return got


def test_balance_and_groups(spark):
    rng = random.Random(8)
    rows = [(i, cases.sentence(rng, rng.randrange(1, 200))) for i in range(3000)]
    rows += [(5000 + i, rows[i % 50][1]) for i in range(300)]  # groups of 7
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = check(rows, sharding.shard_documents(docs, 8).collect(), 8, 0.002)
    text = {d: t for d, t in rows}
    where = defaultdict(set)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())
    for dim in ("tokens",):
        load = np.bincount([r["shard"] for r in got], weights=[r[dim] for r in got], minlength=8)
        assert load.max() <= 1.02 * load.min()


def test_a_hot_group_is_split(spark):
    rng = random.Random(3)
    hot = cases.sentence(rng, 40)
    rows = [(i, hot) for i in range(1500)] + [(2000 + i, cases.sentence(rng, 40)) for i in range(1500)]
    got = check(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect(), 4, 0.01)
    n = Counter(r["shard"] for r in got if r["doc_id"] < 1500)
    assert len(n) == 4
    rows_ = Counter(r["shard"] for r in got)
    assert max(rows_.values()) - min(rows_.values()) < 40


def test_a_large_group_stays_whole_if_it_fits(spark):
    rng = random.Random(3)
    hot = cases.sentence(rng, 40)
    rows = [(i, hot) for i in range(150)] + [(2000 + i, cases.sentence(rng, 40)) for i in range(1500)]
    got = check(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect(), 4, 0.01)
    assert len({r["shard"] for r in got if r["doc_id"] < 150}) == 1


def test_edge_rows(spark):
    rows = cases.documents()
    got = sharding.shard_documents(cases.table(spark), 3).collect()
    check([r[:2] for r in rows], got, 3, 3)
    assert sharding.shard_documents(cases.table(spark, []), 3).collect() == []
    again = sharding.shard_documents(cases.table(spark).repartition(7), 3).collect()
    key = lambda rs: Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in rs)
    assert key(got) == key(again)


def test_placing_follows_the_residual_capacity():
    v = np.array([[9, 1, 1], [1, 9, 1], [1, 1, 9], [9, 9, 9]], float)
    s = sharding.place(v, 2)
    assert s[3] not in {s[0]} or len(set(s.tolist())) == 2
    assert sharding.place(np.zeros((0, 3)), 4).tolist() == []


def test_rows_of_one_id_and_text_are_dealt_evenly(spark):
    rng = random.Random(5)
    hot = cases.sentence(rng, 200)
    for same in (None, 7):
        rows = [(same, hot)] * 400 + [(1000 + i, cases.sentence(rng, 200)) for i in range(400)]
        docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id bigint, text string, __id string, first int").repartition(5)
        got = sharding.shard_documents(docs, 4, keep=["doc_id", "__id"]).collect()
        check(rows, got, 4, 0.02)
        assert {r["__id"] for r in got} == {"a"}
