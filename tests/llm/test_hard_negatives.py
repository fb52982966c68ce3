import math
import random
from collections import Counter

import numpy as np

from tabfid.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, anchor_id bigint"


def brute(rows, every=100):
    use = []
    for i, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    last = lambda i: (i is None, i or 0)
    out = []
    for k, (a, av, label) in enumerate(use):
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(av, v)), i, l) for m, (i, v, l) in enumerate(use) if m != k and len(v) == len(av)]
        scored = [(max(min(s, 2**63 - 1), -2**63), i, l) for s, i, l in scored]
        scored.sort(key=lambda x: (-x[0], *last(x[1])))
        for ps, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 30 * ps <= 100 * x[0] <= 90 * ps][:10]
            out += [(a, p, r, n, ps, s) for r, (s, n, _) in enumerate(fit, 1)]
    return Counter(out)


def got(df):
    return Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
                   for r in df.collect())


def check(spark, rows, parts=4):
    want = brute(rows)
    assert got(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(parts))) == want
    return want


def random_rows(rng, n, dim=6, labels=3):
    return [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(dim)], rng.randrange(labels), "s", i) for i in range(n)]


def test_ties_nulls_repeats_and_lengths(spark):
    rng = random.Random(1)
    rows = random_rows(rng, 700)
    nan, inf = float("nan"), float("inf")
    rows += [(800, None, 1, None, None), (900, [1.0] * 6, None, None, None), (1000, [nan] + [1.0] * 5, 1, None, None),
             (1100, [inf] + [1.0] * 5, 1, None, None), (1200, [None] + [1.0] * 5, 1, None, None), (1300, [], 1, None, None),
             (1301, [], 1, None, None), (1400, [1.0, 2.0], 0, None, None), (1401, [1.0, 2.0], 0, None, None),
             (1402, [1.0, 1.0], 1, None, None), (None, [1.0] * 6, 0, None, None), (None, [0.5] * 6, 1, None, None),
             (-300, [1.0] * 6, 2, None, None), (0, rows[0][1], rows[0][2], None, None)]
    rows += [rows[100], rows[100], rows[5], rows[200]]  # repeated anchors and rows
    assert sum(check(spark, rows).values()) > 100


def test_many_equal_vectors(spark, monkeypatch):
    rng = random.Random(2)
    rows = random_rows(rng, 150) + [(1000 + i, [0.5] * 6, i % 3, "s", 1) for i in range(300)]
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "COMPONENTS", 60)
    check(spark, rows, 7)


def test_scores_beyond_doubles(spark):
    rng = random.Random(3)
    rows = [(i * 50, [rng.uniform(-1, 1) * 10 ** rng.choice([3, 6, 9]) for _ in range(4)], i % 2, "s", 1) for i in range(60)]
    rows += [(7, [3e38] * 4, 0, "s", 1), (100, [3e38] * 4, 0, "s", 1), (9, [1e38] * 4, 1, "s", 1)]
    assert sum(check(spark, rows).values()) > 0


def test_empty(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(100, [1.0], 1, "", 1)], SCHEMA)).collect() == []
