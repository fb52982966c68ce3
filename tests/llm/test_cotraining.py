import random

import numpy as np
import pytest

from tabfid.llm import cotraining as c

from . import cases


def corpus():
    """Good texts, shouted junk and texts with bad words; every second row has labels."""
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        w = cases.sentence(rng, rng.randrange(20, 80), 300).split()
        bad, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "scum"]))
        text = "!! ".join(w).upper() if bad else " ".join(w)
        rows.append((i, text, "en", f"src{i % 7}", len(text), "", "", "", ""))
        if rng.random() < 0.6:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = cases.table(spark, rows)
    lab = spark.createDataFrame(labels + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    models = c.train(docs, lab, {"quality": False, "toxic": True})
    got = {r["doc_id"]: r for r in c.score(docs, models).collect()}
    unseen = [r[0] for r in rows if r[0] not in {x[0] for x in labels}]
    right = np.mean([(got[i]["quality"] >= 0.5) == (i % 5 != 0) for i in unseen])
    right_toxic = np.mean([(got[i]["toxic"] >= 0.5) == (i % 4 == 1) for i in unseen])
    assert len(unseen) > 200 and right > 0.97 and right_toxic > 0.97
    clean = [i for i in unseen if i % 4 != 1]
    assert np.mean([got[i]["toxic"] >= 0.5 for i in clean]) < 0.02


def test_views_teach_each_other():
    """The metadata view has no usable labels of its own; the text view's pseudo-labels train it."""
    rows, labels = corpus()
    known = dict((i, q) for i, q, _ in labels)
    t = {r[0]: c.text_features(r[1]) for r in rows}
    m = {r[0]: c.meta_features(r[1], r[2], r[3]) for r in rows}
    ids = sorted(known)
    pool = [r[0] for r in rows if r[0] not in known]
    y = np.array([known[i] for i in ids])
    views = [[t[i] for i in ids], [m[i] for i in ids]]
    with_pool = c.cotrain(views, y, [[t[i] for i in pool], [m[i] for i in pool]])
    alone = c.cotrain(views, y, [[], []])
    assert with_pool.constant is None and alone.constant is None
    assert not np.array_equal(with_pool.views[0][0], alone.views[0][0])


def test_edge_rows_and_few_labels(spark):
    docs = cases.table(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = c.score(docs, c.train(docs, none, {"quality": False, "toxic": True})).collect()
    assert len(got) == len(cases.documents()) and {r["quality"] for r in got} == {0.5}
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    models = c.train(cases.table(spark, rows), lab, {"quality": False})
    got = c.score(docs, models).collect()
    assert len(got) == len(cases.documents()) and all(0 <= r["quality"] <= 1 for r in got)
    same = [r["quality"] for r in got if r["doc_id"] == 5]
    assert len(same) == 3 and len(set(same)) == 1
    assert c.score(cases.table(spark, []), models).collect() == []
    with pytest.raises(ValueError):
        c.score(docs.withColumnRenamed("k1", "Quality"), models)


def test_rare_class_is_kept_whole(spark):
    """About 1 % toxic labels and a sample of a tenth: all toxic labels train, and toxic rows are caught."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(6000):
        w, toxic = cases.sentence(rng, rng.randrange(10, 25), 200).split(), i % 100 == 7
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron"]))
        rows.append((i, " ".join(w), "en", "a", 1, "", "", "", ""))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    docs = cases.table(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    models = c.train(docs, lab, {"toxic": True}, max_labelled=400)
    got = {r["doc_id"]: r["toxic"] for r in c.score(docs, models).collect()}
    unseen = [i for i in range(0, 6000, 3) if i % 100 == 7]
    assert len(unseen) == 20 and np.mean([got[i] >= 0.5 for i in unseen]) > 0.7
    assert np.mean([got[i] >= 0.5 for i in range(6000) if i % 100 != 7]) < 0.005
    assert abs(np.mean(list(got.values())) - 0.01) < 0.005  # the probabilities keep the labels' proportion


def test_every_unlabelled_row_is_scored(spark):
    """The pseudo-labelled rows are the surest of the whole table, each doc_id once, none with a label."""
    rows, labels = corpus()
    known = {i: q for i, q, _ in labels}
    docs = cases.table(spark, rows + rows[:300])
    feats = c.feature_table(docs)
    lab = spark.createDataFrame(list(known.items()), "id bigint, y_quality int")
    ids = sorted(known)
    t = {r[0]: (c.text_features(r[1]), c.meta_features(r[1], r[2], r[3])) for r in rows}
    job = c.Training([[t[i][v] for i in ids] for v in (0, 1)], np.array([known[i] for i in ids]))
    job.fit()
    picks = c.surest(feats, lab, {"quality": job})["quality"]
    free = [r[0] for r in rows if r[0] not in known]
    assert len(picks) == 4 and any(xs for _, xs in picks)
    taken = [set(), set()]
    for q, xs in picks:
        w, b = job.judges()[q.view]
        p = dict(zip(free, c._sigmoid(c.Rows([t[i][q.view] for i in free]).dot(w) + b)))
        sure = {i: x if q.label else 1 - x for i, x in p.items() if i not in taken[1 - q.view]}
        want = sorted((x for x in sure.values() if x >= q.least), reverse=True)[:q.n]
        assert len(set(xs)) == len(xs) and not set(xs) & set(known)
        assert np.allclose([sure[i] for i in xs], want)
        taken[1 - q.view] |= set(xs)
