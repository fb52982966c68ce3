import re
from collections import Counter

import pytest

from tabfid.llm import decontaminate as d

from . import cases

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def brute(text, items):
    w, hit, met = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(len(x), 10)
        for j in range(len(x) - n + 1) if n and i is not None else ():
            for p in range(len(w) - n + 1):
                if w[p:p + n] == x[j:j + n]:
                    hit.update(range(p, p + n))
                    met.add(str(i))
    return len(w), len(hit), sorted(met)


def items():
    long = next(t for _, t, *_ in cases.documents() if t and len(t.split()) == 300)
    return [(1, " ".join(long.split()[20:45])), (10, "TWO... words!"), (2, "élan Vital"), (3, None), (4, " .,! "), (None, "one"),
            (5, " ".join(long.split()[30:60])), (5, "naïve café 你好 😀"), (1, " ".join(long.split()[20:45])), (6, "abc abc abc")]


@pytest.mark.parametrize("room", [2**26, 0])
def test_edge_rows(spark, monkeypatch, room):
    """With the set broadcast, and joined by a shuffle."""
    monkeypatch.setattr(d, "MAX_SET_BYTES", room)
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    rows = [r for r in cases.documents() if len(r[1] or "") < 20_000]
    got = d.contamination(cases.table(spark, rows), bench).collect()
    want = Counter((r[0], *(lambda e: (e[0], e[1], ",".join(e[2])))(brute(r[1], items()))) for r in rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


def test_filters(spark):
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    rows = [r for r in cases.documents() if len(r[1] or "") < 20_000]
    docs = cases.table(spark, rows)
    clean = d.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert Counter(str(r["text"]) for r in clean.collect()) == Counter(str(r[1]) for r in rows if not brute(r[1], items())[1])
    cut = d.remove_spans(docs, bench)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    left = {(r["doc_id"], r["k1"], len(words(r["text"]))) for r in cut.collect()}
    assert left == {(r[0], r[7], brute(r[1], items())[0] - brute(r[1], items())[1]) for r in rows}
    by_id = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert by_id[4] == "" and by_id[3] == "one" and by_id[0] is None  # "two words" is an item


def test_empty_tables(spark):
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.contamination(cases.table(spark, []), bench).collect() == []
    got = d.contamination(cases.table(spark), none).collect()
    assert len(got) == len(cases.documents()) and not any(r["contaminated"] for r in got)
    assert d.drop_contaminated(cases.table(spark), none).count() == len(cases.documents())


def test_items_with_one_common_prompt(spark, monkeypatch):
    """The list of a window's items does not travel to the documents, and the result has them all."""
    prompt = " ".join(f"prompt{i}" for i in range(10))
    bench = spark.createDataFrame([(i, f"{prompt} own{i} tail{i}") for i in range(3000)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"x {prompt} y"), (2, "nothing here"), (3, f"{prompt} own7")], "doc_id bigint, text string")
    grams = d.numbered_windows(bench)
    assert "items" not in d.hits(docs, grams).columns
    got = {r["doc_id"]: r for r in d.contamination(docs, bench).collect()}
    assert len(got[1]["items"]) == 3000 and got[2]["items"] == [] and len(got[3]["items"]) == 3000
    assert got[3]["n_hit"] == 11
