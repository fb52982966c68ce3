import random

import numpy as np
import pytest

from tabfid.llm import url_filter as u

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("example.com", "/de/x", "allow"), ("example.com", "/de/x", "block"), (None, "/", "block"), ("b.example.net", "/e", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def brute(url, rules):
    h, p = parts(url)
    best = None
    table = {}
    for rh, rp, v in rules:
        if rh:
            table[(rh, rp)] = "block" if "block" in (v, table.get((rh, rp))) else v
    for (rh, rp), v in table.items():
        if h and (h == rh or h.endswith("." + rh)) and p.startswith(rp):
            best = max(best or (-1,), (len(rh) + len(rp), len(rh), rh + rp, v))
    return (h, p, *(best[2:] if best else (None, "allow")))


def urls():
    rng = random.Random(4)
    hosts = ["a.net", "net", "EXAMPLE.net", "b.example.net", "x.b.example.NET", "example.com", "notexample.com", "fr.org", "ünïcode.org", "", "internet"]
    paths = ["", "/", "/en/", "/en", "/en/1?q=/de/", "/de/x", "/de/xy#/en/", "/fr/a:b://c", "?x", "#/en/", "/e"]
    out = [f"{rng.choice(['http', 'ftp', ''])}://{h}{p}" for h in hosts for p in paths]
    return [*out, None, "", "no scheme", "a.net/", "http://", "http:///x", "x" * 20_000 + "://net/" + "y" * 20_000, "http://a.net/", "http://a.net/"]


@pytest.mark.parametrize("room", [u.MAX_FILE_RULES, 0])
def test_like_brute_force(spark, room):
    """With the mapped file, and joined."""
    rows = [(i, x, "keep") for i, x in enumerate(urls())]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = u.judge_urls(pages, rules, max_file_rules=room).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {i: brute(x, RULES) for i, x, _ in rows}
    assert len(got) == len(rows)


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert [r["verdict"] for r in u.judge_urls(pages, rules, default="block").collect()] == ["block"]
    assert u.judge_urls(pages.limit(0), rules).collect() == []
    with pytest.raises(ValueError):
        u.judge_urls(pages.withColumnRenamed("page_id", "Host"), rules)


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    import pandas as pd
    monkeypatch.setattr(u, "digest", lambda h, p: 7)
    rules = pd.DataFrame([("a", "/", "block", 7), ("b", "/", "allow", 7), ("c", "/x", "block", 7)], columns=["host", "path", "verdict", "key"])
    (tmp_path / "f").write_bytes(u.Digests.pack(rules.astype({"key": np.uint64})))
    m = u.Digests(str(tmp_path / "f"))
    assert m.probe(["a", "q.b", "c", "d"], ["/1", "/", "/", "/"]) == [("a/", "block"), ("b/", "allow"), (None, None), (None, None)]


@pytest.mark.parametrize("most", [1000, 0])
def test_columns_of_the_inner_names_stay(spark, most):
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([("http://a.net/x", 7, "b"), (None, 8, "c")], "url string, __p int, b string")
    got = u.judge_urls(pages, rules, max_file_rules=most).orderBy("__p").collect()
    assert [(r["__p"], r["b"], r["rule"], r["verdict"]) for r in got] == [(7, "b", "net/", "block"), (8, "c", None, "allow")]
