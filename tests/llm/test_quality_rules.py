import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabfid.llm import quality_rules as q

from . import cases


def expected(text):
    w = cases.SPACE_WORDS.findall(text or "")
    n = len(w)
    seen = Counter(tuple(w[i:i + 8]) for i in range(n - 7))
    cov = {p for i in range(n - 7) if seen[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if cases.SPACE_WORDS.search(x)]
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cov),
            n < 20 or 100 * len(cov) > 30 * n)


def rates(text):
    n, chars, symbols, dup, repeat, _ = expected(text)
    lines = max(1, sum(bool(cases.SPACE_WORDS.search(x)) for x in (text or "").split("\n")))
    m = max(n, 1)
    return symbols * 1000 // m, dup * 1000 // lines, repeat * 1000 // m, chars * 100 // m


def fences(values, wider=None, share=0):
    """(rows, positive rows) and the numbers of one level, blended with the wider one's."""
    edges = sorted(v >> max(v.bit_length() - 6, 0) << max(v.bit_length() - 6, 0) for v in values)
    n, above = len(edges), [e for e in edges if e]
    out = [edges[-(-i * n // 4) - 1] for i in (1, 2, 3)]
    w = above[max(-(-share * len(above) // 100), 1) - 1] if above else 0
    if wider is None:
        return [*out, len(above) * w // (len(above) + 20)]
    mix = lambda x, y, c: (c * x + 200 * y) // (c + 200)
    return [*[mix(x, y, n) for x, y in zip(out, wider)], mix(w, wider[3], len(above))]


def verdicts(rows):
    """Whether each row (doc_id, text, lang, source) stays, from the stated rules."""
    every = [rates(r[1]) for r in rows]
    ok = [not expected(r[1])[-1] for r in rows]
    for k, (two, share) in enumerate([(False, 10), (False, 75), (False, 30), (True, 0)]):
        whole = fences([v[k] for v in every], None, share)
        for lang in {r[2] for r in rows}:
            here = [i for i, r in enumerate(rows) if r[2] == lang]
            wide = fences([every[i][k] for i in here], whole, share)
            for source in {rows[i][3] for i in here}:
                own = [i for i in here if rows[i][3] == source]
                q1, q2, q3, w = fences([every[i][k] for i in own], wide, share)
                far = max(3 * (q3 - q1), q2 // 4 if two else w)
                for i in own:
                    ok[i] &= (q1 - far if two else 0) <= every[i][k] <= q3 + far
    return ok


def test_verdicts_of_edge_rows(spark):
    rows = [r[:4] for r in cases.documents()]
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["kept"]) for r in q.quality_report(cases.table(spark)).collect())
    assert got == Counter((r[0], *expected(r[1])[:2], k) for r, k in zip(rows, verdicts(rows)))


@pytest.mark.parametrize("rule,odd", [
    ("symbol_rate", "# $ ".join(f"word{i}" for i in range(60))),
    ("dup_line_rate", "\n".join([*[f"line number {i} of the text" for i in range(20)], *["once more"] * 8])),
    ("repeat_rate", " ".join([*[f"w{i}" for i in range(48)], *[f"w{i}" for i in range(8)]])),
    ("word_length", " ".join("long" * 6 + str(i) for i in range(60)))])
def test_each_rate_alone_rejects_what_the_base_keeps(spark, rule, odd):
    rng = __import__("random").Random(9)
    rows = [(i, cases.sentence(rng, 60, 10_000), "en", "a", 1, "", "", "", "") for i in range(400)]
    rows.append((1000, odd, "en", "a", 1, "", "", "", ""))
    got = {r["doc_id"]: r for r in q.quality_report(cases.table(spark, rows)).collect()}
    assert (got[1000]["base_failed"], got[1000]["failed_rule"], got[1000]["kept"]) == (False, rule, False)
    assert all(got[i]["kept"] for i in range(400))


def test_small_groups_follow_their_language(spark):
    """One more or one less row moves a cutoff a little and never switches the rule."""
    rng = __import__("random").Random(9)
    rows = [(i, cases.sentence(rng, 60, 10_000), "en", "a" if i % 2 else "b", 1, "", "", "", "") for i in range(500)]
    rows += [(1000 + i, cases.sentence(rng, 60, 10_000).replace(" ", " | "), "en", "c", 1, "", "", "", "") for i in range(600)]
    for few in (1, 199, 200, 201, 600):
        got = {r["doc_id"]: r for r in q.quality_report(cases.table(spark, rows[:500 + few])).collect()}
        kept = [got[1000 + i]["kept"] for i in range(few)]
        assert kept == verdicts([r[:4] for r in rows[:500 + few]])[500:]
        assert len(set(kept)) == 1 and kept[0] == (few > 1)
        assert all(got[i]["kept"] for i in range(500))


def test_signals_of_edge_rows(spark):
    got = q.quality_report(cases.table(spark)).collect()
    rows = [tuple(r[c] for c in ("doc_id", *q.SIGNALS, "base_failed")) for r in got]
    want = [(r[0], *expected(r[1])) for r in cases.documents()]
    assert Counter(rows) == Counter(want)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_empty_table(spark):
    empty = cases.table(spark, [])
    assert q.quality_report(empty).collect() == []
    assert q.quality_filter(empty).columns == empty.columns
    assert q.quality_filter(empty).collect() == []


def corpus(spark):
    clean = [(i, cases.sentence(__import__("random").Random(i), 60, 10_000), "en", "a", 1, "", "", "", "") for i in range(300)]
    odd = [(1000 + i, "### ".join(cases.sentence(__import__("random").Random(i), 60).split()), "en", "a", 1, "", "", "", "")
           for i in range(20)]
    # a source where symbols are usual: its own cutoff lets them pass
    usual = [(2000 + i, t[1].replace(" ", " | "), "en", "code", 1, "", "", "", "") for i, t in enumerate(clean)]
    return cases.table(spark, clean + odd + usual)


def test_cutoffs_adapt_to_the_source(spark):
    got = {r["doc_id"]: r for r in q.quality_report(corpus(spark)).collect()}
    assert all(got[i]["kept"] for i in range(300))
    assert not any(got[1000 + i]["kept"] for i in range(20)) and got[1000]["failed_rule"] == "symbol_rate"
    assert all(got[2000 + i]["kept"] for i in range(300))


@pytest.mark.parametrize("groups", [0, 100])
def test_both_joins_and_the_filter_agree(spark, groups):
    docs = corpus(spark).unionByName(cases.table(spark))
    report = q.quality_report(docs, broadcast_groups=groups)
    kept = q.quality_filter(docs, broadcast_groups=groups)
    assert kept.columns == docs.columns
    assert Counter(r[0] for r in kept.select("doc_id").collect()) == Counter(
        r[0] for r in report.filter("kept").select("doc_id").collect())
    assert kept.count() > 500


def test_sketches_merge(spark):
    rows = q.signals(corpus(spark))
    whole = q.sketches(rows, "lang", "source", "signals")
    parts = [q.sketches(rows.filter(F.col("doc_id") % 3 == k), "lang", "source", "signals") for k in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(
        "lang_key", "source_key", "rate", "bucket").agg(F.sum("n").alias("n"))
    assert Counter(whole.collect()) == Counter(merged.select(whole.columns).collect())
