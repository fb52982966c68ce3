import random
from collections import Counter, defaultdict

from tabfid.llm import minhash

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = cases.SPACE_WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Counter of (doc_id, n_shingles, component_id)."""
    sets = list({shingle_set(t) for _, t in rows} - {frozenset()})
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[:i]:
            common = len(a & b)
            if 100 * common >= 75 * (len(a) + len(b) - common):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for d, t in rows:
        s = shingle_set(t)
        if s and d is not None:
            ids[find(s)].append(d)
    out = Counter()
    for d, t in rows:
        s = shingle_set(t)
        out[(d, len(s), min(ids[find(s)], default=None) if s else d)] += 1
    return out


def check(spark, docs, rows):
    got = minhash.linked_components(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return got


def test_edge_rows(spark):
    check(spark, cases.table(spark), [r[:2] for r in cases.documents()])
    assert minhash.linked_components(cases.table(spark, [])).collect() == []


def test_groups_of_near_copies_with_outliers(spark, monkeypatch):
    """Large groups whose members differ more and more from the first: small and crowded buckets."""
    rng = random.Random(11)
    rows = []
    for g in range(6):
        base = cases.sentence(rng, 80, 3000).split()
        for k in range(40):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for small in (2, 16, 1000):
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "PER_SALT", 7)
        check(spark, docs, rows)


def test_template_texts_are_not_linked(spark):
    """Texts that share over half of their shingles collide in many bands but stay apart."""
    rng = random.Random(2)
    frame = cases.sentence(rng, 60, 5000)
    rows = [(i, frame + " " + cases.sentence(rng, 40, 10 ** 6)) for i in range(120)]
    rows += [(1000, rows[3][1] + " tail")]
    check(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_one_of_each_group_stays(spark):
    docs = cases.table(spark)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = brute([r[:2] for r in cases.documents()])
    want = Counter({(d, n): k if n == 0 else 1 for (d, n, c), k in groups.items() if d == c})
    assert Counter((r["doc_id"], len(shingle_set(r["text"]))) for r in kept.collect()) == want


def test_repeated_rows_and_rows_without_ids_leave_one(spark):
    rng = random.Random(8)
    a, b, c = (cases.sentence(rng, 80, 5000) for _ in range(3))
    rows = [(5, a)] * 3 + [(9, a + " tail")] * 2 + [(None, b)] * 3 + [(7, c), (7, c + " end"), (7, c), (8, None), (8, None)]
    docs = spark.createDataFrame([(*r, str(i)) for i, r in enumerate(rows)], "doc_id bigint, text string, extra string").repartition(4)
    kept = minhash.drop_near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]) for r in kept)) == ["5", "7", "8", "8", "None"]
    assert {r["text"] for r in kept if r["doc_id"] in (5, None)} == {a, b}


def test_chain_of_links(spark):
    """Each text is near its neighbour only: the component runs along the chain."""
    words = [f"c{i}" for i in range(600)]
    rows = [(i, " ".join(words[i * 6:i * 6 + 100])) for i in range(60)]
    got = check(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), rows)
    assert {r["component_id"] for r in got} == {0}


def test_templates_do_not_meet_pair_by_pair(spark, monkeypatch):
    """Texts that share three quarters of their shingles with all others, but are no links, make no pairs."""
    rng = random.Random(11)
    frame = cases.sentence(rng, 124, 10 ** 6)
    rows = [(i, f"{frame} {cases.sentence(rng, 40, 10 ** 6)}") for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    made = []
    plain = minhash._prefix_pairs
    monkeypatch.setattr(minhash, "_prefix_pairs", lambda *a: made.append(plain(*a).distinct().count()) or plain(*a))
    monkeypatch.setattr(minhash, "SMALL", 2)
    check(spark, docs, rows)
    assert made and all(n <= 20 for n in made), made
