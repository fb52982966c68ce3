"""Near duplicates by min-max hashing.

A text's words (between ASCII white space, A-Z in lower case) give its set of distinct 5-word
shingles, as 64-bit hashes; fewer words are one shingle.  Under each of 64 permutations both the
minimum and the maximum over the set are kept: 128 values from 64 evaluations, each of which agrees
between two sets with probability equal to their similarity.  They make 32 bands of 4.  Two
sets of similarity 0.75 share no band with probability 5e-6.

Rows with equal sets are one class, found by a 128-bit digest of the set; all else is between
classes.  Candidates are confirmed on the full sets (100 * common >= 75 * united):

1. in each bucket (band and value) every class is compared with the bucket's first class;
2. confirmed links give components.  In a bucket whose classes are still in several components,
   all pairs across components are compared if it has up to ``SMALL`` classes (a bounded number per
   class).  Classes of larger ones are compared exactly by a prefix filter: sets of similarity 0.75
   share a shingle among the rarest quarter of either, so pairs meet on those shingles only.
   Classes whose distances to the bucket's first class differ by more than 0.25 cannot be linked.

So no bucket is expanded into all its pairs, and no link but those that no band shows is lost.

Edge cases: null, empty and blank texts have no shingles and are linked with nothing; a null doc_id
is never the smallest of a component that has another id; repeated rows are members of one class
and share its component.  ``drop_near_duplicates`` leaves one row of each component, also where rows are
repeated, share an id or have none; rows without shingles all stay; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfid.llm.common import fresh, join_heavy, shared_table

SHINGLE, PERMUTATIONS, BAND = 5, 64, 4
LEAST = 75  # hundredths of similarity
SMALL = 16
LANES = 8
#: Ratio of neighbouring size classes in the join of rare shingles.
SIZE_STEP = 1.1
#: A class is compared with so many others per task row group; more are dealt to further tasks.
PER_SALT = 1_000
BLOCK = 4_096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(20_240_229)
_PLACE = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IN_BAND = _rng.integers(0, 2**63, 2 * PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

CLASS = "f1 bigint, f2 bigint"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    k = min(n, SHINGLE)
    h = w[:n - k + 1] * _PLACE[0]
    for j in range(1, k):
        h = h + w[j:n - k + 1 + j] * _PLACE[j]
    return np.unique(_mix(h + np.uint64(k)))


def signature(s: np.ndarray) -> np.ndarray:
    """Band keys of a non-empty set: the minima and maxima under each permutation, 4 to a key."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(s), BLOCK):
        v = s[at:at + BLOCK, None] * _MUL + _ADD
        np.minimum(low, v.min(axis=0), out=low)
        np.maximum(high, v.max(axis=0), out=high)
    v = (np.concatenate([low, high]) * _IN_BAND).reshape(-1, BAND).sum(axis=1, dtype=np.uint64)
    return _mix(v + np.arange(len(v), dtype=np.uint64))


def _signatures(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        s = shingles(t)
        if not len(s):
            out.append((0, None, None, None))
            continue
        d = xxhash.xxh128_digest(s.tobytes())
        f = np.frombuffer(d, np.int64)
        out.append((len(s), int(f[0]), int(f[1]), signature(s).view(np.int64)))
    return pd.DataFrame(out, columns=["n", "f1", "f2", "bands"]).astype({"n": "int64", "f1": "Int64", "f2": "Int64"})


def _set_bytes(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)


def signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, tkey, n, f1, f2, bands) of every row, as a written table."""
    s = F.pandas_udf(_signatures, "n bigint, f1 bigint, f2 bigint, bands array<bigint>")(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("tkey"), s.alias("s"))
    return shared_table(rows.select("doc_id", "tkey", "s.*"), "signed")


def _both(df: DataFrame, side: str) -> DataFrame:
    return df.withColumnsRenamed({"f1": f"{side}1", "f2": f"{side}2"})


def _overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted so that a lead's set comes before those compared with it: common shingles of each."""
    lead, own = None, np.empty(0, np.uint64)
    for b in batches:
        out = []
        for a1, a2, b1, b2, s in zip(b["a1"], b["a2"], b["b1"], b["b2"], b["shingles"], strict=True):
            s = np.frombuffer(s, np.uint64)
            if (a1, a2) == (b1, b2):
                lead, own = (a1, a2), s
                continue
            if (a1, a2) != lead:
                raise ValueError("a lead's set is missing")
            big, few = (own, s) if len(own) >= len(s) else (s, own)
            at = np.minimum(np.searchsorted(big, few), len(big) - 1)
            out.append((a1, a2, b1, b2, int((big[at] == few).sum()), len(own), len(s)))
        yield pd.DataFrame(out, columns=["a1", "a2", "b1", "b2", "common", "na", "nb"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2, distance, linked) of distinct pairs, by their full sets; a written table.

    Each lead ``a`` is sent once to each task that compares it, with up to about ``PER_SALT`` others.
    """
    n = F.count(F.lit(1))
    leads = pairs.groupBy("a1", "a2").agg(F.ceil(n / PER_SALT).cast("int").alias("salts"), n.alias("many"))
    salted = join_heavy(pairs, leads, ["a1", "a2"], "many").select(
        "a1", "a2", F.pmod(F.xxhash64("b1", "b2"), "salts").cast("int").alias("salt"), "b1", "b2")
    own = leads.select("a1", "a2", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                       F.col("a1").alias("b1"), F.col("a2").alias("b2"))
    rows = salted.unionByName(own).join(_both(sets, "b"), ["b1", "b2"])
    rows = rows.withColumn("later", (F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2")))
    rows = rows.repartition("a1", "a2", "salt").sortWithinPartitions("a1", "a2", "salt", "later")
    got = rows.select("a1", "a2", "b1", "b2", "shingles").mapInPandas(
        _overlaps, "a1 bigint, a2 bigint, b1 bigint, b2 bigint, common bigint, na bigint, nb bigint")
    united = F.col("na") + F.col("nb") - F.col("common")
    return shared_table(got.select("a1", "a2", "b1", "b2", (1 - F.col("common") / united).alias("distance"),
                                   (F.col("common") * 100 >= united * LEAST).alias("linked")), "compared")


def components(links: DataFrame) -> DataFrame:
    """(f1, f2, root): the smallest class that each linked class reaches, over any number of links.

    Every round takes the smallest root among the neighbours and then the root's root, and writes
    its table; it ends when a round changes nothing.
    """
    a, b = F.struct(F.col("a1").alias("f1"), F.col("a2").alias("f2")), F.struct(F.col("b1").alias("f1"), F.col("b2").alias("f2"))
    edges = shared_table(links.select(a.alias("x"), b.alias("y")).union(links.select(b, a)).distinct(), "edges")
    roots = shared_table(edges.groupBy("x").agg(F.least("x", F.min("y")).alias("root")), "roots")
    while True:
        near = edges.join(roots.withColumnsRenamed({"x": "y", "root": "r"}), "y").groupBy("x").agg(F.min("r").alias("r"))
        step = roots.join(near, "x").select("x", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        hop = step.select(F.col("x").alias("root"), F.col("root").alias("next"))
        new = shared_table(step.join(hop, "root").select("x", F.col("next").alias("root"), "was"), "roots")
        roots = new.select("x", "root")
        if new.filter(F.col("root") != F.col("was")).isEmpty():
            return roots.select("x.f1", "x.f2", "root")


def _with_root(df: DataFrame, roots: DataFrame) -> DataFrame:
    own = F.struct("f1", "f2")
    return df.join(roots, ["f1", "f2"], "left").withColumn("root", F.coalesce("root", own))


def _crossing(members: DataFrame, roots: DataFrame, seen: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Distinct pairs of classes in different components that may still be linked; None if there are none."""
    m = _with_root(members, roots)
    open_ = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                 F.count(F.lit(1)).alias("many")).filter("lo != hi").select("key", "many")
    m = shared_table(join_heavy(m, open_, ["key"], "many"), "open")
    if m.isEmpty():
        return None
    small = m.filter(F.col("many") <= SMALL)
    left = small.select("key", F.col("f1").alias("a1"), F.col("f2").alias("a2"), F.col("root").alias("ra"))
    right = small.select("key", F.col("f1").alias("b1"), F.col("f2").alias("b2"), F.col("root").alias("rb"))
    before = F.struct("a1", "a2") < F.struct("b1", "b2")
    pairs = left.join(right, "key").filter(before & (F.col("ra") != F.col("rb"))).select("a1", "a2", "b1", "b2")
    # larger buckets: distances to the first class tell which members can have a link to another component
    big = m.filter(F.col("many") > SMALL)
    lead = big.groupBy("key").agg(F.min(F.struct("f1", "f2", "root")).alias("lead"), F.count(F.lit(1)).alias("of"))
    d = join_heavy(big, lead, ["key"], "of").select("key", "f1", "f2", "root", F.col("lead.f1").alias("a1"), F.col("lead.f2").alias("a2"),
                                     F.col("lead.root").alias("ra"))
    d = d.join(seen.select("a1", "a2", F.col("b1").alias("f1"), F.col("b2").alias("f2"), "distance"),
               ["a1", "a2", "f1", "f2"], "left").fillna({"distance": 0.0})
    other = F.min(F.when(F.col("root") != F.col("ra"), F.col("distance"))).alias("nearest")
    d = shared_table(d, "distances")
    d = join_heavy(d, d.groupBy("key").agg(other, F.count(F.lit(1)).alias("of")), ["key"], "of").filter(
        (F.col("root") != F.col("ra")) | (F.col("distance") >= F.col("nearest") - 0.25 - 1e-9))
    crowded = shared_table(d.select("f1", "f2", "root").distinct(), "crowded")
    if not crowded.isEmpty():
        pairs = pairs.unionByName(_prefix_pairs(crowded, sets))
    pairs = pairs.distinct().join(seen, ["a1", "a2", "b1", "b2"], "left_anti")
    return shared_table(pairs, "pairs")


def _longs(b: pd.Series) -> pd.DataFrame:
    """Shingles, and a bitmap of ``64 * LANES`` bits where every shingle flips one."""
    sets = [np.frombuffer(x, np.uint64) for x in b]
    odd = [np.bincount((s >> np.uint64(17)) % np.uint64(64 * LANES), minlength=64 * LANES) & 1 for s in sets]
    return pd.DataFrame({"s": [s.view(np.int64) for s in sets],
                         "bits": [np.packbits(o.astype(np.uint8)).view(np.int64) for o in odd]})


def _prefix_pairs(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs across components that share one of the rarest shingles of either: no link is missed.

    In the order from rare to frequent, linked sets have their first common shingle so early in both
    that what follows can still hold 75/175 of their sizes' sum.  And they differ in at most 25/175 of
    that sum, which bounds from above the number of places where their bitmaps differ.  Only meetings
    that both allow make a pair.
    """
    udf = F.pandas_udf(_longs, "s array<bigint>, bits array<bigint>")
    each = classes.join(sets, ["f1", "f2"]).select("f1", "f2", "root", udf("shingles").alias("u")).select("f1", "f2", "root", "u.*")
    long = each.select("f1", "f2", F.struct("root", "bits").alias("r"), F.size("s").alias("n"), F.explode("s").alias("h"))
    count = long.groupBy("h").agg(F.count(F.lit(1)).alias("of"), F.min("r.root").alias("lo"), F.max("r.root").alias("hi"))
    ranked = long.join(count.filter("lo != hi").select("h", "of"), "h").groupBy("f1", "f2", "r", "n").agg(
        F.sort_array(F.collect_list(F.struct("of", "h"))).alias("s"))
    # shingles that no second component has come first in the order and meet nothing; ``rest`` counts
    # the others from a place on
    shared = F.size("s")
    upto = F.col("n") - F.ceil(F.col("n") * LEAST / 100) + 1 - (F.col("n") - shared)
    pre = shared_table(ranked.filter(upto > 0).select(
        "f1", "f2", F.col("r.root").alias("root"), F.col("r.bits").alias("bits"), "n", shared.alias("shared"),
        F.posexplode(F.slice("s", F.lit(1), upto.cast("int"))).alias("at", "p")).select(
        "f1", "f2", "root", "bits", "n", (F.col("shared") - F.col("at")).alias("rest"), F.col("p.h").alias("h")), "prefix")
    # the smaller set of a pair goes to the size classes that its rest allows its partner, the larger one to its own: sets
    # that share much of a template, but too little for a link, meet nobody
    most = F.least(F.floor(F.col("n") * 100 / LEAST), F.floor(F.col("rest") * (100 + LEAST) / LEAST) - F.col("n"))
    step = lambda n: F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP)).cast("int")
    names = pre.columns[:-1]
    x = pre.filter(most >= F.col("n")).select("h", F.explode(F.sequence(step(F.col("n")), step(most))).alias("sizes"), *[
        F.col(c).alias(n) for c, n in zip(names, ("a1", "a2", "ra", "bitsa", "na", "resta"), strict=True)])
    y = pre.select("h", step(F.col("n")).alias("sizes"), *[
        F.col(c).alias(n) for c, n in zip(names, ("b1", "b2", "rb", "bitsb", "nb", "restb"), strict=True)])
    room = F.least("resta", "restb") * (100 + LEAST) >= (F.col("na") + F.col("nb")) * LEAST
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * LEAST
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.get("bitsa", F.lit(k)).bitwiseXOR(F.get("bitsb", F.lit(k)))) for k in range(LANES)])
    close = differ * (100 + LEAST) <= (F.col("na") + F.col("nb")) * (100 - LEAST)
    one, two = (F.struct(F.col(f"{c}1").alias("f1"), F.col(f"{c}2").alias("f2")) for c in "ab")
    once = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (one < two))
    met = x.join(y, ["h", "sizes"]).filter(once & (F.col("ra") != F.col("rb")) & sizes & room & close)
    met = met.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    return met.select(F.col("a.f1").alias("a1"), F.col("a.f2").alias("a2"), F.col("b.f1").alias("b1"), F.col("b.f2").alias("b2"))


def linked_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, kept), one row for each row of ``docs``."""
    return _labelled(docs, doc_id, text).drop("root")


def _labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``linked_components`` with ``root``, the first class of the component (null without shingles)."""
    rows = signed(docs, doc_id, text)
    some = rows.filter("n > 0")
    classes = some.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "tkey")).alias("rep"))
    buckets = some.select("f1", "f2", "bands").dropDuplicates(["f1", "f2"]).select("f1", "f2", F.explode("bands").alias("key"))
    multi = buckets.groupBy("key").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).filter("lo != hi").select("key")
    members = shared_table(buckets.join(multi, "key"), "members")
    lead = members.groupBy("key").agg(F.min(F.struct("f1", "f2")).alias("a"), F.count(F.lit(1)).alias("many"))
    pairs = shared_table(join_heavy(members, lead, ["key"], "many").filter(F.col("a") != F.struct("f1", "f2")).select(
        F.col("a.f1").alias("a1"), F.col("a.f2").alias("a2"), F.col("f1").alias("b1"), F.col("f2").alias("b2")).distinct(), "pairs")
    need = members.select("f1", "f2").distinct().join(classes.select("f1", "f2", "rep"), ["f1", "f2"])
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tkey"))
    need = need.select("f1", "f2", F.col("rep.doc_id").alias("rid"), F.col("rep.tkey").alias("tkey"))
    chosen = keyed.join(need, "tkey").filter(F.col("id").eqNullSafe(F.col("rid"))).select("f1", "f2", "text")
    sets = shared_table(chosen.select("f1", "f2", F.pandas_udf(_set_bytes, "binary")("text").alias("shingles"))
                        .dropDuplicates(["f1", "f2"]), "sets")
    seen = compared(pairs, sets)
    roots = components(seen.filter("linked"))
    more = _crossing(members, roots, seen, sets)
    if more is not None and not more.isEmpty():
        again = compared(more, sets)
        roots = components(seen.unionByName(again).filter("linked"))
    of = _with_root(classes.select("f1", "f2", "first"), roots)
    whole = of.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = of.join(whole, "root").select("f1", "f2", "root", "component_id")
    out = rows.join(ids, ["f1", "f2"], "left").withColumn(
        "component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "tkey", F.col("n").alias("n_shingles"), "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "root")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with the smallest doc_id, with all its columns.

    Where several rows have that id (repeated rows, or no id at all), those of one text are found and one of
    them is taken; only such rows are shuffled with their texts.
    """
    i, k = fresh(docs, "id", "tkey")
    rows = shared_table(_labelled(docs, doc_id, text).select(F.struct("doc_id").alias(i), F.col("tkey").alias(k), "root", "kept"), "labels")
    stay = rows.filter(F.col("kept") & F.col("root").isNotNull())
    several = stay.groupBy("root").agg(F.count(F.lit(1)).alias("many"), F.min(k).alias("one")).filter("many > 1").select("root", "one")
    more = shared_table(stay.join(several, "root").select(i, k, (F.col(k) == F.col("one")).alias("first")).distinct(), "several")
    gone = rows.filter(~F.col("kept")).select(i, k).unionByName(more.filter(~F.col("first")).select(i, k)).distinct()
    keyed = docs.withColumns({i: F.struct(F.col(doc_id).alias("doc_id")), k: F.xxhash64(F.col(text))})
    left = keyed.join(gone, [i, k], "left_anti")
    once = more.filter("first").select(i, k)
    if not once.isEmpty():
        left = left.join(once, [i, k], "left_anti").unionByName(left.join(once, [i, k], "left_semi").dropDuplicates([i, k]))
    return left.select(*docs.columns)
