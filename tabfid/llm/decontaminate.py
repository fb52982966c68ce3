"""Benchmark decontamination: word windows of the benchmark's items against all documents.

Texts are normalised to words (A-Z in lower case; runs of digits, letters a-z and non-ASCII
characters).  An item's windows are all its runs of 10 words; an item of fewer words, but not none,
is one window.  The distinct windows with their 64-bit hashes are broadcast as a hash set; each
document's windows are hashed, probed and, where a hash is found, compared word for word.  Hits are
summed up per document: words covered, items met.  All of it is DataFrame functions.

The set is broadcast up to ``MAX_SET_BYTES`` of window text (measured first); a larger one is joined
by a shuffle on the hash, with the same result.

A row is known by 128 bits of hash over doc_id and text, so null and repeated doc_ids do no harm.
Edge cases: null and empty texts have no words, no hits and no windows; items with a null id or
without words are left out; repeated rows are judged alike, repeated items count once; an empty
benchmark hits nothing; other columns pass through the two filters untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabfid.llm.common import fresh, shared_table, window_hashes

WINDOW = 10
#: Fixed value: what separates words, after A-Z are in lower case.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_SET_BYTES = 64 * 2**20


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BREAK), "")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """(size, hash, gram, items): each distinct window with the sorted ids of its items."""
    w = items.select(F.col(item_id).cast("string").alias("item_id"), plain_words(F.col(text)).alias("w")).filter(
        F.col("item_id").isNotNull() & (F.size("w") > 0))
    size = F.least(F.size("w"), F.lit(n))
    grams = w.select("item_id", size.alias("size"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("gram"))
    # the hash that window_hashes gives a run of this size
    by_size = reduce(lambda c, k: c.when(F.col("size") == k, F.get(window_hashes(F.col("gram"), k), F.lit(0))),
                     range(1, n + 1), F.when(F.lit(False), F.lit(0).cast("long")))
    return grams.groupBy("size", by_size.alias("hash"), F.array_join("gram", " ").alias("gram")).agg(
        F.sort_array(F.collect_set("item_id")).alias("items"))


def _row_key(doc_id: str, text: str) -> list[Column]:
    return [F.xxhash64(F.col(doc_id), F.col(text)), F.xxhash64(F.col(text), F.lit(1), F.col(doc_id))]


def hits(docs: DataFrame, grams: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, at, size, gid): windows of ``grams`` (from ``numbered_windows``) in the documents; ``at`` counts words from 0.

    Only the windows travel to the documents; the items of a window are joined to its hits."""
    have = grams.groupBy("size").agg(F.sum(F.length("gram")).alias("chars"), F.count(F.lit(1)).alias("n")).collect()  # at most 10 rows
    small = sum(r["chars"] * 4 + r["n"] * 64 for r in have) <= MAX_SET_BYTES
    k1, k2 = _row_key(doc_id, text)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), plain_words(F.col(text)).alias("w"))
    out = []
    for r in have:
        own = grams.filter(F.col("size") == r["size"]).select("hash", "gram", "gid")
        # the hashes are a column of their own: so the generator, the probe and the comparison are one
        # compiled stage, which carries the words of a text by reference and copies them for no window.
        # "outer" keeps Spark from adding a filter on the hashes' number, which would hash all twice;
        # the null that a text without windows gets meets nothing
        near = rows.withColumn("hashes", window_hashes(F.col("w"), r["size"])).select(
            "k1", "k2", "w", F.posexplode_outer("hashes").alias("at", "hash"))
        said = F.array_join(F.slice("w", F.col("at") + 1, r["size"]), " ")
        if not small:  # words would be shuffled with every window: their text is made before
            near = near.select("k1", "k2", "at", "hash", said.alias("said"))
            said = F.col("said")
        met = near.join(F.broadcast(own) if small else own, "hash")
        # equality, written so that it is tested after the hash and does not become a join key
        met = met.filter(said.startswith(F.col("gram")) & F.col("gram").startswith(said))
        out.append(met.select("k1", "k2", "at", F.lit(r["size"]).alias("size"), "gid"))
    if not out:
        return docs.sparkSession.createDataFrame([], "k1 bigint, k2 bigint, at int, size int, gid bigint")
    return reduce(DataFrame.unionByName, out)


def numbered_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """``item_windows`` with a number ``gid`` of each window, as a written table."""
    return shared_table(item_windows(items, item_id, text, n).withColumn("gid", F.monotonically_increasing_id()), "grams")


def _spans(found: DataFrame) -> DataFrame:
    """(k1, k2, spans): per document the sorted distinct spans."""
    return found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("spans"))


def _per_row(found: DataFrame, grams: DataFrame) -> DataFrame:
    """(k1, k2, spans, items): per document the sorted distinct spans and items."""
    found = shared_table(found, "hits")
    said = found.select("k1", "k2", "gid").distinct().join(grams.select("gid", F.explode("items").alias("item")), "gid")
    items = said.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return _spans(found).join(items, ["k1", "k2"])


def covered(spans: Column) -> Column:
    """Number of words inside sorted spans."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    return F.aggregate(spans, start, lambda s, x: F.struct(
        F.greatest(s["upto"], x["at"] + x["size"]).alias("upto"),
        (s["n"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(s["upto"], x["at"]))).alias("n")), lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit``, ``spans`` (of words), ``items``, ``contaminated``."""
    grams = numbered_windows(benchmark)
    per = _per_row(hits(docs, grams, doc_id, text), grams)
    k1, k2 = _row_key(doc_id, text)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.size(plain_words(F.col(text))).cast("long").alias("n_words"),
                       k1.alias("k1"), k2.alias("k2"))
    j = slim.join(per, ["k1", "k2"], "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<at:int,size:int>>"))
    return j.select("doc_id", "n_words", covered(spans).cast("long").alias("n_hit"), spans.alias("spans"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    F.col("spans").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any hit, with all their columns."""
    a, b = fresh(docs, "k1", "k2")
    bad = hits(docs, numbered_windows(benchmark), doc_id, text).select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    k1, k2 = _row_key(doc_id, text)
    return docs.withColumns({a: k1, b: k2}).join(bad, [a, b], "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents; in those with hits, the hit words and what separates them from the next word are taken out of ``text``."""
    a, b, sp, pre, parts, kept = fresh(docs, "k1", "k2", "spans", "head", "parts", "kept")
    per = _spans(hits(docs, numbered_windows(benchmark), doc_id, text)).select(
        F.col("k1").alias(a), F.col("k2").alias(b), F.col("spans").alias(sp))
    k1, k2 = _row_key(doc_id, text)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    j = docs.withColumns({a: k1, b: k2}).join(per, [a, b], "left")
    hit = F.flatten(F.transform(sp, lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))
    j = j.withColumn(parts, F.when(F.col(sp).isNotNull(), F.regexp_extract_all(
        F.col(text), F.lit(f"{word}[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"), F.lit(0))))
    j = j.withColumn(kept, F.when(F.size(parts) > 0, F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), hit)))
    j = j.withColumn(pre, F.regexp_extract(F.col(text), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0))
    rebuilt = F.concat(F.col(pre), F.array_join(F.transform(kept, lambda i: F.get(F.col(parts), i)), ""))
    return j.withColumn(text, F.when(F.col(sp).isNull(), F.col(text)).otherwise(rebuilt)).select(*docs.columns)
