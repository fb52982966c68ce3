"""Spelling variants: words that differ by one letter, by a dictionary of trie-node pairs.

Words are put into two tries, one from the front and one from the back, and the nodes of both are
numbered.  A word with its i-th letter skipped is then a pair of numbers (node of the letters before i,
node of the letters after i), whatever its length, and a word with a place for one more letter is
the pair (node of the letters before the place, node of those after it).  Two words with the same skipped pair
differ by one replaced letter; a skipped pair that equals another word's inserted pair is a deleted
(inserted) letter.  Equal pairs are the only meetings, so every near pair is found and no other.

Numbering: words are range-sorted; each range walks its words and numbers a node where it first appears.
The path to the last word of a range may go on in the next one: its nodes are numbered by that range
and their depth, so every range can name them from the list of first and last words, one entry per
range, which is all the driver sees.  Numbers of words follow their order, so ties need no text.

Deleting any letter of a run of equal letters gives the same word; only the first is used, so a near
pair meets once.  A pair of nodes has at most one word per letter and one without a letter (the words
agree elsewhere), so its members are a short list; each member gets from it how many there are and which
is the most frequent, not a row for each other member.

Edge cases: a null text has no words; a null doc_id counts as an empty string in the deletion hash;
repeated rows count again; words of any length take one pair per letter; without words that are frequent
enough there are no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabfid.llm.common import shared_table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: One of so many (document, run) pairs loses a letter.
TYPO = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Different words a task counts before it hands them on.
HELD = 200_000
#: Words of a range, about.
RANGE = 50_000
#: A node's number: its range, then its place in it; the upper half of the places are the path to the last word.
PLACES = 40


def _count(least: int, typo: int):
    run = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": list(held), "n": list(held.values())})
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"]):
                for word, n in Counter(run.findall(text.translate(LOWER))).items():
                    h = zlib.crc32(f"{doc}:{word}".encode()) if typo else 1
                    if typo and h % typo == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()
    return counted


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n): lower-cased runs of letters of at least ``least_length`` letters and ``least_count`` occurrences.

    All occurrences of a run in the document of ``doc_id`` whose hash ``typo`` divides lose a letter (0: none).
    Every task counts its words first.
    """
    d = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    some = d.mapInPandas(_count(least_length, typo), "word string, n bigint")
    return some.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _number(ranges: list[tuple[int, str, str]]):
    """Numbers the nodes on the paths of a range's sorted words.  ``ranges``: (number, first, last word) in order."""
    numbers, lasts = [r[0] for r in ranges], [r[2] for r in ranges]
    place = {r: i for i, r in enumerate(numbers)}

    def owner(prefix: str, before: int) -> int | None:
        """First range before place ``before`` whose last word has the prefix."""
        i = bisect_left(lasts, prefix, 0, before)
        return numbers[i] if i < before and lasts[i].startswith(prefix) else None

    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        at, half = place[part], 1 << (PLACES - 1)
        base, last = part << PLACES, lasts[at]
        words = d.sort_values("key")
        path, before, count, out = [], None, 0, []
        for word in words["key"]:
            keep = 0 if before is None else _shared(before, word) + 1
            path, before = path[:keep], word
            on_last = _shared(word, last)
            carried = -1 if not at else _shared(word, lasts[at - 1])
            for depth in range(len(path), len(word) + 1):
                home = owner(word[:depth], at) if depth <= carried else None
                if home is not None:
                    path.append((home << PLACES) + half + depth)
                elif depth <= on_last:
                    path.append(base + half + depth)
                else:
                    path.append(base + count)
                    count += 1
            out.append(list(path))
        return pd.DataFrame({"word": words["word"], "n": words["n"], "rank": [base + i for i in range(len(out))], "nodes": out})
    return run


def trie_nodes(words: DataFrame, key, name: str) -> DataFrame:
    """(word, n, rank, nodes): the numbers of the trie nodes on the path of ``key``, one for each depth from 0, and
    the word's number in the order of ``key``.  Ranges follow the words and letters there are."""
    keyed = words.select("word", "n", key.alias("key"))
    n, letters = words.agg(F.count(F.lit(1)), F.sum(F.length("word"))).first()
    ranges = max(1, -(-n // RANGE), -(-(letters or 0) // (16 * RANGE)))
    ordered = keyed.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id().cast("long"))
    ordered = shared_table(ordered, f"{name}-ranges")
    ends = [tuple(r) for r in ordered.groupBy("part").agg(F.min("key"), F.max("key")).orderBy("part").collect()]
    return ordered.groupBy("part").applyInPandas(_number(ends), "word string, n bigint, rank bigint, nodes array<bigint>")


def node_pairs(front: DataFrame) -> DataFrame:
    """(front, back, rank, n, skips, once): for every word of ``front`` (``trie_nodes`` of the words themselves) its
    pairs with a letter skipped and with a place for one more.

    ``once`` is false where the skipped letter repeats the one before it."""
    back = trie_nodes(front, F.reverse("word"), "back").select("word", F.col("nodes").alias("back"))
    j = front.withColumnRenamed("nodes", "front").join(back, "word")
    size, letters = F.length("word"), F.split("word", "")
    at = F.sequence(F.lit(0), size)
    inserted = F.transform(at, lambda i: F.struct(F.get("front", i).alias("front"), F.get("back", size - i).alias("back"),
                                                  F.lit(False).alias("skips"), F.lit(True).alias("once")))
    skipped = F.transform(F.slice(at, 1, size), lambda i: F.struct(
        F.get("front", i).alias("front"), F.get("back", size - i - 1).alias("back"), F.lit(True).alias("skips"),
        ((i == 0) | (F.get(letters, i) != F.get(letters, i - 1))).alias("once")))
    return j.select("rank", "n", F.explode(F.concat(inserted, skipped)).alias("p")).select("p.*", "rank", "n")


def nearest(front: DataFrame) -> DataFrame:
    """(rank, n_near, best_n, best): for every word with near words their number and the most frequent one
    (ties: the first in code-point order) with its rank."""
    members = node_pairs(front).groupBy("front", "back").agg(F.collect_list(F.struct(
        (-F.col("n")).alias("m"), "rank", "once", "skips")).alias("x")).filter(F.size("x") > 1)
    # at most one word for each letter, and one that has none
    lists = members.select(F.array_sort(F.filter("x", lambda e: e["skips"])).alias("s"),
                           F.get(F.filter("x", lambda e: ~e["skips"]), F.lit(0)).alias("short"))
    lists = lists.withColumn("o", F.filter("s", lambda e: e["once"]))

    def best(e):
        return F.struct((-e["m"]).alias("n"), (-e["rank"]).alias("rank"))

    none = F.lit(None).cast("struct<n:bigint,rank:bigint>")
    short = F.col("short")
    of_skipped = F.transform("s", lambda e, i: F.struct(
        e["rank"].alias("rank"),
        (F.size("s") - 1 + F.when(e["once"] & short.isNotNull(), 1).otherwise(0)).cast("long").alias("near"),
        F.greatest(F.when(F.size("s") > 1, best(F.get("s", F.when(i == 0, 1).otherwise(0)))).otherwise(none),
                   F.when(e["once"] & short.isNotNull(), best(short)).otherwise(none)).alias("best")))
    of_short = F.when(short.isNotNull() & (F.size("o") > 0), F.array(F.struct(
        short["rank"].alias("rank"), F.size("o").cast("long").alias("near"), best(F.get("o", F.lit(0))).alias("best"))))
    told = lists.select(F.explode(F.concat(of_skipped, F.coalesce(of_short, F.array().cast(
        "array<struct<rank:bigint,near:bigint,best:struct<n:bigint,rank:bigint>>>")))).alias("t"))
    one = told.select("t.*").groupBy("rank").agg(F.sum("near").alias("n_near"), F.max("best").alias("b"))
    return one.filter(F.col("n_near") > 0).select("rank", "n_near", F.col("b.n").alias("best_n"), (-F.col("b.rank")).alias("best"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``words`` (word, n): ``form``, its near word of largest n if that is ``ratio`` times as
    frequent, else null; ``root``, the last word on the way from form to form; ``n``, ``n_near``, ``form_n``.

    Every form is ``ratio`` times as frequent, so the way to the root has at most log(largest n) steps and
    pointers that double their reach take the logarithm of that.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = shared_table(words.select("word", F.col("n").cast("long").alias("n")), "words")
    front = shared_table(trie_nodes(words, F.col("word"), "front"), "front")
    near = nearest(front).withColumnRenamed("rank", "r")
    form = F.when(F.col("best_n") >= F.col("n") * ratio, F.col("best"))
    marked = front.join(near, front["rank"] == near["r"], "left").select("rank", "word", "n", "n_near", form.alias("form_rank"))
    marked = shared_table(marked, "marked")
    steps, least, reach = 0, *marked.agg(F.min("n"), F.max("n")).first()
    while reach is not None and reach >= max(least, 1) * ratio:
        steps, reach = steps + 1, reach // ratio
    up = first = marked.filter("form_rank IS NOT NULL").select("rank", F.col("form_rank").alias("to"))
    for _ in range(max(0, steps - 1).bit_length()):
        ahead = up.select(F.col("rank").alias("to"), F.col("to").alias("next"))
        up = shared_table(up.join(ahead, "to", "left").select("rank", F.coalesce("next", "to").alias("to")), "roots")
    forms = first.join(marked.select(F.col("rank").alias("to"), F.col("word").alias("form"), F.col("n").alias("form_n")), "to").drop("to")
    roots = up.join(marked.select(F.col("rank").alias("to"), F.col("word").alias("root")), "to").drop("to")
    out = marked.join(forms.join(roots, "rank"), "rank", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                      F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
