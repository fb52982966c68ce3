"""Removal of passages of 50 or more words that an earlier document has, by super-k-mer partitioning.

A window is 50 consecutive words.  Its minimiser is the smallest hash among its runs of 4 words, so
equal windows have equal minimisers; consecutive windows that share theirs form a super-k-mer, about
25 windows in 75 words, which travels as one packed string to the bucket of its minimiser.  There
its windows are cut out again and sorted with those of the other super-k-mers of that minimiser; each
run of equal windows has its smallest document first.  A window is covered if that one is smaller
than its own document, and a word goes if a covered window holds it.

What travels is kept small: of equal texts only the smallest document's takes part (the others are
covered as a whole), and only super-k-mers whose minimiser occurs in two different texts.  A
minimiser of more than ``HOT`` super-k-mers (a passage that many documents share) is not gathered:
equal strings are counted as one, their windows are hashed to 128 bits, and the smallest document per
hash is aggregated before the shuffle.

doc_ids are integers.  Edge cases: null texts have no words; a null doc_id counts as larger than all
others; documents of one doc_id do not cover each other; repeated rows are treated alike; texts of
under 50 words stay as they are; other columns pass through untouched, result columns must have new
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfid.llm.common import fresh, join_heavy, shared_table

WINDOW, MER, HOT = 50, 4, 1_000
#: Windows of a packed string at most: a longer super-k-mer (few words repeated) travels in several.
PIECE = 256
#: Frequent minimisers that are broadcast (8 bytes each).
BROADCAST_MINIMISERS = 1_000_000
ROWS_OUT, BYTES_OUT = 1_024, 8_000_000
LAST = 2**63 - 1

_rng = np.random.default_rng(8)
_PLACE = _rng.integers(0, 2**63, MER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def super_kmers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(minimisers, first windows) of the runs of windows that share a minimiser."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = len(words) - MER + 1
    h = w[:k] * _PLACE[0]
    for j in range(1, MER):
        h = h + w[j:k + j] * _PLACE[j]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(32)
    low, span, want = h, 1, WINDOW - MER + 1
    while span * 2 <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[want - span:want - span + n])
    starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    return low[starts].view(np.int64), starts.astype(np.int32)


def _marked(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        w = _words(t)
        m, s = super_kmers(w)
        out.append((len(w), m, s))
    return pd.DataFrame(out, columns=["n_words", "mins", "starts"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the asked-for super-k-mers out of the texts."""
    names = ["t1", "t2", "owner", "mini", "start", "packed"]
    for b in batches:
        rows: list[tuple] = []
        size = 0
        for t1, t2, owner, text, runs in zip(*[b.column(c) for c in ("t1", "t2", "owner", "text", "runs")], strict=True):
            w = _words(text.as_py())
            for r in runs.as_py():
                s = b" ".join(w[r["start"]:r["start"] + r["n"] + WINDOW - 1])
                rows.append((t1.as_py(), t2.as_py(), owner.as_py(), r["mini"], r["start"], s))
                size += len(s)
            if len(rows) >= ROWS_OUT or size >= BYTES_OUT:
                yield _batch(rows, names)
                rows, size = [], 0
        if rows:
            yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"start": pa.int32(), "upto": pa.int32(), "packed": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in
                                       zip(names, zip(*rows, strict=True), strict=True)], names)


def _windows(packed: bytes) -> list[bytes]:
    ends = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist()
    starts, ends = [0, *(e + 1 for e in ends)], [*ends, len(packed)]
    return [packed[a:b] for a, b in zip(starts, ends[WINDOW - 1:], strict=False)]


def _runs(covered: list[int], start: int) -> Iterator[tuple[int, int]]:
    """Word ranges that the covered windows (in order) hold."""
    first = last = None
    for i in covered:
        if first is not None and i <= last + WINDOW:
            last = i
            continue
        if first is not None:
            yield start + first, start + last + WINDOW
        first = last = i
    if first is not None:
        yield start + first, start + last + WINDOW


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimiser: the covered word ranges of each text.  One minimiser's rows (at most
    ``HOT``, of at most ``PIECE`` windows each) are held at a time."""
    names = ["t1", "t2", "start", "upto"]

    def flush(group: list[tuple]) -> list[tuple]:
        if len({g[2] for g in group}) < 2:
            return []
        all_ = [(w, g[2], k, i) for k, g in enumerate(group) for i, w in enumerate(_windows(g[4]))]
        all_.sort()
        covered: dict[int, list[int]] = {}
        word, owner = None, None
        for w, own, k, i in all_:
            if w != word:
                word, owner = w, own
            elif own > owner:
                covered.setdefault(k, []).append(i)
        return [(group[k][0], group[k][1], a, b) for k, at in covered.items() for a, b in _runs(sorted(at), group[k][3])]

    mini, group = None, []
    for b in batches:
        out: list[tuple] = []
        cols = [b.column(c).to_pylist() for c in ("mini", "t1", "t2", "owner", "start", "packed")]
        for m, *row in zip(*cols, strict=True):
            if m != mini:
                out += flush(group)
                mini, group = m, []
            group.append(tuple(row))
        if out:
            yield _batch(out, names)
    if out := flush(group):
        yield _batch(out, names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hash of each window of the packed strings."""
    names = ["p1", "p2", "least", "most", "start", "w1", "w2"]
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("p1", "p2", "least", "most", "packed")]
        rows: list[tuple] = []
        for p1, p2, least, most, packed in zip(*cols, strict=True):
            for i, w in enumerate(_windows(packed)):
                rows.append((p1, p2, least, most, i, *np.frombuffer(xxhash.xxh128_digest(w), np.int64).tolist()))
            if len(rows) >= 16 * ROWS_OUT:
                yield _batch(rows, names)
                rows = []
        if rows:
            yield _batch(rows, names)


def _hot_ranges(hot: DataFrame) -> DataFrame:
    """The covered ranges of super-k-mers whose minimiser is too frequent to gather.

    Equal packed strings are one; their windows' hashes are aggregated to the smallest document, and
    what a string's windows met goes back to its rows.
    """
    hot = hot.withColumns({"p1": F.xxhash64("packed"), "p2": F.xxhash64(F.lit(7), "packed")})
    one = hot.groupBy("p1", "p2").agg(F.min("owner").alias("least"), F.max("owner").alias("most"), F.min("packed").alias("packed"))
    w = shared_table(one.mapInArrow(
        _hashed, "p1 bigint, p2 bigint, least bigint, most bigint, start int, w1 bigint, w2 bigint"), "hot")
    first = w.groupBy("w1", "w2").agg(F.min("least").alias("first"), F.max("most").alias("last"), F.count(F.lit(1)).alias("many"))
    met = join_heavy(w, first.filter("first < last").drop("last"), ["w1", "w2"], "many").filter("first < most").groupBy("p1", "p2").agg(
        F.sort_array(F.collect_list(F.struct("start", "first"))).alias("met"))
    own = F.filter("met", lambda m: m["first"] < F.col("owner"))
    rows = hot.drop("packed", "mini").join(met, ["p1", "p2"]).select("t1", "t2", "start", own.alias("met")).filter(F.size("met") > 0)
    return rows.select("t1", "t2", F.explode(_word_runs("met", "start")).alias("r")).select("t1", "t2", "r.*")


def _word_runs(met: str, start: str) -> Column:
    """Word ranges of sorted covered windows; windows that touch or overlap make one range."""
    at = F.transform(met, lambda m: m["start"])
    firsts = F.filter(F.transform(at, lambda x, i: F.when((i == 0) | (x > F.get(at, i - 1) + WINDOW), x)), lambda x: x.isNotNull())
    lasts = F.filter(F.transform(at, lambda x, i: F.when((i == F.size(met) - 1) | (F.get(at, i + 1) > x + WINDOW), x)),
                     lambda x: x.isNotNull())
    return F.zip_with(firsts, lasts, lambda a, b: F.struct((F.col(start) + a).alias("start"), (F.col(start) + b + WINDOW).alias("upto")))


def covered_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(t1, t2, owner, ranges): for each distinct text its smallest doc_id (null as the largest long)
    and the word ranges, sorted, that windows of smaller documents cover."""
    key = _text_key(docs, doc_id, text)
    marks = F.pandas_udf(_marked, "n_words bigint, mins array<bigint>, starts array<int>")("text")
    signed = shared_table(key.select("t1", "t2", "owner", marks.alias("m")).select("t1", "t2", "owner", "m.*"), "signed")
    owners = shared_table(signed.groupBy("t1", "t2").agg(F.min("owner").alias("owner")), "owners")
    each = signed.filter(F.size("mins") > 0)
    shared = each.select("t1", F.explode("mins").alias("mini")).groupBy("mini").agg(
        F.min("t1").alias("lo"), F.max("t1").alias("hi")).filter("lo != hi").select("mini")
    runs = F.explode(F.transform("mins", lambda m, i: F.struct(
        m.alias("mini"), F.get("starts", i).alias("start"),
        (F.coalesce(F.get("starts", i + 1), (F.col("n_words") - (WINDOW - 1)).cast("int")) - F.get("starts", i)).alias("n"))))
    own = each.join(owners, ["t1", "t2", "owner"], "left_semi").dropDuplicates(["t1", "t2"])
    flagged = own.select("t1", "t2", "owner", runs.alias("r")).select("t1", "t2", "owner", "r.*").join(shared, "mini")
    flagged = flagged.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE).cast("int")))).select(
        "t1", "t2", "owner", "mini", (F.col("start") + F.col("piece") * PIECE).alias("start"),
        F.least(F.col("n") - F.col("piece") * PIECE, F.lit(PIECE)).alias("n"))
    wanted = flagged.groupBy("t1", "t2", "owner").agg(F.collect_list(F.struct("mini", "start", "n")).alias("runs"))
    texts = key.join(wanted, ["t1", "t2", "owner"]).select("t1", "t2", "owner", "text", "runs")
    packed = shared_table(texts.mapInArrow(
        _packed, "t1 bigint, t2 bigint, owner bigint, mini bigint, start int, packed binary"), "packed")
    # at most one in ``hot`` strings has a minimiser of its own here, so its strings need not travel to be told apart
    many = shared_table(packed.groupBy("mini").count().filter(F.col("count") > hot).select("mini"), "hot-minimisers")
    many = F.broadcast(many) if many.count() <= BROADCAST_MINIMISERS else many
    cold = packed.join(many, "mini", "left_anti")
    ranges = "t1 bigint, t2 bigint, start int, upto int"
    found = cold.repartition("mini").sortWithinPartitions("mini").mapInArrow(_counted, ranges)
    more = _hot_ranges(packed.join(many, "mini", "left_semi"))
    per = found.unionByName(more).groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("start", "upto"))).alias("ranges"))
    return shared_table(owners.join(per, ["t1", "t2"], "left"), "ranges")


def _text_key(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(text)).alias("t1"), F.xxhash64(F.lit(7), F.col(text)).alias("t2"),
                       F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("owner"), F.col(text).alias("text"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: str = "kept_text",
                   n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` with ``kept`` (the words that stay, joined by one space), ``n_words`` and ``n_removed``."""
    if clash := {c.lower() for c in docs.columns} & {kept.lower(), n_words.lower(), n_removed.lower()}:
        raise ValueError(f"the input has columns named {sorted(clash)}")
    t1, t2, own, ranges, known = fresh(docs, "t1", "t2", "owner", "ranges", "known")
    per = covered_ranges(docs, doc_id, text).select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("owner").alias(own),
                                                    F.col("ranges").alias(ranges), F.lit(True).alias(known))
    keyed = docs.withColumns({t1: F.xxhash64(F.col(text)), t2: F.xxhash64(F.lit(7), F.col(text)),
                              own: F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))})
    # a row that is not its text's smallest finds no partner: an equal text comes before it
    j = keyed.join(per, [t1, t2, own], "left").select(*docs.columns, ranges, known)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_words, T.LongType()),
                           T.StructField(n_removed, T.LongType()), T.StructField(kept, T.StringType())])
    names = schema.names
    at, width = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            size = first = 0
            for i, (t, rs, k) in enumerate(zip(b.column(at), b.column(width), b.column(width + 1), strict=True)):
                w = _words(t.as_py())
                stay = w
                if not k.as_py():
                    stay = [] if len(w) >= WINDOW else w
                elif rs.is_valid:
                    stay, upto = [], 0
                    for r in rs.as_py():
                        if r["start"] > upto:
                            stay += w[upto:r["start"]]
                        upto = max(upto, r["upto"])
                    stay += w[upto:]
                s = b" ".join(stay).decode("utf-8")
                rows.append((len(w), len(w) - len(stay), s))
                size += len(s)
                if len(rows) >= ROWS_OUT or size >= BYTES_OUT or i == b.num_rows - 1:
                    n, r, s = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [*b.slice(first, len(rows)).columns[:width], pa.array(n, pa.int64()), pa.array(r, pa.int64()),
                         pa.array(s, pa.string())], names)
                    rows, size, first = [], 0, i + 1
    return j.mapInArrow(run, schema)
