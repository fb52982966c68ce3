"""Mixing sources to target weights by a curriculum that varies over the training.

Every source has a schedule: its weight at some points of the training, linear between them.  The
integral of the schedule is the source's weight in the whole mix.  The mix has ``share`` times the words
of all documents; a source's target is its part of that by weight, at most ``most`` times its own words,
with the excess shared out again by weight among the other sources (``targets``).

A source's documents stand in a queue in the order of a digest, repeated ``most`` times.  Copies are taken
as long as the middle of the copy lies within the target, so what is taken misses the target by at
most half of one document.  A copy whose middle is the m-th word of the queue is trained on when the
source's demand, the running integral of its schedule, reaches m: the integral is inverted piece by piece
in closed form, which gives the copy's position.  Range-sorting by position gives the training order.

Everything is DataFrame functions.  Equal rows are counted as one entry of the queue; the queue is cut
into buckets by digest, whose number follows the rows of the source, with one running sum over the
buckets and one inside each, so a hot source is no single task.  Sources are one row each; only the
scalars of the water level come to the driver.

Edge cases: a null or blank text has no words and is never taken; a null source is a source of its own;
a null doc_id is a value like others; repeated rows are documents of their own, side by side in the
queue; a source that the schedule lacks, or whose integral is 0, has target 0; an empty table gives no
rows.  Columns of the input that have the name of a result column are not read by ``assign`` and kept by
``training_rows``, whose own columns take free names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabfid.llm.common import fresh, join_groups, numbered, shared_table

WORD = r"[^\x20\x09-\x0D]+"
#: Entries of a source's queue in one bucket, about.
BUCKET = 4_096
#: Rows that are equal in id, text and source are numbered in so many parts.
PARTS = 64


def _key(source: Column) -> Column:
    """A null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _digest(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def _segments(schedule: DataFrame) -> DataFrame:
    """(source_key, weight, segs): the integral of each schedule and its linear pieces with the integral before them."""
    knots = schedule.select(_key(F.col("source")).alias("source_key"), F.col("at").cast("double").alias("at"),
                            F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w"))
    by = Window.partitionBy("source_key").orderBy("at", "w")
    pieces = knots.select("*", F.lead("at").over(by).alias("to"), F.lead("w").over(by).alias("v")).filter("to > at")
    pieces = pieces.withColumn("area", (F.col("w") + F.col("v")) * (F.col("to") - F.col("at")) / 2)
    run = Window.partitionBy("source_key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("g", F.coalesce(F.sum("area").over(run), F.lit(0.0)))
    return pieces.groupBy("source_key").agg(
        F.max(F.col("g") + F.col("area")).alias("weight"),
        F.sort_array(F.collect_list(F.struct("at", "g", "w", "v", "to"))).alias("segs"))


def targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """``sources`` (source_key, source_size, weight, ...) with ``target``: words the mix wants of each.

    The water level (words a unit of weight gets) rises until no source that is still below its
    bound would exceed it; each round is one aggregate over the sources.
    """
    bound, w = F.col("source_size") * most, F.col("weight")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rest, weights = float(share * total), None
    while True:
        full = F.lit(False) if weights is None else bound * F.lit(weights) <= w * F.lit(rest)
        capped, open_ = sources.agg(F.sum(F.when(full & (w > 0), bound)), F.sum(F.when(~full, w))).first()
        now = (float(share * total) - float(capped or 0), float(open_ or 0))
        if now[1] <= 0 or (weights is not None and now[1] >= weights):
            break  # no further source is at its bound
        rest, weights = now
    if not weights:
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn("target", F.when(bound * F.lit(weights) <= w * F.lit(rest), bound.cast("double")).otherwise(
        w * F.lit(rest) / F.lit(weights)))


def _position(m: Column, target: Column, weight: Column, segs: Column) -> Column:
    """Point of the training at which the demand reaches ``m``: the integral inverted on its piece."""
    y = m / target * weight
    seg = F.element_at(F.filter(segs, lambda s: (s["g"] <= y) & (s["w"] + s["v"] > 0)), -1)
    left = y - seg["g"]
    slope = (seg["v"] - seg["w"]) / (seg["to"] - seg["at"])
    root = F.sqrt(F.greatest(seg["w"] * seg["w"] + 2 * slope * left, F.lit(0.0)))
    return F.least(seg["at"] + 2 * left / (seg["w"] + root), seg["to"])


def _positions(start: Column, most: int) -> Column:
    """Positions of the taken copies of the document that stands ``start`` words into its source's queue."""
    size, one, target = F.col("size"), F.col("source_size"), F.col("target")
    copies = F.filter(F.array(*[F.lit(c) for c in range(most)]),
                      lambda c: (size > 0) & ((start + c * one) * 2 + size <= target * 2))
    return F.transform(copies, lambda c: _position(start + c * one + size / 2, target, F.col("weight"), F.col("segs")))


def _queue(docs: DataFrame, schedule: DataFrame, share: float, most: int, doc_id: str, text: str, source: str) -> DataFrame:
    """One row for each different (source, digest): ``n`` equal rows of ``size`` words, ``start`` words into the
    queue, with the target, weight and pieces of the source."""
    t = F.col(text)
    slim = docs.select(_key(F.col(source)).alias("source_key"), F.col(source).alias("source"), F.col(doc_id).alias("doc_id"),
                       F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       _digest(F.col(doc_id), t).alias("key"))
    entries = shared_table(slim.groupBy("source_key", "source", "doc_id", "key", "size").agg(F.count(F.lit(1)).alias("n")), "entries")
    sources = entries.groupBy("source_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.count(F.lit(1)).alias("entries"))
    sources = sources.join(_segments(schedule), "source_key", "left").withColumns({
        "weight": F.coalesce("weight", F.lit(0.0)), "buckets": F.ceil(F.col("entries") / BUCKET)}).drop("entries")
    sources = targets(shared_table(sources, "sources"), share, most)
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32
    dealt = join_groups(entries, sources, ["source_key"]).withColumn("bucket", F.floor(place * F.col("buckets")).cast("long"))
    sums = dealt.groupBy("source_key", "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("words"))
    by = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_key", "bucket", F.coalesce(F.sum("words").over(by), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0))
    return dealt.join(sums, ["source_key", "bucket"]).withColumn("start", F.col("before") + own).drop("buckets", "before", "bucket")


def assign(docs: DataFrame, schedule: DataFrame, share: float = 1.5, most: int = 2, doc_id: str = "doc_id",
           text: str = "text", source: str = "source") -> DataFrame:
    """One row per document, range-sorted by the position of its first copy (documents not taken last): ``doc_id``,
    ``source``, ``size``, ``source_size``, ``target``, ``taken`` (words), ``positions`` (of its copies).

    ``schedule`` has rows (source, at, weight): the weight of a source at a point of the training.
    """
    q = _queue(docs, schedule, share, most, doc_id, text, source)
    # equal rows one by one, in two steps so that no array is long
    many = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BUCKET)))
    rows = q.withColumn("block", many)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n") - F.col("block") * BUCKET, F.lit(BUCKET)) - 1)))
    start = F.col("start") + (F.col("block") * BUCKET + F.col("i")) * F.col("size")
    out = rows.withColumn("positions", _positions(start, most))
    out = out.select("doc_id", "source", "size", "source_size", "target", (F.size("positions") * F.col("size")).cast("long").alias("taken"),
                     "positions", "key")
    out = shared_table(out, "assigned")
    order = [F.get("positions", F.lit(0)).asc_nulls_last(), F.col("key")]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).drop("key")


def training_rows(docs: DataFrame, schedule: DataFrame, share: float = 1.5, most: int = 2, doc_id: str = "doc_id",
                  text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the columns of ``docs`` once for each taken copy, with ``position`` (or, where ``docs`` has that
    name, ``__position``), range-sorted by it: written as files, their order is the training order."""
    q = _queue(docs, schedule, share, most, doc_id, text, source).drop("source", "doc_id")
    key, sk, number, at = fresh(docs, "key", "source_key", "number", "at")
    pos = "position" if "position" not in {c.lower() for c in docs.columns} else fresh(docs, "position")[0]
    entry = q.select(F.col("source_key").alias(sk), F.col("key").alias(key), F.struct(
        "n", "size", "start", "source_size", "target", "weight", "segs").alias(at))
    left = docs.withColumns({sk: _key(F.col(source)), key: _digest(F.col(doc_id), F.col(text))})
    j = left.join(entry, [sk, key])

    def copies(rows: DataFrame, i: Column) -> DataFrame:
        whole = rows.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), F.col(f"{at}.*"), i.alias("i"))
        out = whole.withColumn(pos, F.explode(_positions(F.col("start") + F.col("i") * F.col("size"), most)))
        return out.select("row.*", pos, F.col("key").alias(key))

    (both,) = fresh(j, "both")
    same = numbered(j.filter(F.col(at)["n"] > 1).withColumn(both, F.struct(sk, key)), both, number, PARTS)
    out = copies(j.filter(F.col(at)["n"] == 1), F.lit(0).cast("long")).unionByName(copies(same, F.col(number)))
    return out.repartitionByRange(pos, key).sortWithinPartitions(pos, key).drop(key)
