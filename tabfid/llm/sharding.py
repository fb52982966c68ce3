"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Rows of equal text form a group.  Each group has a vector (bytes, tokens, rows) and goes to the
shard where the dot product with what that shard's capacity has left is highest, among the shards
that can still take its bytes.  So that the driver packs a bounded number of items, small groups
are first bundled by a hash of their text; a group of more than ``1 / HEAVY`` of a shard is packed on
its own.  It stays whole in one shard unless it has more than a shard's part of anything; then it is
packed in units of at most half of that.  For the slots a group's rows are dealt to pieces, so that
none is large.  The number of bundles grows with the rows (``ROWS_PER_BUNDLE``) up to
``MOST_BUNDLES``; the driver holds one vector per bundle and piece, at most about twice as many.

Law ``bytes``: sizes are near equal.  Items are placed by decreasing size, so the shards differ by
about one small bundle.  Rows within a shard get slots 0, 1, ... without gaps, by bundle and doc_id.

Edge cases: a null text is a text of its own with no bytes (size 1, crc 0); repeated rows are equal
texts and take neighbouring slots; a null doc_id sorts first; an empty table gives no rows; other
columns of the input pass through in ``shard_documents`` if no result column has their name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabfid.llm.common import fresh, numbered, shared_table, words

HEAVY = 64
ROWS_PER_BUNDLE, LEAST_BUNDLES, MOST_BUNDLES = 2_000, 1_024, 250_000
BROADCAST_GROUPS = 100_000
DIMS = ("size", "tokens", "rows")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item: items of decreasing share, each where the dot product of its vector with
    the shard's residual capacity is highest and its bytes fit; else where most bytes are left."""
    if not len(vectors):
        return np.zeros(0, np.int32)
    total = np.maximum(vectors.sum(axis=0), 1)
    v = vectors / total * shards  # capacity 1 in each dimension
    left = np.ones((shards, v.shape[1]))
    out = np.empty(len(v), np.int32)
    for i in np.lexsort((np.arange(len(v)), -v[:, 0])):
        room = left[:, 0] >= v[i, 0]
        s = int(np.argmax(np.where(room, left @ v[i], -np.inf) if room.any() else left[:, 0]))
        out[i] = s
        left[s] -= v[i]
    return out


def _even(vectors: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Moves small items from the fullest to the emptiest shard while that lowers the spread of bytes."""
    shard, size = shard.copy(), vectors[:, 0]
    load = np.bincount(shard, weights=size, minlength=shards)
    for _ in range(64 * shards):
        hi, lo = int(load.argmax()), int(load.argmin())
        here = np.flatnonzero(shard == hi)
        fit = here[size[here] < load[hi] - load[lo]]
        if not len(fit):
            break
        gap = (load[hi] - load[lo]) / 2
        i = fit[np.abs(size[fit] - gap).argmin()]
        shard[i] = lo
        load[hi] -= size[i]
        load[lo] += size[i]
    return shard


def _units(items: pd.DataFrame, shards: int) -> np.ndarray:
    """Number of the unit that each item is packed with: a bundle is one; the pieces of a group are one
    unit, or, if the group has more than a shard's part of anything, units of at most half of that."""
    dims = items[list(DIMS)]
    share = (dims / dims.sum().clip(lower=1)).groupby(items["g"]).transform("sum").max(axis=1) * shards
    many = items.groupby("g")["p"].transform("size")
    units = np.where(share > 1, np.ceil(2 * share), 1).astype(np.int64)
    own = items.groupby("g").cumcount() * units // many
    own = np.where(items["g"] == 0, items["p"], own)  # g is 0 for bundles
    return pd.MultiIndex.from_arrays([items["g"], own]).factorize(sort=True)[0]


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text",
                    keep: list[str] | None = None, heavy: int = HEAVY,
                    rows_per_bundle: int = ROWS_PER_BUNDLE) -> DataFrame:
    """``docs`` without ``text`` (or only the columns ``keep``) with ``size`` (UTF-8 bytes plus 1),
    ``text_crc32``, ``tokens`` (words), ``shard`` and ``slot``."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    taken = {"size", "text_crc32", "tokens", "shard", "slot", "shard_item", "text_key", "pieces", "shard_key", "shard_number", "n", "first"}
    keep = [c for c in keep if c.lower() not in taken]
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    (own,) = fresh(docs.select(*keep), "id")
    rows = docs.select(
        *keep, F.col(doc_id).alias(own),
        (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"),
        F.size(words(F.col(text))).cast("long").alias("tokens"),
        F.struct(F.xxhash64(F.col(text)).alias("a"), F.crc32(F.concat(F.lit(b"\x01"), body)).alias("b"),
                 F.col(text).isNull().alias("c")).alias("text_key"))
    rows = shared_table(rows, "rows")
    groups = shared_table(rows.groupBy("text_key").agg(*[F.sum(c).alias(c) for c in ("size", "tokens")],
                                                       F.count(F.lit(1)).alias("rows")), "groups")
    whole = groups.agg(*[F.sum(c).alias(c) for c in DIMS]).first()
    if not whole["rows"]:
        out = rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
        return out.select(*keep, "size", "text_crc32", "tokens", "shard", "slot")

    def share(c: str) -> Column:
        return F.ceil(F.col(c) * (heavy * shards) / F.lit(float(max(whole[c], 1)))).cast("int")

    bundles = min(MOST_BUNDLES, max(LEAST_BUNDLES, -(-whole["rows"] // rows_per_bundle)))
    per_piece = max(rows_per_bundle, -(-whole["rows"] // MOST_BUNDLES))
    wanted = F.greatest(*[share(c) for c in DIMS], F.ceil(F.col("rows") / per_piece).cast("int"))
    pieces = groups.withColumn("pieces", F.least(wanted, F.col("rows").cast("int"))).filter("pieces > 1").select(
        "text_key", "pieces")
    if pieces.count() <= BROADCAST_GROUPS:
        pieces = F.broadcast(pieces)
    key = F.xxhash64("text_key.a", "text_key.b")
    part = F.pmod(F.xxhash64(own, F.lit(7)) + F.coalesce(F.col("shard_number"), F.lit(0)), F.col("pieces"))
    item = F.when(F.col("pieces").isNull(), F.struct(F.lit(0).cast("long").alias("g"), F.pmod(key, F.lit(bundles)).alias("p"))
                  ).otherwise(F.struct(key.alias("g"), part.cast("long").alias("p")))
    rows = rows.join(pieces, "text_key", "left").withColumn("shard_key", F.struct("text_key", F.col(own).alias("id")))
    # rows that also share their id are dealt by their number among these
    again = rows.filter("pieces IS NOT NULL").groupBy("shard_key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    again = shared_table(again, "repeated")
    if again.isEmpty():
        rows = rows.withColumn("shard_number", F.lit(0))
    else:
        keys = again.select("shard_key")
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_GROUPS else keys
        rows = rows.join(keys, "shard_key", "left_anti").withColumn("shard_number", F.lit(0).cast("long")).unionByName(
            numbered(rows.join(keys, "shard_key", "left_semi"), "shard_key", "shard_number"))
    marked = shared_table(rows.withColumn("shard_item", item).drop("pieces", "text_key", "shard_key", "shard_number"), "items")
    items = marked.groupBy("shard_item").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"),
                                             F.count(F.lit(1)).alias("rows"))
    got = items.select("shard_item.g", "shard_item.p", *DIMS).toPandas()  # one row per bundle or piece, bounded above
    got = got.sort_values(["g", "p"], ignore_index=True)
    unit = _units(got, shards)
    vectors = got.groupby(unit)[list(DIMS)].sum().to_numpy(np.float64)
    got["shard"] = _even(vectors, place(vectors, shards), shards).astype(np.int32)[unit]
    got["first"] = got.groupby("shard")["rows"].cumsum() - got["rows"]
    plan = docs.sparkSession.createDataFrame(got[["g", "p", "shard", "first"]]).select(
        F.struct(F.col("g").cast("long").alias("g"), F.col("p").cast("long").alias("p")).alias("shard_item"),
        F.col("shard").cast("int").alias("shard"), F.col("first").cast("long").alias("first"))
    by = Window.partitionBy("shard_item").orderBy(own, "text_crc32", "size")
    out = marked.withColumn("n", F.row_number().over(by)).join(plan, "shard_item")
    return out.select(*keep, "size", "text_crc32", "tokens", "shard", (F.col("first") + F.col("n") - 1).alias("slot"))
