"""Hard negatives by slot-decomposed selection.

Every anchor's positives are its ``n_positives`` highest-scoring other rows of the same label.  A
positive of score p wants the first ``n_negatives`` rows of other labels with scores from ``low`` * p to
``high`` * p per cent: windows that overlap.  The upper limits of an anchor's positives, in descending
order, cut the scores into disjoint slots; a row of score s falls into the slot of the lowest limit that
is not below it.  Each slot keeps only its first ``n_negatives`` rows (a group limit runs in every task
before the shuffle, so it combines), and the window of a positive is answered from its own slot and
those below it, merged in descending order and cut at its lower limit.

Scores are integer inner products, computed block by block: anchors and rows are packed into blocks of
vectors, every block of anchors meets every block of rows (the stated query set against all rows), once for
the positives and once for the slots.  Products and sums under 2^53 are exact in doubles; larger ones
are computed with whole numbers of any size, and a score beyond 64 bits counts as the largest (smallest) one.

Edge cases: rows with a null label or vector, or with a null or non-finite component (also after scaling),
take no part; vectors of different length are not compared; a null id is no anchor and sorts behind all
others among equal scores; of ``k`` equal rows each is a row of its own (an anchor meets the other
``k - 1``, and equal anchors return equal rows); an anchor without positives, or a window without rows,
returns nothing, as do windows of negative positives, which are empty; an empty table gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabfid.llm.common import shared_table

#: Rows of a block at most; the number of an anchor is its block's number and its place in it.
ANCHORS, ROWS = 512, 8_192
#: Components of a block at most, however long the vectors are.
COMPONENTS = 2_000_000
BLOCK = "dim int, n int, ids binary, named binary, labels binary, kind string, vectors binary"
TOP, BOTTOM = 2**63 - 1, -(2**63)
PAIR = "anchor bigint, anchor_id bigint, slot int, id bigint, score bigint, same boolean"


def _pack(most: int):
    """Packs rows (id, label, vector) into blocks of one vector length and at most ``most`` rows."""
    def one(d: pd.DataFrame, dim: int) -> tuple:
        named = d["id"].notna().to_numpy()
        v = np.floor(np.stack([np.asarray(x, "<f8") for x in d["vector"]])) if dim else np.zeros((len(d), 0))
        far = float(np.abs(v).max(initial=0))
        kind = "<i2" if far < 2**15 else "<i4" if far < 2**31 else "<f8"
        return (dim, len(d), d["id"].fillna(0).to_numpy("<i8").tobytes(), named.astype("u1").tobytes(),
                d["label"].to_numpy("<i8").tobytes(), kind, v.astype(kind).tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        cols = [c.split()[0] for c in BLOCK.split(", ")]
        for batch in batches:
            for dim, d in batch.groupby(batch["vector"].map(len)):
                size = max(1, min(most, COMPONENTS // max(dim, 1)))
                held[dim] = [pd.concat([*held.get(dim, []), d])]
                while len(held[dim][0]) >= size:
                    yield pd.DataFrame([one(held[dim][0][:size], dim)], columns=cols)
                    held[dim] = [held[dim][0][size:]]
        for dim, (d,) in held.items():
            if len(d):
                yield pd.DataFrame([one(d, dim)], columns=cols)
    return run


def _vectors(rows: DataFrame, id: str, vector: str, label: str, scale: float) -> DataFrame:
    """(id, label, vector) of the rows that take part; components scaled and floored."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    d = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    inf = float("inf")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return d.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & ok).select("id", "label", F.col("v").alias("vector"))


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    packed = rows.mapInPandas(_pack(most), BLOCK)
    return shared_table(packed.withColumn("block", F.monotonically_increasing_id()), name)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b`` (whole numbers) as int64."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    x, y = (np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape) for m in (a, b))
    return np.clip(x @ y.T, BOTTOM, TOP).astype(np.int64)


def _first(score: np.ndarray, ids: np.ndarray, named: np.ndarray, want: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` wanted entries of one row: by score, then id, nulls last."""
    at = np.flatnonzero(want)
    if len(at) > k:
        cut = np.partition(score[at], len(at) - k)[len(at) - k]
        over, ties = at[score[at] > cut], at[score[at] == cut]
        ties = ties[np.lexsort((ids[ties], ~named[ties]))][:k - len(over)]
        at = np.concatenate([over, ties])
    return at


def _meet(k: int):
    """For each pair of blocks the candidates of every anchor: of its label where the pair has no limits,
    else of other labels by slot."""
    def read(r, side: str):
        f = lambda c, t: np.frombuffer(r[f"{side}_{c}"], t)
        vectors = f("vectors", r[f"{side}_kind"]).astype(np.float64).reshape(r[f"{side}_n"], r[f"{side}_dim"])
        return f("ids", "<i8"), f("named", "u1").astype(bool), f("labels", "<i8"), vectors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                if r["a_dim"] != r["b_dim"]:
                    continue
                a_ids, _, a_labels, a_vec = read(r, "a")
                ids, named, labels, vec = read(r, "b")
                scores = _scores(a_vec, vec)
                limits = None if r.get("limits") is None else {int(x["anchor"]) - r["first"]: x for x in r["limits"]}
                out: list[tuple[np.ndarray, ...]] = []
                for i in range(len(a_ids)):
                    s, like = scores[i], labels == a_labels[i]
                    if limits is None:
                        at = _first(s, ids, named, like, k)
                        same = (ids[at] == a_ids[i]) & named[at] & (vec[at] == a_vec[i]).all(axis=1)
                        out.append((np.full(len(at), i), np.zeros(len(at), np.int32), at, same))
                    elif i in limits:
                        high, low = (np.asarray(limits[i][c], np.int64) for c in ("high", "low"))
                        near = np.flatnonzero(~like & (s <= high[0]) & (s >= low[-1]))
                        # limits descend: the slot is that of the last one that is not below the score
                        slot = np.searchsorted(-high, -s[near], side="right") - 1
                        fits = s[near] >= low[slot]
                        for j in np.unique(slot[fits]):
                            mine = near[fits & (slot == j)]
                            at = mine[_first(s[mine], ids[mine], named[mine], np.ones(len(mine), bool), k)]
                            out.append((np.full(len(at), i), np.full(len(at), j, np.int32), at, np.zeros(len(at), bool)))
                if out:
                    who, slot, at, same = (np.concatenate(x) for x in zip(*out))
                    yield pd.DataFrame({"anchor": r["first"] + who, "anchor_id": a_ids[who], "slot": slot, "id": pd.arrays.IntegerArray(ids[at], ~named[at]),
                                        "score": scores[who, at], "same": same})
    return run


def _candidates(anchors: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """First ``k`` candidates of every (anchor, slot) over all blocks, numbered from 1 in ``place``."""
    b = blocks.select(*[F.col(c).alias(f"b_{c}") for c in blocks.columns if c != "block"])
    keep = ("first", "limits")
    a = anchors.select(*[F.col(c) if c in keep else F.col(c).alias(f"a_{c}") for c in anchors.columns])
    found = b.crossJoin(a).mapInPandas(_meet(k), PAIR)  # block by block: the query set against all rows
    by = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("same").desc())
    return found.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)


def _limit(score: Column, per_cent: int, up: bool) -> Column:
    x = score.cast("decimal(20,0)") * per_cent
    return (F.ceil(x / 100) if up else F.floor(x / 100)).cast("long")


def mine(rows: DataFrame, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, anchor_every: int = 100,
         scale: float = 256.0, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors: the rows whose
    id is divisible by ``anchor_every``."""
    usable = _vectors(rows, id, vector, label, scale)
    blocks = _blocks(usable, ROWS, "rows")
    chosen = usable.filter(F.col("id") % anchor_every == 0)
    chosen = chosen.repartition(max(1, chosen.count() // (4 * ANCHORS)))  # full blocks
    anchors = _blocks(chosen, ANCHORS, "anchors").withColumn("first", F.col("block") * ANCHORS).drop("block")
    # an anchor is among the rows of its own label: one more is kept, and one equal to it left out
    near = _candidates(anchors, blocks, n_positives + 1)
    itself = Window.partitionBy("anchor").orderBy(F.col("same").desc(), "place")
    near = near.withColumn("self", F.col("same") & (F.row_number().over(itself) == 1)).filter(~F.col("self"))
    order = Window.partitionBy("anchor").orderBy("place")
    near = near.withColumn("at", F.row_number().over(order) - 1).filter(F.col("at") < n_positives)
    positives = near.groupBy("anchor", "anchor_id").agg(F.sort_array(F.collect_list(F.struct(
        "at", "id", "score", _limit(F.col("score"), high, False).alias("high"), _limit(F.col("score"), low, True).alias("low")))).alias("p"))
    positives = shared_table(positives, "positives")
    limits = positives.select((F.col("anchor") - F.pmod("anchor", F.lit(ANCHORS))).alias("first"), F.struct(
        "anchor", F.col("p.high").alias("high"), F.col("p.low").alias("low")).alias("l"))
    limited = shared_table(anchors.join(limits.groupBy("first").agg(F.collect_list("l").alias("limits")), "first"), "limits")
    kept = _candidates(limited, blocks, n_negatives)
    # slots descend in score, so a suffix of slots merged in descending order is the list from its first slot on
    lists = kept.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "place", "id", "score"))).alias("c"))
    j = lists.join(positives, "anchor").select("anchor_id", "c", F.explode("p").alias("p"))
    fits = F.slice(F.filter("c", lambda c: (c["slot"] >= F.col("p.at")) & (c["score"] >= F.col("p.low"))), 1, n_negatives)
    j = j.select("anchor_id", "p", F.posexplode(fits).alias("i", "c"))
    return j.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("i") + 1).alias("rank"),
                                          F.col("c.id").alias("negative_id"), F.col("p.score").alias("positive_score"),
                                          F.col("c.score").alias("negative_score"))
