"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabfid.session import shared_table  # noqa: F401  (for the operators)

#: ASCII white space besides the space: \t \n \v \f \r.  It separates words, as the space does.
OTHER_SPACE = r"[\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), OTHER_SPACE, " "), " "), "")


def window_hashes(items: Column, n: int) -> Column:
    """64-bit hashes of the ``n`` consecutive ``items`` from each place on; empty if there are fewer.

    Hashes of 1, 2, 4, ... items are paired up, so a window costs about log2(n) hashes.
    """
    rest = F.lit(2**30)

    def pair(xs: Column, ys: Column, by: int) -> Column:
        return F.zip_with(xs, F.slice(ys, by + 1, rest), lambda a, b: F.xxhash64(a, b))

    def grow(levels: list[Column]) -> Column:
        have = 2 ** (len(levels) - 1)
        if have * 2 <= n:
            return let(pair(levels[-1], levels[-1], have), lambda nxt: grow([*levels, nxt]))
        full, done = levels[-1], have
        for k in range(len(levels) - 2, -1, -1):
            if done + 2**k <= n:
                full, done = pair(full, levels[k], done), done + 2**k
        return F.slice(full, 1, F.size(levels[0]) - (n - 1))

    none = F.array().cast("array<bigint>")
    return F.when(F.size(items) >= n, let(F.transform(items, lambda x: F.xxhash64(x)), lambda h: grow([h]))).otherwise(none)

def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet (case-insensitively), one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        c = f"__{n}"
        while c.lower() in taken:
            c = f"_{c}"
        taken.add(c.lower())
        out.append(c)
    return out


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], limit: int = 50_000, salts: int = 64) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per key, keys without nulls, no other common names).

    Up to ``limit`` groups (counted first) they are broadcast; beyond, each group's rows are dealt to
    ``salts`` tasks, so that a hot group is no single task.
    """
    if groups.count() <= limit:
        return rows.join(F.broadcast(groups), keys)
    (salt,) = fresh(rows.join(groups.limit(0), keys), "salt")
    left = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = groups.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, salt]).drop(salt)


def join_heavy(rows: DataFrame, per_key: DataFrame, keys: list[str], many: str, heavy: int = 1_000, limit: int = 50_000) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, one row per key, whose column ``many`` counts the rows of the key.

    Keys of more than ``heavy`` rows (at most one in ``heavy`` rows) do not travel by key: they are joined as
    ``join_groups`` does, and only the others are shuffled, so a hot key is no single task.
    """
    per_key = shared_table(per_key, "per-key")
    hot = per_key.filter(F.col(many) > heavy)
    if hot.isEmpty():
        return rows.join(per_key, keys)
    few = hot.count() <= limit
    cold = rows.join(F.broadcast(hot.select(*keys)) if few else hot.select(*keys), keys, "left_anti")
    return cold.join(per_key.filter(F.col(many) <= heavy), keys).unionByName(join_groups(rows, hot, keys, limit))


def numbered(rows: DataFrame, key: str, out: str, parts: int = 64) -> DataFrame:
    """``rows`` with ``out``: numbers from 0 on among the rows of equal ``key`` (a struct, so that nulls are equal).

    They are numbered in ``parts`` parts, so that many equal rows are no single task."""
    part, before = fresh(rows, "part", "before")
    rows = shared_table(rows.withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(parts))), "numbered")
    sums = rows.groupBy(key, part).agg(F.count(F.lit(1)).alias(before))
    sums = sums.withColumn(before, F.sum(before).over(Window.partitionBy(key).orderBy(part)) - F.col(before))
    own = F.row_number().over(Window.partitionBy(key, part).orderBy(part)) - 1
    return rows.join(sums, [key, part]).withColumn(out, F.col(before) + own).drop(part, before)
