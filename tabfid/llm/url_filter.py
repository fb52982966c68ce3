"""URL filter: a sorted array of 64-bit digests of the rules, probed by binary search.

A rule is a host, a path and a verdict.  It fits its host and all subdomains, for urls whose path
starts with the rule's path; of several the one with the longest host and path wins (then the
longest host).  The rules are hashed on Spark (``xxhash64`` of host and path), sorted and written
to one flat file in the shared folder: digests, ends of strings, strings.  Executors fetch it once each and map it
into memory, so all Python workers of an executor share its pages.  A batch of urls is probed
as a whole: every suffix of the host at a label border, with every length that rule paths have,
gives one key; ``searchsorted`` finds its place, and the stored full string confirms it, so a
collision of digests decides nothing (all places with an equal digest are looked at).

The file is for rule tables of up to ``MAX_FILE_RULES`` rows (counted first).  A larger table is joined
instead: the candidate keys of the urls are exploded and meet the rules by their full strings.

Urls that no rule fits get ``default``.  Edge cases: a null url or one without ``://`` has an
empty host and path, which no rule fits; of rules with equal host and path the verdict ``block``
wins; null host or path of a rule count as empty, an empty host fits nothing; repeated urls are
judged alike; result columns must have new names, other columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabfid.llm.common import fresh
from tabfid.session import ensure_checkpoint_dir

#: Rules that the driver sorts (some 200 bytes each).
MAX_FILE_RULES = 500_000
CHUNK = 4 * 2**20
SEP = "\x00"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; path up to ``? #`` or the end."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0,
                  F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


class Digests:
    """The mapped file: ``n``, then n digests, n + 1 ends, then the strings host NUL path NUL verdict."""

    def __init__(self, path: str):
        head = np.memmap(path, np.int64, "r", shape=(2,))
        n, self.lengths = int(head[0]), None
        k = int(head[1])
        self.lengths = np.memmap(path, np.int64, "r", offset=16, shape=(k,)).tolist() if k else []
        at = 16 + 8 * k
        self.keys = np.memmap(path, np.uint64, "r", offset=at, shape=(n,)) if n else np.empty(0, np.uint64)
        self.ends = np.memmap(path, np.int64, "r", offset=at + 8 * n, shape=(n + 1,))
        at += 16 * n + 8
        self.text = np.memmap(path, np.uint8, "r", offset=at) if n else np.empty(0, np.uint8)

    @staticmethod
    def pack(rules: pd.DataFrame) -> bytes:
        """``rules``: host, path, verdict, sorted by the digest column ``key``."""
        lengths = sorted({len(p) for p in rules["path"]})
        strings = [SEP.join(r).encode() for r in zip(rules["host"], rules["path"], rules["verdict"], strict=True)]
        return b"".join([np.array([len(rules), len(lengths), *lengths], np.int64).tobytes(),
                         rules["key"].to_numpy(np.uint64).tobytes(),
                         np.cumsum([0, *map(len, strings)]).astype(np.int64).tobytes(), *strings])

    def probe(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) for each url."""
        who: list[int] = []
        tries: list[tuple[str, str]] = []
        for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            if not h:
                continue
            starts = [0, *(k + 1 for k, c in enumerate(h) if c == ".")]
            cuts = [p[:n] for n in self.lengths if n <= len(p)]
            for s in starts:
                for c in cuts:
                    who.append(i)
                    tries.append((h[s:], c))
        best: list[tuple[int, int, str | None, str | None]] = [(-1, -1, None, None)] * len(hosts)
        if tries and len(self.keys):
            keys = np.fromiter((digest(h, p) for h, p in tries), np.uint64, len(tries))
            lo = np.searchsorted(self.keys, keys, "left")
            hi = np.searchsorted(self.keys, keys, "right")
            for t in np.flatnonzero(hi > lo):
                h, p = tries[t]
                for at in range(lo[t], hi[t]):
                    host, path, verdict = self.text[self.ends[at]:self.ends[at + 1]].tobytes().decode().split(SEP)
                    if (host, path) == (h, p):
                        best[who[t]] = max(best[who[t]], (len(h) + len(p), len(h), h + p, verdict), key=lambda b: b[:2])
                        break
        return [(r, v) for _, _, r, v in best]


def digest(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}{SEP}{path}")


@lru_cache(maxsize=2)
def _mapped(name: str) -> Digests:
    return Digests(SparkFiles.get(name))


def _digests(host: pd.Series, path: pd.Series) -> pd.Series:
    keys = np.array([digest(h, p) for h, p in zip(host, path, strict=True)], np.uint64)
    return pd.Series(keys.view(np.int64))


def clean_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict), one row for each host and path."""
    r = rules.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path", "verdict")])
    return r.filter("host != ''").groupBy("host", "path").agg(
        F.when(F.max((F.col("verdict") == "block").cast("int")) == 1, "block").otherwise(F.max("verdict")).alias("verdict"))


def build_file(rules: DataFrame) -> str:
    """Sorted digests of cleaned rules in one file that Spark gives to every executor; returns its name."""
    spark = rules.sparkSession
    got = rules.withColumn("key", F.pandas_udf(_digests, "long")("host", "path")).toPandas()  # at most MAX_FILE_RULES rows
    got["key"] = got["key"].to_numpy(np.int64).view(np.uint64)
    name = f"digests-{uuid.uuid4().hex}.bin"
    packed = Digests.pack(got.sort_values(["key", "host", "path"]))
    sc = spark.sparkContext
    file = sc._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
    fs = file.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(file)
    for at in range(0, len(packed), CHUNK):
        out.write(bytearray(packed[at:at + CHUNK]))
    out.close()
    fs.deleteOnExit(file)
    sc.addFile(str(fs.makeQualified(file)))   # every executor fetches it from the shared folder
    return name


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
               max_file_rules: int = MAX_FILE_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the winner, or null) and ``verdict``."""
    new = ["host", "path", "rule", "verdict"]
    if clash := {c.lower() for c in pages.columns} & set(new):
        raise ValueError(f"the input has columns named {sorted(clash)}")
    host, path = host_and_path(F.col(url))
    rows = pages.withColumns({"host": host, "path": path})
    rules = clean_rules(rules).persist()
    if rules.count() > max_file_rules:
        return _joined(rows, rules, pages.columns, default)
    name = build_file(rules)
    rules.unpersist()

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def probed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for h, p in batches:
            yield pd.DataFrame(_mapped(name).probe(h.tolist(), p.tolist()), columns=["rule", "verdict"], dtype=object)

    (won,) = fresh(rows, "p")
    out = rows.withColumn(won, probed("host", "path"))
    return out.select(*pages.columns, "host", "path", F.col(won)["rule"].alias("rule"),
                      F.coalesce(F.col(won)["verdict"], F.lit(default)).alias("verdict"))


def _joined(rows: DataFrame, rules: DataFrame, columns: list[str], default: str) -> DataFrame:
    """The same by joins: distinct (host, path) pairs, their candidate keys, and the rules by full strings."""
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    pairs = rows.select("host", "path").distinct().filter("host != ''")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))),
                           lambda k: F.array_join(F.slice(F.split("host", r"\."), k, F.size(F.split("host", r"\."))), "."))
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]),
                      lambda p: p.isNotNull())
    keys = pairs.select("host", "path", F.explode(suffixes).alias("h")).select("*", F.explode(starts).alias("p"))
    hits = keys.join(rules.toDF("h", "p", "v"), ["h", "p"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("h") + F.length("p")).alias("n"), F.length("h").alias("m"), F.concat("h", "p").alias("rule"),
        F.col("v").alias("verdict"))).alias("b"))
    (won,) = fresh(rows, "b")
    out = rows.join(best.withColumnRenamed("b", won), ["host", "path"], "left")
    return out.select(*columns, "host", "path", F.col(won)["rule"].alias("rule"),
                      F.coalesce(F.col(won)["verdict"], F.lit(default)).alias("verdict"))
