"""Registered queries: one per operator, each with its DuckDB oracle text.

A query takes ``(spark, sf_dir)`` and returns a DataFrame.  Double columns listed in
``doubles`` are rounded the same way in both engines (sums of doubles differ in the
last bits with the order of addition).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tabfid.functions.exprs import r6, rsig


@dataclass
class QuerySpec:
    qid: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: list[str] = field(default_factory=list)
    places: int = 6
    doc: str = ""


REGISTRY: dict[str, QuerySpec] = {}


def register(qid: str, sql: str | None = None, doubles: tuple[str, ...] | list[str] = (),
             places: int = 6):
    def deco(fn):
        if qid in REGISTRY:
            raise ValueError(f"duplicate query id {qid}")
        REGISTRY[qid] = QuerySpec(qid, fn, sql, list(doubles), places, (fn.__doc__ or "").strip())
        return fn
    return deco


def rounded(spec: QuerySpec) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spec.run(spark, sf_dir)
        if spec.doubles:
            df = df.withColumns({c: (rsig(df[c], int(p[1:])) if isinstance(p, str) else r6(df[c], p))
                                 for c, p in _places(spec)})
        return df
    run.__name__ = spec.qid
    run.__doc__ = spec.doc
    return run


def rounded_sql(spec: QuerySpec) -> str | None:
    if spec.sql is None:
        return None
    if not spec.doubles:
        return spec.sql
    rep = ", ".join((_sig_sql(c, int(p[1:])) if isinstance(p, str) else
                     f"round(CAST({c} AS DOUBLE), {p}) + 0.0") + f" AS {c}" for c, p in _places(spec))
    return f"SELECT * REPLACE ({rep}) FROM (\n{spec.sql}\n) AS q"


def _places(spec: QuerySpec) -> list[tuple[str, int]]:
    """``doubles`` entries are names (default places), ``name:places`` or ``name:sN``
    (N significant digits, for values whose magnitude varies widely)."""
    out = []
    for d in spec.doubles:
        name, _, p = d.partition(":")
        out.append((name, p if p.startswith("s") else (int(p) if p else spec.places)))
    return out


def _sig_sql(c: str, digits: int) -> str:
    e = f"pow(10.0, floor(log10(abs(CAST({c} AS DOUBLE)))))"
    return (f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN CAST({c} AS DOUBLE) "
            f"WHEN {c} = 0 THEN 0.0 ELSE round(CAST({c} AS DOUBLE) / {e}, {digits - 1}) * {e} + 0.0 END")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {qid: rounded(spec) for qid, spec in REGISTRY.items()}


def all_sql() -> dict[str, str]:
    _load()
    out = {}
    for qid, spec in REGISTRY.items():
        s = rounded_sql(spec)
        if s is not None:
            out[qid] = s
    return out


def _load():
    # importing the modules registers their queries
    from tabfid.plans import queries  # noqa: F401
