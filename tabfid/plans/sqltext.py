"""SQL text helpers for the oracle queries (DuckDB dialect, plain ANSI where possible)."""

from __future__ import annotations

from tabfid.plans.fixtures import PAIR_CATEGORICAL, PAIR_NUMERIC

NUMERIC_SET = {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
               "l_extendedprice", "l_discount", "l_tax"}


def _syn_expr(c: str, changed: bool) -> str:
    if changed and c == "l_quantity":
        return "(l_quantity + l_partkey % 3)"
    if changed and c == "l_extendedprice":
        return "(l_extendedprice * 1.05)"
    return c


def pair_cte(cols: list[str] | None = None, changed: bool = True) -> str:
    """CTEs ``real`` and ``syn``: the lineitem halves, numerics as DOUBLE."""
    cols = cols or (PAIR_NUMERIC + PAIR_CATEGORICAL)

    def sel(side_syn: bool) -> str:
        parts = []
        for c in cols:
            e = _syn_expr(c, changed) if side_syn else c
            if c in NUMERIC_SET:
                parts.append(f"CAST({e} AS DOUBLE) AS {c}")
            else:
                parts.append(f"{e} AS {c}")
        return ", ".join(parts)

    return (f"real AS (SELECT {sel(False)} FROM lineitem WHERE l_orderkey % 2 = 0),\n"
            f"syn AS (SELECT {sel(True)} FROM lineitem WHERE l_orderkey % 2 = 1)")


def melted_cte(name: str, src: str, cols: list[str]) -> str:
    """``name(column_name, value)`` = UNION ALL of each column of ``src``."""
    parts = [f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def union_rows(rows: list[str]) -> str:
    return "\nUNION ALL\n".join(rows)


NULLS_CTE = ("li_nulls AS (SELECT * REPLACE ("
             "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_quantity END AS l_quantity, "
             "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag) "
             "FROM lineitem)")

# Spark type names of the lineitem columns (as ``DataType.simpleString``)
LINEITEM_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                  ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                  ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                  ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
