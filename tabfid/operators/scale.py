"""Scaling with fitted state (ops X1-X7).

``fit_scaler`` runs one aggregate for all columns and returns a small state table (one
row per column); ``apply_scaler`` and ``invert_scaler`` are pure projections built from
that state, so they fuse into the surrounding stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfid.functions.exprs import INTEGRAL_TYPES

METHODS = ("standard", "minmax", "robust", "minmax01")
STATE_SCHEMA = ("column_name string, method string, shift double, scale double, lo double, "
                "hi double, fill double, dtype string, has_missing boolean, rows long")


@dataclass
class ScalerState:
    """Per-column fitted values: y = (x - shift) / scale; [lo, hi] = fitted range."""

    column: str
    method: str
    shift: float
    scale: float
    lo: float
    hi: float
    fill: float | None
    dtype: str
    has_missing: bool
    rows: int


def fit_scaler(df: DataFrame, cols: list[str], method: str = "standard",
               exact_quantiles: bool = True, accuracy: int = 100_000) -> dict[str, ScalerState]:
    """X1-X4/X6 fit: mean imputation state, then the method's statistics, in one pass.

    standard: mean and *population* std (zero -> 1).  minmax: to (-1, 1), zero range ->
    1.  robust: median and IQR with linear quantiles (zero -> 1).  minmax01: to (0, 1).
    The range [lo, hi] is measured after mean imputation (imputing the mean does not
    move min or max).
    """
    if method not in METHODS:
        raise ValueError(f"unknown scaling method {method!r}; use one of {METHODS}")
    if not cols:
        return {}
    fields = {f.name: f.dataType for f in df.schema.fields}
    by_cdf = method == "robust" and exact_quantiles  # no value map in one buffer
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        v = F.col(c).cast("double")
        v = F.when(~F.isnan(v), v)
        aggs += [F.count(v).alias(f"{c}__n"), F.avg(v).alias(f"{c}__mean"),
                 F.min(v).alias(f"{c}__lo"), F.max(v).alias(f"{c}__hi")]
        if method == "standard":
            aggs.append(F.stddev_pop(v).alias(f"{c}__sd"))
        if method == "robust" and not by_cdf:
            aggs.append(F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias(f"{c}__q"))
    row = df.agg(*aggs).first()
    rows = row["__rows"]
    if rows == 0:
        raise ValueError("cannot fit a scaler on an empty table")
    if by_cdf:   # exact quartiles without a per-column value map (large tables)
        from tabfid.operators.pair import exact_quantiles as _eq
        qs = {r["column_name"]: [r["q0"], r["q1"], r["q2"]] for r in _eq(df, cols, [0.25, 0.5, 0.75]).collect()}
    out = {}
    for c in cols:
        n, mean = row[f"{c}__n"], row[f"{c}__mean"]
        has_missing = n < rows
        lo, hi = row[f"{c}__lo"], row[f"{c}__hi"]
        if method == "standard":
            sd = row[f"{c}__sd"] or 0.0
            # imputing the mean keeps the mean and shrinks the population variance
            if has_missing and rows:
                sd = (sd * sd * n / rows) ** 0.5
            shift, scale = mean, (sd if sd > 0 else 1.0)
        elif method == "minmax":
            rng = (hi - lo) if hi is not None else 0.0
            rng = rng if rng > 0 else 1.0
            shift, scale = lo + rng / 2.0, rng / 2.0
        elif method == "minmax01":
            rng = (hi - lo) if hi is not None else 0.0
            shift, scale = lo, (rng if rng > 0 else 1.0)
        else:
            q = qs[c] if by_cdf else row[f"{c}__q"]
            if has_missing:
                q = _robust_with_fill(df, c, mean, exact_quantiles, accuracy)
            iqr = q[2] - q[0]
            shift, scale = q[1], (iqr if iqr > 0 else 1.0)
        out[c] = ScalerState(c, method, float(shift if shift is not None else 0.0), float(scale),
                             lo, hi, mean if has_missing else None, fields[c].simpleString(),
                             bool(has_missing), int(rows))
    return out


def _robust_with_fill(df, c, fill, exact, accuracy):
    v = F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(fill))
    if exact:
        from tabfid.operators.pair import exact_quantiles as _eq
        r = _eq(df.select(v.alias("v")), ["v"], [0.25, 0.5, 0.75]).first()
        return [r["q0"], r["q1"], r["q2"]]
    return df.agg(F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy).alias("q")).first()["q"]


def _filled(c: str, st: ScalerState) -> Column:
    v = F.col(c).cast("double")
    v = F.when(~F.isnan(v), v)
    return F.coalesce(v, F.lit(st.fill)) if st.fill is not None else v


def apply_scaler(df: DataFrame, state: dict[str, ScalerState]) -> DataFrame:
    """Scale each fitted column (missing values get the fitted mean first)."""
    ex = {}
    for c, st in state.items():
        y = (_filled(c, st) - F.lit(st.shift)) / F.lit(st.scale)
        ex[c] = y
    return df.withColumns(ex)


def invert_scaler(df: DataFrame, state: dict[str, ScalerState], clip: bool = True) -> DataFrame:
    """Null -> 0, unscale, clip to the fitted [min, max], round half-even and cast
    back for every integral original type.  Columns without state pass through."""
    ex = {}
    for c, st in state.items():
        if c not in df.columns:
            continue
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(st.scale) + F.lit(st.shift)
        if clip and st.lo is not None and st.hi is not None:
            x = F.least(F.greatest(x, F.lit(st.lo)), F.lit(st.hi))
        dt = T._parse_datatype_string(st.dtype)
        if isinstance(dt, INTEGRAL_TYPES):
            x = F.rint(x).cast(dt)
        ex[c] = x
    return df.withColumns(ex)


def state_frame(spark, state: dict[str, ScalerState]) -> DataFrame:
    """Fitted state as a DataFrame (one row per column) - can be saved as parquet."""
    return spark.createDataFrame(
        [(s.column, s.method, s.shift, s.scale, s.lo, s.hi, s.fill, s.dtype, s.has_missing, s.rows)
         for s in state.values()], STATE_SCHEMA)


def state_from_frame(frame: DataFrame) -> dict[str, ScalerState]:
    return {r["column_name"]: ScalerState(r["column_name"], r["method"], r["shift"], r["scale"], r["lo"],
                                          r["hi"], r["fill"], r["dtype"], r["has_missing"], r["rows"])
            for r in frame.collect()}


def minmax_on_real(real: DataFrame, synthetic: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(0, 1) scaling fitted on real, applied to both (synthetic may leave [0, 1])."""
    st = fit_scaler(real, cols, "minmax01")
    return apply_scaler(real, st), apply_scaler(synthetic, st)
