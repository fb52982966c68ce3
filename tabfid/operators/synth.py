"""Synthetic rows from a fitted Gaussian copula (ops G1-G5, G7).

This is a different estimator than the reference's neural generators: the *contract*
is kept (fit a table -> model; sample n rows, optionally conditioned, with a
temperature for categories), not the output.

* fit: marginals in one aggregate (quantile table per continuous / datetime column,
  ``percentile_approx``) and count jobs for categories and for the values of integer and ordinal
  columns; dependence = correlation of the rows' normal scores (partial sums in Arrow batches).
  Categories have no order, so columns of up to ``TREE_VALUES`` of them are joined by a tree of the largest
  mutual information (one job counts all their pairs).
  With a condition column every statistic is grouped by its value in the same jobs.
* sample: ``spark.range(n)`` -> ``mapInPandas``: per-row counter-based normals ->
  Cholesky factor -> normal CDF -> inverse marginal.  A category with a parent in the tree is drawn from its
  share given the parent's value, by the part of its normal that its ancestors' normals do not tell.
  Randomness depends only on (seed, row id), never on partitioning.

Only per-column statistics (up to ``MAX_POINTS`` quantile points, ``MAX_CATEGORIES`` values per
column) and k x k matrices reach the driver.  Past these bounds the model is kept as tables
(``synth_tables``); every function here takes both kinds of models.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabfid.functions.exprs import INTEGRAL_TYPES
from tabfid.functions.random import norm_cdf, norm_ppf, normals, uniforms
from tabfid.operators.model_store import find_version, publish
from tabfid.operators.schema import CATEGORICAL, CONTINUOUS, DATETIME, ORDINAL, infer_types
from tabfid.operators.synth_tables import TableModel, category_rows, count_values, fit_tables, quantile_rows, sample_tables

MAX_CATEGORIES = 100_000     # values per column, all strata together
SURELY = 1.25                # an estimate of that many times a bound (standard error 0.05) lies past it
MAX_POINTS = 2_000_000       # quantile points and entries of correlations, all strata and columns together
TREE_VALUES = 64             # categories of a column that takes part in the tree of dependences
TREE_SIGMA = 5.0             # how far the G statistic of an edge lies above its mean under independence
TEMPERATURE_ARGMAX = 0.5     # fixed: at or below this temperature categories take the mode
ALL = "__all__"
NULL_SEED = 1_000_003        # the choice of missing cells has a stream of its own
TREE_SEED = 2_000_003        # and so have categories that their parents' normals determine


@dataclass
class Marginal:
    name: str
    kind: str                      # continuous | categorical | datetime
    dtype: str
    quantiles: np.ndarray | None = None
    discrete: bool = False
    categories: list | None = None
    probs: np.ndarray | None = None
    values: np.ndarray | None = None   # of a discrete column, all with their shares in probs, sorted
    nulls: float = 0.0             # share of missing values


@dataclass
class CopulaModel:
    columns: list[str]
    marginals: dict                # stratum -> {column: Marginal}
    corr: dict                     # stratum -> k x k
    counts: dict                   # stratum -> rows
    condition: str | None = None
    n_quantiles: int = 1000
    meta: dict = field(default_factory=dict)
    tree: dict = field(default_factory=dict)   # stratum -> [(child, parent, shares of the child by parent value)]

    def strata(self) -> list:
        return list(self.marginals)


def _kinds(t: dict) -> dict:
    out = {}
    for c, k in t.items():
        out[c] = {CONTINUOUS: "continuous", ORDINAL: "continuous", DATETIME: "datetime",
                  CATEGORICAL: "categorical"}[k]
    return out


def _numeric_value(c: str, kind: str, dt: T.DataType):
    col = F.col(c)
    if kind == "datetime":
        return F.unix_micros(col.cast("timestamp")).cast("double") / 1e6
    v = col.cast("double")
    return F.when(~F.isnan(v), v)


def fit_copula(df: DataFrame, types: dict | None = None, condition: str | None = None,
               n_quantiles: int = 1000, accuracy: int | None = None) -> CopulaModel | TableModel:
    """G1 (and G4 with ``condition``): fit marginals and the normal-score correlation.

    A model beyond the driver's bounds, which are checked before anything is collected, is a ``TableModel``."""
    t = {**infer_types(df), **(types or {})}
    kinds = _kinds(t)
    if condition is not None:
        kinds.pop(condition, None)
    cols = list(kinds)
    fields = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if kinds[c] in ("continuous", "datetime")]
    cat = [c for c in cols if kinds[c] == "categorical"]
    g = F.col(condition).cast("string") if condition else F.lit(ALL)
    probs = [i / n_quantiles for i in range(n_quantiles + 1)]
    acc = accuracy or max(10_000, 10 * n_quantiles)
    # by semantic type: integer and ordinal columns only ever take values that were seen
    disc = [c for c in num if t[c] == ORDINAL or isinstance(fields[c], INTEGRAL_TYPES)]

    def as_tables() -> TableModel:
        base = df.select(g.alias("_g"), *[(F.col(c).cast("string") if kinds[c] == "categorical" else _numeric_value(
            c, kinds[c], fields[c])).alias(f"c{i}") for i, c in enumerate(cols)])
        return fit_tables(base, cols, kinds, {c: c in disc for c in cols}, {c: fields[c].simpleString() for c in cols},
                          condition, n_quantiles, acc)

    if condition is not None:
        most = MAX_POINTS // max(1, len(num) * (n_quantiles + 1) + len(cols) ** 2)
        if df.agg(F.approx_count_distinct(g)).first()[0] > SURELY * most or df.select(g.alias("_g")).distinct().limit(most + 1).count() > most:
            return as_tables()
    seen: dict = {}
    if disc or cat:
        at = {cols.index(c): _numeric_value(c, kinds[c], fields[c]) if c in disc else F.col(c).cast("string") for c in [*disc, *cat]}
        coded = df.select(g.alias("_g"), *[v.alias(f"c{i}") for i, v in at.items()])
        # a table far past the bound is not counted here only to be counted again there
        about = coded.agg(*[F.approx_count_distinct(F.struct("_g", f"c{i}") if condition else F.col(f"c{i}")) for i in at]).first()
        if max(about) > SURELY * MAX_CATEGORIES:
            return as_tables()
        vc = count_values(coded, "_g", list(at), {cols.index(c) for c in cat}).persist()
        try:
            if (vc.groupBy("column").count().agg(F.max("count")).first()[0] or 0) > MAX_CATEGORIES:
                return as_tables()
            for r in vc.collect():   # at most MAX_CATEGORIES per column
                seen.setdefault((r["_g"], cols[r["column"]]), []).append((r["s"] if r["x"] is None else r["x"], r["n"]))
        finally:
            vc.unpersist()
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in num:
        v = _numeric_value(c, kinds[c], fields[c])
        aggs += [F.percentile_approx(v, probs, acc).alias(f"{c}__q"), F.count(v).alias(f"{c}__m")]
    aggs += [F.count(c).alias(f"{c}__m") for c in cat]
    rows = df.groupBy(g.alias("_g")).agg(*aggs).collect()      # one row per stratum
    marg: dict = {r["_g"]: {} for r in rows}
    counts = {r["_g"]: int(r["__n"]) for r in rows}
    for r in rows:
        for c in num:
            q = np.array([x for x in (r[f"{c}__q"] or []) if x is not None], dtype=float)
            marg[r["_g"]][c] = Marginal(c, kinds[c], fields[c].simpleString(), q,
                                        discrete=c in disc)
        for c in cat:  # a column without any value keeps an empty list
            marg[r["_g"]][c] = Marginal(c, "categorical", fields[c].simpleString(), categories=[], probs=np.zeros(0))
        for c in cols:
            marg[r["_g"]][c].nulls = 1 - r[f"{c}__m"] / max(r["__n"], 1)
    for (s, c), vals in seen.items():
        vals.sort()
        p = np.array([n for _, n in vals], dtype=float)
        m = marg[s][c]
        m.probs = p / p.sum()
        if c in cat:
            m.categories = [v for v, _ in vals]
        else:
            m.values = np.array([v for v, _ in vals], dtype=float)
    model = CopulaModel(cols, marg, {}, counts, condition, n_quantiles,
                        {"kinds": kinds, "types": {c: fields[c].simpleString() for c in cols}})
    model.corr = _fit_corr(df, model, g)
    model.tree = _fit_tree(df, model, g)
    return model


def _fit_tree(df: DataFrame, model: CopulaModel, g) -> dict:
    """Per stratum the forest of largest mutual information among its categorical columns, parents first.

    One job counts the pairs of values of all pairs of columns (at most ``TREE_VALUES`` squared each).  An edge
    is only taken if the pair's G statistic is out of reach of independent columns."""
    cats = [c for c in model.columns if model.meta["kinds"][c] == "categorical"
            and 2 <= max((len(m[c].categories) for m in model.marginals.values()), default=0) <= TREE_VALUES]
    pairs = [(a, b) for i, a in enumerate(cats) for b in cats[i + 1:]]
    if not pairs:
        return {}
    long = df.select(g.alias("_g"), F.inline(F.array(*[F.struct(
        F.lit(i).alias("pair"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for i, (a, b) in enumerate(pairs)])))
    cells = long.where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("_g", "pair", "a", "b").count()
    tables: dict = {}
    for r in cells.toLocalIterator():   # strata x pairs x TREE_VALUES^2 at most
        ms = model.marginals[r["_g"]]
        a, b = pairs[r["pair"]]
        key = (r["_g"], r["pair"])
        if key not in tables:
            tables[key] = ({v: i for i, v in enumerate(ms[a].categories)}, {v: i for i, v in enumerate(ms[b].categories)},
                           np.zeros((len(ms[a].categories), len(ms[b].categories))))
        ia, ib, t = tables[key]
        t[ia[r["a"]], ib[r["b"]]] = r["count"]
    out: dict = {}
    for s in model.marginals:
        edges = []
        for i, (a, b) in enumerate(pairs):
            if (s, i) in tables:
                t = tables[s, i][2]
                n, free = t.sum(), (t.shape[0] - 1) * (t.shape[1] - 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    mi = float(np.nansum(t / n * np.log(t * n / np.outer(t.sum(1), t.sum(0)))))
                if free and 2 * n * mi > free + TREE_SIGMA * np.sqrt(2 * free):
                    edges.append((-mi, a, b, t))
        edges.sort(key=lambda e: e[:3])
        root = {c: c for c in cats}

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        near: dict = {c: [] for c in cats}
        for _, a, b, t in edges:
            if find(a) != find(b):
                root[find(b)] = find(a)
                near[a].append((b, t))
                near[b].append((a, t.T))
        seen, todo, found = set(), list(cats), []
        while todo:
            c = todo.pop(0)
            if c in seen:
                continue
            seen.add(c)
            stack = [c]
            while stack:
                p = stack.pop()
                for child, t in near[p]:
                    if child not in seen:
                        seen.add(child)
                        stack.append(child)
                        rest = t.sum(1, keepdims=True)   # a parent value never seen with a child: its marginal shares
                        found.append((child, p, np.where(rest > 0, t / np.maximum(rest, 1), model.marginals[s][child].probs)))
        if found:
            out[s] = found
    return out


def _residuals(chol: np.ndarray, columns: list[str], tree: list) -> dict:
    """For each child of a tree: (its ancestors' indices, their weights, the spread that is left)."""
    corr, parent, out = chol @ chol.T, {c: p for c, p, _ in tree}, {}
    for c in parent:
        up, at = [], c
        while at in parent:
            at = parent[at]
            up.append(columns.index(at))
        i = columns.index(c)
        w = np.linalg.lstsq(corr[np.ix_(up, up)], corr[up, i], rcond=None)[0]
        out[c] = (up, w, float(np.sqrt(max(1.0 - corr[i, up] @ w, 0.0))))
    return out


def _scores(pdf: pd.DataFrame, ms: dict, cols: list[str]) -> np.ndarray:
    """normal scores of each value under its marginal (mid-rank on the quantile grid)."""
    out = np.zeros((len(pdf), len(cols)))
    for j, c in enumerate(cols):
        m = ms.get(c)
        if m is None:
            continue
        if not len(m.categories if m.kind == "categorical" else m.quantiles):
            continue  # no value seen: no dependence
        if m.kind == "categorical":
            cum = np.cumsum(m.probs)
            mid = dict(zip(m.categories, cum - m.probs / 2))
            u = pdf[c].map(mid).astype(float).fillna(0.5).to_numpy()
        elif m.values is not None:
            x = pdf[c].astype(float).to_numpy()
            mid = np.append(np.cumsum(m.probs) - m.probs / 2, 0.5)
            u = mid[np.where(np.isnan(x), len(m.values), np.searchsorted(m.values, x))]
        else:
            q = m.quantiles
            x = pdf[c].astype(float).to_numpy()
            n = len(q)
            lo, hi = np.searchsorted(q, x, "left"), np.searchsorted(q, x, "right")
            u = np.clip((lo + hi) / (2.0 * n), 0.5 / n, 1 - 0.5 / n)
            u = np.where(np.isnan(x), 0.5, u)
        out[:, j] = norm_ppf(u)
    return out


def _fit_corr(df: DataFrame, model: CopulaModel, g) -> dict:
    """Correlation of the rows' normal scores per stratum.

    Each Arrow batch turns its rows into normal scores and emits only its partial
    sums (n, sum z, sum z z^T) as (stratum, i, j, value) rows; a group-by adds them up.
    Scores never leave the Python worker and the JVM aggregate is a plain sum."""
    cols = model.columns
    kinds = model.meta["kinds"]
    fields = {f.name: f.dataType for f in df.schema.fields}
    sel = [g.alias("_g")] + [
        (_numeric_value(c, kinds[c], fields[c]) if kinds[c] != "categorical"
         else F.col(c).cast("string")).alias(c) for c in cols]
    src = df.select(*sel)
    bmarg = df.sparkSession.sparkContext.broadcast(model.marginals)
    k = len(cols)

    def partial(batches):
        ms_all = bmarg.value
        for pdf in batches:
            out = []
            for s, part in pdf.groupby("_g", dropna=False):
                s = None if pd.isna(s) else s
                z = _scores(part, ms_all[s], cols)
                sums = np.zeros((k + 1, k + 1))
                zz = np.hstack([np.ones((len(z), 1)), z])
                sums += zz.T @ zz                       # [0,0]=n, [0,1:]=sum z, [1:,1:]=sum zz
                ii, jj = np.triu_indices(k + 1)
                out.append(pd.DataFrame({"_g": s, "i": ii.astype("int32"), "j": jj.astype("int32"),
                                         "v": sums[ii, jj]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    parts = src.mapInPandas(partial, "_g string, i int, j int, v double")
    tot = parts.groupBy("_g", "i", "j").agg(F.sum("v").alias("v")).collect()   # strata x k^2 rows
    acc: dict = {}
    for r in tot:
        m = acc.setdefault(r["_g"], np.zeros((k + 1, k + 1)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    res = {s: np.eye(k) for s in model.marginals}
    for s, m in acc.items():
        n = m[0, 0]
        if n < 2:
            continue
        mean = m[0, 1:] / n
        cov = m[1:, 1:] / n - np.outer(mean, mean)
        d = np.sqrt(np.clip(np.diag(cov), 0, None))
        with np.errstate(divide="ignore", invalid="ignore"):
            c = cov / np.outer(d, d)
        c = np.nan_to_num(c, nan=0.0, posinf=0.0, neginf=0.0)
        np.fill_diagonal(c, 1.0)
        res[s] = np.clip(c, -1.0, 1.0)
    return res


def _cholesky(c: np.ndarray) -> np.ndarray:
    """Of one matrix, or of each of a stack of matrices."""
    w, v = np.linalg.eigh((c + c.swapaxes(-1, -2)) / 2)
    w = np.clip(w, 1e-9, None)
    fixed = (v * w[..., None, :]) @ v.swapaxes(-1, -2)
    d = np.sqrt(np.diagonal(fixed, axis1=-2, axis2=-1))
    return np.linalg.cholesky(fixed / (d[..., :, None] * d[..., None, :]))


def _tempered(p: np.ndarray, temperature: float | None) -> np.ndarray:
    """p^(1/T) renormalised when T > 0.5; the mode alone when T <= 0.5."""
    if temperature is None:
        return p
    if temperature <= TEMPERATURE_ARGMAX:
        out = np.zeros_like(p)
        out[int(np.argmax(p))] = 1.0
        return out
    t = np.power(p, 1.0 / temperature)
    return t / t.sum()


def _values(m: Marginal, u: np.ndarray, temperature: float | None):
    if not len(m.categories if m.kind == "categorical" else m.quantiles):
        return np.full(len(u), None if m.kind == "categorical" else np.nan, dtype=object)
    if m.kind == "categorical":
        cum = np.cumsum(_tempered(m.probs, temperature))
        idx = np.minimum(np.searchsorted(cum, u, side="right"), len(cum) - 1)
        return np.asarray(m.categories, dtype=object)[idx]
    if m.values is not None:
        return m.values[np.minimum(np.searchsorted(np.cumsum(m.probs), u, side="right"), len(m.values) - 1)]
    return np.interp(u, np.linspace(0.0, 1.0, len(m.quantiles)), m.quantiles)


def _schema(model: CopulaModel) -> str:
    parts = []
    if model.condition:
        parts.append(f"`{model.condition}` string")
    for c in model.columns:
        kind = model.meta["kinds"][c]
        t = model.meta["types"][c]
        if kind == "categorical":
            parts.append(f"`{c}` string")
        elif kind == "datetime":
            parts.append(f"`{c}` double")
        else:
            dt = T._parse_datatype_string(t)
            parts.append(f"`{c}` {'bigint' if isinstance(dt, INTEGRAL_TYPES) else 'double'}")
    return ", ".join(parts)


def sample_copula(spark: SparkSession, model: CopulaModel | TableModel, n: int | dict | DataFrame, seed: int = 42,
                  temperature: float | None = None, num_partitions: int | None = None) -> DataFrame:
    """N rows (or {stratum: rows}; a ``TableModel`` also takes a table (stratum, rows)); row i uses the
    stream of id i only."""
    if isinstance(model, TableModel):
        return _typed(sample_tables(spark, model, n, seed, temperature), model)
    quota = n if isinstance(n, dict) else {model.strata()[0]: int(n)}
    strata = [s for s in quota if quota[s] > 0]
    missing = [s for s in strata if s not in model.marginals]
    if missing:
        raise ValueError(f"no fitted stratum for {missing}")
    offsets, total = {}, 0
    for s in strata:
        offsets[s] = total
        total += int(quota[s])
    bounds = np.array([offsets[s] for s in strata] + [total], dtype=np.int64)
    chol = {s: _cholesky(model.corr[s]) for s in strata}
    tree = {} if temperature is not None and temperature <= TEMPERATURE_ARGMAX else {s: model.tree[s] for s in strata if s in model.tree}
    rest = {s: _residuals(chol[s], model.columns, t) for s, t in tree.items()}
    payload = spark.sparkContext.broadcast((model.marginals, chol, bounds, strata, tree, rest))
    cols, kinds, cond = model.columns, model.meta["kinds"], model.condition
    types = model.meta["types"]
    integral = {c for c in cols if kinds[c] == "continuous"
                and isinstance(T._parse_datatype_string(types[c]), INTEGRAL_TYPES)}
    k = len(cols)

    def gen(batches):
        marg, ch, bnd, sts, trees, residuals = payload.value
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            which = np.searchsorted(bnd, ids, side="right") - 1
            out = {c: np.empty(len(ids), dtype=object) for c in cols}
            z_all = normals(ids, k, seed)
            holes = uniforms(ids, k, seed + NULL_SEED)
            for si in np.unique(which):
                s = sts[si]
                rows = which == si
                z = z_all[rows] @ ch[s].T
                u = norm_cdf(z)
                at: dict = {}   # number of the category drawn, for columns of the tree
                edges = {c: (p, t) for c, p, t in trees.get(s, [])}
                parents = {p for p, _ in edges.values()}
                for c in [*[c for c in cols if c not in edges], *edges]:
                    j, m = cols.index(c), marg[s][c]
                    if c in edges:
                        p, shares = edges[c]
                        up, w, left = residuals[s][c]
                        own = norm_cdf((z[:, j] - z[:, up] @ w) / left) if left > 1e-3 else uniforms(ids[rows], k, seed + TREE_SEED)[:, j]
                        if temperature is not None:
                            shares = np.stack([_tempered(x, temperature) for x in shares])
                        upto = np.cumsum(shares, axis=1)[at[p]]
                        at[c] = np.minimum((own[:, None] >= upto).sum(axis=1), shares.shape[1] - 1)
                        v = np.asarray(m.categories, dtype=object)[at[c]]
                    else:
                        v = np.asarray(_values(m, u[:, j], temperature), dtype=object)
                        if c in parents:
                            upto = np.cumsum(_tempered(m.probs, temperature))
                            at[c] = np.minimum(np.searchsorted(upto, u[:, j], side="right"), len(upto) - 1)
                    v[holes[rows, j] < m.nulls] = None  # missing at the fitted share
                    out[c][rows] = v
            res = pd.DataFrame()
            if cond:
                res[cond] = np.asarray(sts, dtype=object)[which]
            for c in cols:
                if kinds[c] == "categorical":
                    res[c] = out[c]
                elif kinds[c] == "datetime":
                    res[c] = out[c].astype(float)          # epoch seconds, converted in the JVM
                elif c in integral:
                    x = np.rint(out[c].astype(float))
                    res[c] = pd.array(np.where(np.isnan(x), 0, x).astype("int64"), dtype="Int64")
                    res.loc[np.isnan(x), c] = pd.NA
                else:
                    res[c] = out[c].astype(float)
            yield res

    rng = spark.range(0, total, numPartitions=num_partitions) if num_partitions else spark.range(0, total)
    out = rng.mapInPandas(gen, _schema(model))
    return _typed(out, model)


def _typed(out: DataFrame, model: CopulaModel | TableModel) -> DataFrame:
    """Generated columns in the types of the fitted table; integers are rounded half to even, times are seconds."""
    casts = {}
    for c in model.columns:
        t, kind = model.meta["types"][c], model.meta["kinds"][c]
        if kind == "datetime":
            casts[c] = F.timestamp_micros(F.round(F.col(c) * 1e6).cast("long")).cast(t)
        elif kind != "categorical":
            whole = isinstance(T._parse_datatype_string(t), INTEGRAL_TYPES) and dict(out.dtypes)[c] == "double"
            casts[c] = (F.rint(c) if whole else F.col(c)).cast(t)
    return out.withColumns(casts) if casts else out


# ------------------------------------------------------------------ G7 save / load

def save_model(spark: SparkSession, model: CopulaModel | TableModel, path: str, name: str, version: str) -> str:
    """The fitted state as parquet tables, published as a version of ``name`` (``model_store``); returns their folder."""
    meta = {"columns": model.columns, "condition": model.condition, "n_quantiles": model.n_quantiles, **model.meta}
    if isinstance(model, TableModel):
        tables = {"strata": model.strata, "values": model.values, "meta": spark.createDataFrame([(json.dumps(meta),)], "meta string")}
        return publish(spark, path, name, version, "tables", tables)
    q_rows, c_rows, r_rows, n_rows, v_rows = [], [], [], [], []
    for s, ms in model.marginals.items():
        for c, m in ms.items():
            if m.kind == "categorical":
                c_rows += [(s, c, str(v), float(p), i) for i, (v, p) in enumerate(zip(m.categories, m.probs))]
            else:
                q_rows += [(s, c, i, float(x), m.discrete) for i, x in enumerate(m.quantiles)]
            if m.values is not None:
                v_rows += [(s, c, float(v), float(p)) for v, p in zip(m.values, m.probs)]
            n_rows.append((s, c, m.discrete, float(m.nulls)))
        cm = model.corr[s]
        r_rows += [(s, i, j, float(cm[i, j])) for i in range(len(cm)) for j in range(len(cm))]
    meta["counts"] = list(model.counts.items())
    return publish(spark, path, name, version, "rows", {
        "quantiles": spark.createDataFrame(q_rows, "stratum string, column_name string, i int, q double, discrete boolean"),
        "categories": spark.createDataFrame(c_rows, "stratum string, column_name string, value string, p double, code int"),
        "correlation": spark.createDataFrame(r_rows, "stratum string, i int, j int, corr double"),
        "values": spark.createDataFrame(v_rows, "stratum string, column_name string, value double, p double"),
        "columns": spark.createDataFrame(n_rows, "stratum string, column_name string, discrete boolean, nulls double"),
        "tree": spark.createDataFrame([(s, at, c, p, i, t[i].tolist()) for s, edges in model.tree.items() for at, (c, p, t) in enumerate(edges)
                                       for i in range(len(t))],
                                      "stratum string, at int, child string, parent string, code int, shares array<double>"),
        "meta": spark.createDataFrame([(json.dumps(meta),)], "meta string")})


def load_model(spark: SparkSession, path: str, name: str, version: str | None = None) -> CopulaModel | TableModel:
    """A saved model, the last saved one without ``version``."""
    base, kind = find_version(spark, path, name, version)
    if kind == "tables":
        meta = json.loads(spark.read.parquet(f"{base}/meta").first()["meta"])
        rest = {k: v for k, v in meta.items() if k not in ("columns", "condition", "n_quantiles")}
        return TableModel(meta["columns"], spark.read.parquet(f"{base}/strata"), spark.read.parquet(f"{base}/values"),
                          meta["condition"], meta["n_quantiles"], rest)
    meta = json.loads(spark.read.parquet(f"{base}/meta").first()["meta"])
    kinds, types = meta["kinds"], meta["types"]
    counts = {s: int(n) for s, n in meta["counts"]}
    marg: dict = {s: {} for s in counts}
    for r in spark.read.parquet(f"{base}/columns").collect():
        s, c = r["stratum"], r["column_name"]
        empty = {"categories": [], "probs": np.zeros(0)} if kinds[c] == "categorical" else {"quantiles": np.zeros(0)}
        marg[s][c] = Marginal(c, kinds[c], types[c], discrete=r["discrete"], nulls=r["nulls"], **empty)
    q = spark.read.parquet(f"{base}/quantiles").orderBy("stratum", "column_name", "i").collect()
    tmp: dict = {}
    for r in q:
        tmp.setdefault((r["stratum"], r["column_name"]), ([], r["discrete"]))[0].append(r["q"])
    for (s, c), (vals, disc) in tmp.items():
        marg[s][c].quantiles = np.array(vals)
    cats: dict = {}
    for r in spark.read.parquet(f"{base}/categories").orderBy("stratum", "column_name", "code").collect():
        cats.setdefault((r["stratum"], r["column_name"]), []).append((r["value"], r["p"]))
    for (s, c), vals in cats.items():
        marg[s][c].categories, marg[s][c].probs = [v for v, _ in vals], np.array([p for _, p in vals])
    seen: dict = {}
    for r in spark.read.parquet(f"{base}/values").orderBy("stratum", "column_name", "value").collect():
        seen.setdefault((r["stratum"], r["column_name"]), []).append((r["value"], r["p"]))
    for (s, c), vals in seen.items():
        marg[s][c].values, marg[s][c].probs = np.array([v for v, _ in vals]), np.array([p for _, p in vals])
    k = len(meta["columns"])
    corr = {s: np.eye(k) for s in marg}
    for r in spark.read.parquet(f"{base}/correlation").collect():
        corr[r["stratum"]][r["i"], r["j"]] = r["corr"]
    edges: dict = {}
    for r in spark.read.parquet(f"{base}/tree").orderBy("stratum", "at", "code").collect():
        edges.setdefault(r["stratum"], {}).setdefault(r["at"], (r["child"], r["parent"], []))[2].append(r["shares"])
    tree = {s: [(c, p, np.array(t)) for _, (c, p, t) in sorted(e.items())] for s, e in edges.items()}
    return CopulaModel(meta["columns"], marg, corr, counts,
                       meta["condition"], meta["n_quantiles"], {"kinds": kinds, "types": types}, tree)


def quantile_table(spark: SparkSession, model: CopulaModel | TableModel) -> DataFrame:
    """G1 output as a table: (stratum, column_name, i, q)."""
    if isinstance(model, TableModel):
        return quantile_rows(model)
    rows = [(s, c, i, float(x)) for s, ms in model.marginals.items() for c, m in ms.items()
            if m.kind != "categorical" for i, x in enumerate(m.quantiles)]
    return spark.createDataFrame(rows, "stratum string, column_name string, i int, q double")


def category_table(spark: SparkSession, model: CopulaModel | TableModel, temperature: float | None = None) -> DataFrame:
    """G1/G3 output: (stratum, column_name, value, p) with optional temperature."""
    if isinstance(model, TableModel):
        return category_rows(model, temperature)
    rows = [(s, c, str(v), float(p)) for s, ms in model.marginals.items() for c, m in ms.items()
            if m.kind == "categorical" for v, p in zip(m.categories, _tempered(m.probs, temperature))]
    return spark.createDataFrame(rows, "stratum string, column_name string, value string, p double")


