"""End-to-end synthesis (op G6): type, fit, sample, restore columns, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabfid.operators import schema as sch
from tabfid.operators import synth
from tabfid.operators.pair import TablePair
from tabfid.operators.sampling import exact_quotas, match_size, rows_to_generate
from tabfid.operators.synth_tables import TableModel, proportional_quota
from tabfid.plans.report import evaluate_all


def synthesize(df: DataFrame, types: dict | None = None, rows_mode: str = "default",
               rows_value: float | None = None, exclude: list[str] | None = None,
               condition: str | None = None, ratios: dict | None = None,
               temperature: float | None = None, seed: int = 42, evaluate: bool = False,
               keys: list[str] | None = None, target: str | None = None, task: str = "classification",
               num_trees: int = 100, max_depth: int = 10) -> tuple[DataFrame, DataFrame | None]:
    """Returns (synthetic table, report or None).

    Steps: B5 select -> B1/B2 types -> G1 (G4 with ``condition``) fit -> H3 row count
    (H6 quotas for conditions) -> G2/G3 sample -> B6 restore excluded columns (typed
    nulls) -> Q6 report against a real sample of the same size (H2, needs ``keys``), with the ML utility of
    ``target`` if one is named.
    """
    original = df.schema
    work = sch.select_columns(df, exclude=exclude) if exclude else df
    kinds = sch.apply_overrides(sch.infer_types(work), types)
    n_rows = work.count()
    n = rows_to_generate(n_rows, rows_mode, rows_value)
    model = synth.fit_copula(work, kinds, condition=condition)
    if condition is not None:
        if ratios is None and isinstance(model, TableModel):
            size = proportional_quota(model, n)
        else:
            size = exact_quotas(ratios or dict(model.counts), n)
    else:
        size = n
    out = synth.sample_copula(df.sparkSession, model, size, seed=seed, temperature=temperature)
    if condition is not None:
        out = out.withColumn(condition, F.col(condition).cast(work.schema[condition].dataType))
    out = out.select(*[c for c in work.columns])
    out = sch.restore_columns(out, original)
    report = None
    if evaluate:
        if not keys:
            raise ValueError("evaluate=True needs unique row keys to sample the real side")
        cols = [c for c in work.columns if c not in keys]
        real = match_size(df.select(*dict.fromkeys([*keys, *cols])), n, keys, seed)
        report = evaluate_all(TablePair(real.select(*cols), out.select(*cols)), target=target, task=task, keys=keys,
                              keyed_real=real, num_trees=num_trees, max_depth=max_depth)
    return out, report
