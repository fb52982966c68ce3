"""The entry loads without the optional subpackage and without the packages that only it needs."""

import importlib.util
import sys
from pathlib import Path

import pytest

ENTRY = Path(__file__).parents[1] / "__spark_entry__.py"


def entry():
    spec = importlib.util.spec_from_file_location("entry_under_test", ENTRY)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.mark.parametrize("missing", ["ahocorasick", "sentencepiece", "xxhash", "public_tokenizers", "tabfid.llm"])
def test_other_queries_load_without(monkeypatch, missing):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.split(".")[0] == missing or name.startswith(missing):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in list(sys.modules):
        if name.startswith(("tabfid.llm", "corpus_pipeline", missing)):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    e = entry()
    assert len(e.queries()) > 110 and not any(q.startswith("op") for q in e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_free_names(spark):
    from tabfid.operators import encode as enc
    from tabfid.operators.missing import fit_mode_imputer
    from tabfid.operators.sampling import sample_rows
    df = spark.createDataFrame([(i, "ab"[i % 2], 1, 2, 3, 4, 5.0 if i % 3 else None) for i in range(40)],
                               "id int, v string, _c int, _VAL int, _h int, _need int, x double")
    e = enc.fit_label_encoder(df, "v")
    back = enc.invert_encoder(enc.apply_encoder(df, e), e)
    assert set(back.columns) == set(df.columns) and sorted(back.select(*df.columns).collect()) == sorted(df.collect())
    some = sample_rows(df, ["id"], 7)
    assert some.columns == df.columns and some.count() == 7
    assert fit_mode_imputer(df, ["v", "x", "id"]) == {"v": "a", "x": 5.0, "id": 0}
    assert fit_mode_imputer(df, []) == {} and fit_mode_imputer(df.limit(0), ["v"]) == {"v": None}
