"""Column-expression helpers (all JVM-side, codegen friendly)."""

from tabfid.functions.exprs import (  # noqa: F401
    is_numeric, numeric_columns, nan_to_null, r6, safe_div, zero_fill_col,
)
from tabfid.functions.hashing import portable_hash, hash_unit  # noqa: F401
