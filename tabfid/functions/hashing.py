"""Portable row hash for repeatable splits and samples.

The first 31 bits of the MD5 of the seed and the keys' texts: any SQL engine can recompute
it (the oracle checks do exactly that), and keys may be of any type with a portable text
form - integers of either sign, strings, dates, booleans.  Cast doubles and timestamps to an
agreed text first.  A null key has a text of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the hash: output range, the separator of keys and the text of a null
MOD_OUT = 2147483648
SEPARATOR, NULL = "\x1f", "\x00"


def portable_hash(*keys: Column | str, seed: int = 42) -> Column:
    """The first 8 hex digits of md5(seed, keys), without the last bit: 0 to 2^31 - 1."""
    if not keys:
        raise ValueError("portable_hash needs at least one key column")
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(SEPARATOR, F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit(NULL)) for c in cols])
    return F.shiftright(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), 1)


def portable_hash_sql(keys: list[str], seed: int = 42) -> str:
    """The same hash as SQL text (used by oracle queries)."""
    parts = ", ".join(f"coalesce(CAST({k} AS VARCHAR), chr(0))" for k in keys)
    return f"(CAST('0x' || substr(md5(concat_ws(chr(31), '{seed}', {parts})), 1, 8) AS BIGINT) >> 1)"


def hash_unit(*keys: Column | str, seed: int = 42) -> Column:
    """Hash mapped to [0, 1)."""
    return portable_hash(*keys, seed=seed) / F.lit(float(MOD_OUT))
