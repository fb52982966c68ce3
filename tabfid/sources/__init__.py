"""Sources and sinks: file readers/writers and table previews (ops A1-A7)."""

from tabfid.sources.io import (  # noqa: F401
    SUPPORTED, describe, load_table, preview, table_info, write_table,
)
