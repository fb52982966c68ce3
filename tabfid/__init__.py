"""tabfid: synthetic-table profiling, transforms, generation and fidelity metrics on Spark.

Every operator takes and returns DataFrames.  Work that grows with the data runs as
Spark aggregations, windows and joins; the driver only ever holds per-column
statistics, k x k matrices (k = number of columns) and bounded result tables.
"""

__version__ = "0.1.0"
