"""Structured Streaming versions of the training-log analytics."""

from tabfid.streaming.runlog_stream import (  # noqa: F401
    early_stopping_stream, epoch_means_stream, run_stream_to_table, run_summary_stream,
)
