"""Incremental scoring.

The reference consumes whole files and has no streaming operators; its one
incremental behaviour is appending per-epoch metric rows.  This package runs
the same batch operators over a growing folder of candidate files with
Structured Streaming ``foreachBatch``, appending per-batch metrics.
"""
