"""Row-wise operators also accept streaming DataFrames (see ``parse_stream``).

The consensus pipeline itself is two-pass and global, so it stays a batch job.
"""

from readloom.streaming.ingest import parse_stream  # noqa: F401
