"""Structured Streaming front of the raw-record parser."""

from __future__ import annotations

from pyspark.sql import DataFrame

from readloom.sources.error_parse import parse_records


def parse_stream(raw: DataFrame) -> DataFrame:
    """``parse_records`` over a stream of (raw_id, file_idx, raw) rows.

    The parser keeps no state between rows, so the stream needs no watermark; write the result
    with ``foreachBatch`` and split it on ``reason IS NULL``.
    """
    return parse_records(raw)
