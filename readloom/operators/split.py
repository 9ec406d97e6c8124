"""Pieces of a barcode-sorted read set, each with the same number of consecutive barcodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reads after which a file's running count is cut into another chunk.
CHUNK = 100_000


def split_by_barcodes(reads: DataFrame, start: int, length: int, size: int, chunk: int = CHUNK) -> DataFrame:
    """Reads with a barcode, with ``barcode``, ``run`` and ``file_no``: a new piece after ``size`` barcode runs.

    A run is a stretch of equal barcodes in file order; a barcode that comes back later starts a new
    run. Reads too short for a barcode, and null ones, are left out. Running counts are taken in
    chunks of a file, and the chunks are strung together by their ends.
    """
    if size < 1:
        raise ValueError("a piece holds at least one barcode")
    bc = F.when(F.length("seq") >= start + length, F.substring("seq", start + 1, length))
    rows = reads.withColumn("barcode", bc).where("barcode is not null").withColumn("_chunk", F.floor(F.col("read_idx") / chunk))
    inside = Window.partitionBy("file_idx", "_chunk").orderBy("read_idx")
    rows = rows.withColumn("_new", (F.col("barcode") != F.lag("barcode").over(inside)).cast("int"))
    rows = rows.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("file_idx", "_chunk").agg(
        F.min_by("barcode", "read_idx").alias("head"), F.max_by("barcode", "read_idx").alias("tail"), F.max("_run").alias("n")
    )
    chain = Window.partitionBy("file_idx").orderBy("_chunk")
    starts = F.coalesce((F.col("head") != F.lag("tail").over(chain)).cast("int"), F.lit(1))
    ends = ends.withColumn("_starts", starts)
    ends = ends.select(
        "file_idx", "_chunk", (F.sum(F.col("_starts") + F.col("n")).over(chain.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_base")
    )
    out = rows.join(ends, ["file_idx", "_chunk"]).withColumn("run", F.col("_base") + F.col("_run"))
    return out.withColumn("file_no", (F.floor((F.col("run") - 1) / size) + 1).cast("int")).drop("_chunk", "_new", "_run", "_base")
