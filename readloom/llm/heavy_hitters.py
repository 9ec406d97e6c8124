"""Most frequent values of columns in memory that does not grow with the distinct values."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.text import value_of

SUMMARY = "field_name string, item string, upper long, error long, floor long, part long"


class SpaceSaving:
    """At most ``capacity`` counters; each holds an upper bound of its item's count and the most it may be too high.

    ``floor`` bounds the count of any item without a counter.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.floor = 0
        self.counts: dict[str, tuple[int, int]] = {}

    def merge(self, other: dict[str, tuple[int, int]], other_floor: int = 0) -> None:
        mine, floor = self.counts, self.floor
        out = {}
        for item, (n, e) in other.items():
            m = mine.pop(item, None)
            out[item] = (n + m[0], e + m[1]) if m else (n + floor, e + floor)
        for item, (n, e) in mine.items():
            out[item] = (n + other_floor, e + other_floor)
        self.floor += other_floor
        if len(out) > self.capacity:
            ranked = sorted(out.items(), key=lambda x: (-x[1][0], x[0]))
            self.floor = max(self.floor, ranked[self.capacity][1][0])
            out = dict(ranked[: self.capacity])
        self.counts = out

    def frame(self, field: str, part: int) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "field_name": field,
                "item": list(self.counts),
                "upper": [n for n, _ in self.counts.values()],
                "error": [e for _, e in self.counts.values()],
                "floor": self.floor,
                "part": part,
            }
        )


def _partition_summaries(fields: list[str], capacity: int):
    def run(batches):
        from pyspark import TaskContext

        made = {f: SpaceSaving(capacity) for f in fields}
        for b in batches:
            for i, f in enumerate(fields):
                counted = pc.value_counts(b.column(i).drop_null())
                items, counts = counted.field("values"), counted.field("counts")
                if len(items) > capacity:  # the batch's own summary: its rare items only raise the floor
                    top = pc.select_k_unstable(counts, len(items), [("", "descending")])[: capacity + 1]
                    floor = counts[top[capacity].as_py()].as_py()
                    top = top[:capacity]
                    items, counts = items.take(top), counts.take(top)
                else:
                    floor = 0
                made[f].merge(dict(zip(items.to_pylist(), ((n, 0) for n in counts.to_pylist()))), floor)
        part = TaskContext.get().partitionId()
        for f, s in made.items():
            if s.counts:
                yield pa.RecordBatch.from_pandas(s.frame(f, part), preserve_index=False)

    return run


def _merge_group(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = SpaceSaving(capacity)
        for _, g in sorted(pdf.groupby("part"), key=lambda x: x[0]):
            out.merge(dict(zip(g["item"], zip(g["upper"].tolist(), g["error"].tolist()))), int(g["floor"].iloc[0]))
        return out.frame(key[0], int(key[1]))

    return run


def summaries(df: DataFrame, fields: list[str], capacity: int, fan_in: int = 16) -> DataFrame:
    """One summary for each field, merged in a tree of the given fan-in over the partitions' summaries.

    A node holds fan_in * capacity counters, whatever the size of the input.
    """
    cols = df.select(*fields)
    level = cols.mapInArrow(_partition_summaries(fields, capacity), SUMMARY)
    parts = max(1, cols.rdd.getNumPartitions())
    for _ in range(max(1, math.ceil(math.log(max(2, parts), fan_in)))):
        level = (
            level.withColumn("_to", F.floor(F.col("part") / fan_in).cast("long"))
            .groupBy("field_name", "_to")
            .applyInPandas(_merge_group(capacity), SUMMARY)
        )
    return level


def frequent_items(df: DataFrame, fields: list[str], share: float = 0.002, capacity: int | None = None) -> DataFrame:
    """The values that hold at least ``share`` of all rows, with approximate and exact counts.

    Space-saving summaries of the partitions are merged in a tree; with ``capacity`` counters (by
    default 4/share) an upper count is too high by at most rows/capacity for each level of merging.
    No item at or over the share can be missing, since its upper count is no less than its count.
    The items whose upper count reaches the share are at most ``capacity`` for each field, so they
    are broadcast, and a second pass counts exactly these.

    Values are compared as given, so normalise them first. Nulls are in no summary but count in the
    total. Ties at the share all come out. An empty input gives an empty result. Other columns are
    ignored.

    Columns: field_name, item, approx_count, max_error (approx_count - max_error <= count <=
    approx_count), n_rows (exact).
    """
    capacity = capacity or math.ceil(4 / share)
    least = df.count() * share - 1e-9
    found = (
        summaries(df, fields, capacity)
        .where(F.col("upper") >= F.lit(least))
        .select("field_name", "item", F.col("upper").alias("approx_count"), F.col("error").alias("max_error"))
    )
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("item")) for f in fields])).alias("_p")
    ).select("_p.field_name", "_p.item")
    exact = (
        pairs.join(F.broadcast(found), ["field_name", "item"])
        .groupBy("field_name", "item", "approx_count", "max_error")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return exact.where(F.col("n_rows") >= F.lit(least))


def frequent_reads(reads: DataFrame, share: float = 0.002) -> DataFrame:
    """``frequent_items`` of bc and seq in upper case with white space removed at both ends."""
    return frequent_items(reads.select(value_of("bc").alias("bc"), value_of("seq").alias("seq")), ["bc", "seq"], share)
