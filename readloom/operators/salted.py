"""Per-key results when a few keys own most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.text import value_of


#: A key is hot if it owns more than 1/HOT of the rows, and at least HOT_ROWS; there are at most HOT such keys.
HOT = 64
HOT_ROWS = 10_000
SALTS = 32


def hot_keys(df: DataFrame, key: str, rows: int, weight: str | None = None) -> list:
    """The at most HOT hot keys of a table of ``rows`` rows, or of one with the rows of each key in ``weight``."""
    least = max(rows // HOT, HOT_ROWS)
    if rows <= least:
        return []
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return [r[0] for r in df.where(F.col(key).isNotNull()).groupBy(key).agg(n.alias("_n")).where(F.col("_n") > least).select(key).collect()]


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, by: str, hot: list, how: str = "inner") -> DataFrame:
    """Join with a table of one row for each key, hot keys spread over salts by a hash of column ``by``."""
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    left = rows.withColumn("_s", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(table.withColumn("_s", F.explode(salts)), [key, "_s"], how).drop("_s")


def heavy_keys(df: DataFrame, key: str, total: int, share: float, rows_per_salt: int) -> DataFrame:
    """(key, salts) of the keys that own at least ``share`` of the rows.

    At most 1/share rows come out, so the result may be broadcast whatever the input's size.
    """
    least = max(1, int(total * share))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= least)
        .select(key, F.ceil(F.col("_n") / F.lit(float(rows_per_salt))).cast("int").alias("_salts"))
    )


def group_summary(
    reads: DataFrame,
    key: str = "bc",
    value: str = "seq",
    time: str = "loaded_at",
    share: float = 0.001,
    splits: int = 256,
    total: int | None = None,
) -> DataFrame:
    """Two-stage salted aggregation: rows, distinct values and time span of each key.

    Stage one aggregates by (key, salt, value). The salt is 0 for light keys; a heavy key is
    spread over as many salts as keep one salt near 1/``splits`` of all rows (``total``, counted if not given). The salt is a hash of
    the value, pseudo-random yet the same when a lost task is run again, and it keeps one value in
    one salt, so the distinct counts of the salts add up. Stage two reduces each (key, salt) to a
    partial, stage three merges the partials of a key. All three combine before they shuffle.

    Keys and values are compared in upper case with white space removed at both ends. Null keys
    belong to no group and are left out; null values count as rows but not as distinct values;
    null times are ignored. An empty input gives an empty result; other columns are ignored.

    Columns: bc, n_reads, n_distinct_seq, first_loaded_at, last_loaded_at (named after key,
    value and time), plus ``n_salts``, over how many partials the key was spread.
    """
    rows = reads.select(value_of(key).alias("_k"), value_of(value).alias("_v"), F.col(time).alias("_t"))
    total = reads.count() if total is None else total
    heavy = heavy_keys(rows, "_k", total, share, max(1, total // splits))
    salted = (
        rows.where(F.col("_k").isNotNull())
        .join(F.broadcast(heavy), "_k", "left")
        .withColumn(
            "_salt",
            F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64("_v", "_k"), F.col("_salts")).cast("int")
            ),
        )
    )
    by_value = salted.groupBy("_k", "_salt", "_v").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi")
    )
    partials = by_value.groupBy("_k", "_salt").agg(
        F.sum("_n").alias("_n"), F.count("_v").alias("_d"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")
    )
    return partials.groupBy(F.col("_k").alias(key)).agg(
        F.sum("_n").alias("n_reads"),
        F.sum("_d").alias(f"n_distinct_{value}"),
        F.min("_lo").alias(f"first_{time}"),
        F.max("_hi").alias(f"last_{time}"),
        F.count(F.lit(1)).alias("n_salts"),
    )


def heavy_groups(reads: DataFrame, share: float = 0.01, key: str = "bc") -> DataFrame:
    """The keys of ``group_summary`` that hold at least ``share`` of all rows, null keys counted in the total."""
    total = reads.count()
    least = share * total - 1e-9  # the product of two floats may lie just above a whole number
    return group_summary(reads, key, total=total).where(F.col("n_reads") >= F.lit(least)).select(key)
