"""Run counters, cluster sizes and how clusters agree with known barcodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.dna import true_barcode
from readloom.session import Scratch


def read_stats(found: DataFrame, assigned: DataFrame | None = None) -> DataFrame:
    """Per file: reads, failed, with N, usable, and assigned where the assignment is given."""
    df = assigned if assigned is not None else found
    extra = [F.count_if(F.col("bcid").isNotNull()).alias("n_assigned")] if assigned is not None else []
    return df.groupBy("file_idx").agg(
        F.count(F.lit(1)).alias("n_reads"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "unknown").alias("n_with_unknown"),
        F.count_if(F.col("status") == "ok").alias("n_ok"),
        *extra,
    )


def cluster_sizes(counts: DataFrame, assignments: DataFrame) -> DataFrame:
    """(bcid, n_barcodes, n_reads) of each cluster."""
    return (
        counts.join(assignments.select("barcode", "bcid"), "barcode").groupBy("bcid").agg(F.count(F.lit(1)).alias("n_barcodes"), F.sum("n").alias("n_reads"))
    )


def size_histogram(sizes: DataFrame) -> DataFrame:
    """Clusters by number of barcodes, 1 to 12 and 13 for more, with their least, most and mean reads."""
    return sizes.groupBy(F.least("n_barcodes", F.lit(13)).alias("n_barcodes")).agg(
        F.count(F.lit(1)).alias("n_clusters"), F.min("n_reads").alias("least_reads"), F.max("n_reads").alias("most_reads"), F.avg("n_reads").alias("mean_reads")
    )


def truth_pairs(assigned: DataFrame) -> DataFrame:
    """(true_bc, bcid) of assigned reads whose header names the true barcode."""
    return assigned.select(true_barcode(F.col("header")).alias("true_bc"), "bcid").where("true_bc is not null and bcid is not null")


def split_histogram(pairs: DataFrame) -> DataFrame:
    """True barcodes by the number of clusters their reads fell into, 1 to 5 and 6 for more."""
    return _histogram(pairs, "true_bc", "bcid", "n_clusters", "n_barcodes")


def merge_histogram(pairs: DataFrame) -> DataFrame:
    """Clusters by the number of true barcodes they hold, 1 to 5 and 6 for more."""
    return _histogram(pairs, "bcid", "true_bc", "n_barcodes", "n_clusters")


def missing_truth(assigned: DataFrame) -> DataFrame:
    """One row: assigned reads, and those of them whose header names no true barcode."""
    none = true_barcode(F.col("header")).isNull()
    return assigned.where("bcid is not null").agg(F.count(F.lit(1)).alias("n_reads"), F.count_if(none).alias("n_without_truth"))


def report(counts: DataFrame, assignments: DataFrame, assigned: DataFrame) -> DataFrame:
    """The evaluation as one table (section, bin, measure, value): the three histograms and the reads without truth."""

    def rows(df: DataFrame, section: str, key: str | None, measures: list[str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("m")
        place = F.col(key).cast("int") if key else F.lit(0)
        return df.select(F.lit(section).alias("section"), place.alias("bin"), each).select("section", "bin", "m.measure", "m.value")

    pairs = truth_pairs(assigned)
    sizes = size_histogram(cluster_sizes(counts, assignments))
    return (
        rows(sizes, "barcodes of a cluster", "n_barcodes", ["n_clusters", "least_reads", "most_reads", "mean_reads"])
        .unionByName(rows(split_histogram(pairs), "clusters of a true barcode", "n_clusters", ["n_barcodes"]))
        .unionByName(rows(merge_histogram(pairs), "true barcodes of a cluster", "n_barcodes", ["n_clusters"]))
        .unionByName(rows(missing_truth(assigned), "reads", None, ["n_reads", "n_without_truth"]))
    )


def _histogram(pairs: DataFrame, key: str, other: str, bins: str, count: str) -> DataFrame:
    # distinct pairs first, so a key with most of the reads sends few rows
    per_key = pairs.select(key, other).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy(F.least("n", F.lit(6)).alias(bins)).agg(F.count(F.lit(1)).alias(count))


def same_records(a: DataFrame, b: DataFrame, as_sets: bool = True) -> DataFrame:
    """One row: whether two read sets hold the same records in any order, and how many only one holds.

    As sets, repeated records count once; otherwise as multisets.
    """
    cols = ["header", "seq", "plus", "qual"]
    x = a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    each = x.groupBy(*cols).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    if as_sets:
        each = each.select(F.least("a", F.lit(1)).alias("a"), F.least("b", F.lit(1)).alias("b"))
    return each.agg(
        F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("only_first"),
        F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))), F.lit(0)).alias("only_second"),
    ).withColumn("same", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Forward reads with their mates (header2, seq2, plus2, qual2) by place in the files; a missing mate fails.

    The check is a filter, so it is made whatever columns are used.
    """
    mate = second.select("file_idx", "read_idx", *[F.col(c).alias(f"{c}2") for c in ("header", "seq", "plus", "qual")], F.lit(True).alias("_m"))
    both = first.withColumn("_f", F.lit(True)).join(mate, ["file_idx", "read_idx"], "full")
    lone = F.col("_f").isNull() | F.col("_m").isNull()
    fails = F.raise_error(F.concat(F.lit("no mate for read "), F.coalesce(F.col("read_idx").cast("string"), F.lit("without a place"))))
    return both.where(F.when(lone, fails.cast("boolean")).otherwise(F.lit(True))).drop("_f", "_m")


def mixed_groups(calls: DataFrame, share: float = 0.15, positions: int = 3) -> DataFrame:
    """(bcid, n_mixed, mixed): groups in which a second base has at least ``share`` at ``positions`` or more places."""
    return calls.groupBy("bcid").agg(F.count_if(F.col("minor") >= share).alias("n_mixed")).withColumn("mixed", F.col("n_mixed") >= positions)


def placed(ordered: DataFrame) -> DataFrame:
    """The rows of a sorted table with their ``place`` from 1 on. Partitions are counted; no window holds all rows."""
    scratch = Scratch(ordered.sparkSession)
    number = F.monotonically_increasing_id()
    kept = scratch.put(ordered.select("*", F.shiftright(number, 33).alias("_part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    before, starts = 0, {}
    for part, n in sorted((r[0], r[1]) for r in kept.groupBy("_part").count().collect()):
        starts[part], before = before, before + n
    offsets = ordered.sparkSession.createDataFrame(sorted(starts.items()), "_part long, _from long")
    return kept.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_from") + F.col("_at") + 1).drop("_part", "_at", "_from")
