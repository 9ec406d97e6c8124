"""Greedy centroid clustering of barcodes as parallel rounds."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.config import Settings
from readloom.functions.dna import hamming
from readloom.operators.barcodes import neighbour_pairs
from readloom.operators.evaluate import placed
from readloom.session import Scratch

#: Edges that one task can finish: two barcodes and a count each.
LAST_EDGES = 50_000


def numbered(centroids: DataFrame) -> DataFrame:
    """Dense ids 1..K by falling count, then barcode, without a single-task window.

    Range partitions are counted, and the ids of a partition start after those of the ones before;
    the driver sees one count a partition. Where ranges are cut depends on a sample that differs from
    job to job, so the partitions are written before they are counted.
    """
    ordered = centroids.select("barcode", "n").repartitionByRange(F.desc("n"), "barcode").sortWithinPartitions(F.desc("n"), "barcode")
    return placed(ordered).select("barcode", F.col("place").alias("bcid"))


def _decide(batches):
    """The rounds of ``cluster`` for the edges that are left, in one pass by rank: who becomes a centroid."""
    higher: dict[str, list[str]] = {}
    reads: dict[str, int] = {}
    for batch in batches:
        for a, b, n in zip(*(c.to_pylist() for c in batch.columns)):
            higher.setdefault(b, []).append(a)
            reads[b] = n
    central: dict[str, bool] = {}
    for b in sorted(higher, key=lambda x: (-reads[x], len(x), x)):
        central[b] = not any(central.get(a, True) for a in higher[b])  # one that nothing outranks is a centroid
    if central:
        yield pa.RecordBatch.from_arrays([pa.array(central.keys(), pa.string()), pa.array(central.values(), pa.bool_())], names=["barcode", "central"])


def cluster(counts: DataFrame, how: Settings, last: int = LAST_EDGES) -> DataFrame:
    """(barcode, centroid, bcid): every counted barcode with the centroid that absorbs it.

    Barcodes rank by falling count, then length, then text. The sequential rule - the next unclaimed
    barcode becomes a centroid and claims its unclaimed neighbours - is the same as these rounds: a
    barcode becomes a member once a higher-ranked neighbour is a centroid, a centroid once all its
    higher-ranked neighbours are members, and a member belongs to its highest-ranked centroid. Each
    round is one join and one aggregation over the undecided; its result is written to the shared
    folder. Once no more than ``last`` edges are left, a fixed number, one task decides the rest.
    """
    scratch = Scratch(counts.sparkSession)
    counts = scratch.put(counts.select("barcode", "n"))
    rank = F.struct(-F.col("n"), F.length("barcode"), F.col("barcode"))
    ranked = counts.select("barcode", "n", rank.alias("rank"))
    pairs = neighbour_pairs(counts, how)
    up = scratch.put(
        pairs.join(ranked.select(F.col("barcode").alias("a"), F.col("rank").alias("ra")), "a")
        .join(ranked.select(F.col("barcode").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb")), "b")
        .where("ra < rb")  # a outranks b
        .select("a", "b", "ra", "nb")
    )
    fresh = scratch.put(ranked.select("barcode").join(up.select(F.col("b").alias("barcode")).distinct(), "barcode", "left_anti"))
    central, members = [fresh], []
    # edges into undecided barcodes; those from members fall away, those from centroids decide
    edges = up.select("a", "b", "nb")
    while edges.count() > last:
        won = scratch.put(edges.join(fresh.select(F.col("barcode").alias("a")), "a", "left_semi").select(F.col("b").alias("barcode")).distinct())
        members.append(won)
        rest = edges.join(won.withColumnRenamed("barcode", "b"), "b", "left_anti")
        undecided = rest.select("b").distinct()
        rest = scratch.put(rest.join(won.withColumnRenamed("barcode", "a"), "a", "left_anti").select("a", "b", "nb"))
        # with no higher-ranked neighbour left that could still become a centroid
        fresh = scratch.put(undecided.join(rest.select("b").distinct(), "b", "left_anti").select(F.col("b").alias("barcode")))
        central.append(fresh)
        edges = rest
    decided = scratch.put(edges.coalesce(1).mapInArrow(_decide, "barcode string, central boolean"))
    central.append(decided.where("central").select("barcode"))
    members = reduce(DataFrame.unionByName, [*members, decided.where("not central").select("barcode")])
    central = reduce(DataFrame.unionByName, central)
    central = scratch.put(central)
    own = central.select("barcode", F.col("barcode").alias("centroid"))
    claims = (
        up.join(central.select(F.col("barcode").alias("a")), "a", "left_semi")
        .join(members.select(F.col("barcode").alias("b")), "b", "left_semi")
        .groupBy("b")
        .agg(F.min_by("a", "ra").alias("centroid"))
        .withColumnRenamed("b", "barcode")
    )
    own = own.unionByName(claims)
    ids = numbered(counts.join(central, "barcode", "left_semi")).withColumnRenamed("barcode", "centroid")
    return own.join(ids, "centroid").select("barcode", "centroid", "bcid")


def diameters(counts: DataFrame, assignments: DataFrame, least: int, max_mismatches: int) -> DataFrame:
    """The largest clusters (at most 20, of ``least`` reads or more) and how far their members are.

    Of up to 10 members other than the centroid, in barcode order: the largest Hamming distance, and
    how many have another length. A cluster whose members reach the allowed distance is suspicious.
    """
    from pyspark.sql import Window

    all_ = counts.join(assignments, "barcode")
    big = (
        all_.groupBy("bcid", "centroid").agg(F.sum("n").alias("n_reads")).where(F.col("n_reads") >= least)
        .orderBy(F.desc("n_reads"), "bcid").limit(20)
    )
    order = Window.partitionBy("bcid").orderBy("barcode")
    sample = (
        all_.where("barcode <> centroid").join(F.broadcast(big.select("bcid")), "bcid").withColumn("k", F.row_number().over(order)).where("k <= 10")
        .groupBy("bcid")
        .agg(F.max(hamming(F.col("barcode"), F.col("centroid"))).alias("d"), F.count_if(F.length("barcode") != F.length("centroid")).alias("n_other_length"), F.count(F.lit(1)).alias("n_sampled"))
    )
    out = big.join(sample, "bcid", "left").select(
        "bcid", "centroid", "n_reads", F.coalesce("d", F.lit(0)).alias("max_distance"), F.coalesce("n_other_length", F.lit(0)).alias("n_other_length"),
        F.coalesce("n_sampled", F.lit(0)).alias("n_sampled"),
    )
    return out.withColumn("suspicious", (F.col("n_sampled") > 0) & F.lit(max_mismatches > 0) & (F.col("max_distance") >= max_mismatches))
