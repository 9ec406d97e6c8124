"""Consensus without alignment, as relational aggregates over positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.dna import LOG_RIGHT, LOG_WRONG, WEIGHTS

CLASSES = ("a", "c", "g", "t", "gap")


def weight(code: Column) -> Column:
    """Evidence weight of a quality character's code."""
    table = F.array(*[F.lit(w) for w in WEIGHTS])
    return F.when(code < 33, 0).when(code > 73, 42).otherwise(F.get(table, code - 33))


def pileup(reads: DataFrame, group: str = "bcid") -> DataFrame:
    """(bcid, pos, a, c, g, t, gap): summed evidence of the reads of each group at each position.

    Only upper-case A, C, G, T give evidence; a missing quality gives 0. Positions run to the end of
    the group's longest read, so positions without evidence are rows too. Null reads add nothing.
    """
    letters = F.split("seq", "")
    base = reads.where(F.col(group).isNotNull() & (F.length("seq") > 0)).select(
        group, "qual", F.posexplode(letters).alias("pos", "base")
    )
    code = F.ascii(F.substring(F.coalesce("qual", F.lit("")), F.col("pos") + 1, F.lit(1)))
    # a quality shorter than the read ends in empty substrings, whose code is 0
    w = weight(code)
    sums = [F.sum(F.when(F.col("base") == c.upper(), w).otherwise(0)).alias(c) for c in CLASSES[:4]]
    return base.groupBy(group, "pos").agg(*sums).withColumn("gap", F.lit(0).cast("bigint"))


def called(piles: DataFrame, group: str = "bcid") -> DataFrame:
    """Adds to each position: kept (before the tail trim's end), base, q, minor (or null), and error counts.

    The tail is cut after the last position with more than half of the group's mean evidence. A gap
    on top gives no base; no base evidence, or a tie of bases, gives N at quality 0; a quality
    under 4 gives N and keeps its quality.
    """
    each = [F.col(c) for c in CLASSES]
    total = sum(each[1:], each[0])
    bases = F.greatest(*each[:4])
    non_gap = sum(each[1:4], each[0])
    # a group has as many rows as its longest read has bases, so these windows stay small in huge groups too
    whole = Window.partitionBy(group)
    half = F.sum(total).over(whole) / F.count(F.lit(1)).over(whole) / 2
    marked = piles.withColumn("_good", F.when(total > half, F.col("pos"))).withColumn("_last", F.max("_good").over(whole))
    rows = marked.where((F.col("pos") <= F.col("_last")) & (F.col("gap") <= bases)).drop("_good", "_last")
    top_count = sum((F.when(c == bases, 1).otherwise(0) for c in each[1:4]), F.when(each[0] == bases, 1).otherwise(0))
    second = F.when(top_count > 1, bases).otherwise(F.get(F.sort_array(F.array(*each[:4])), 2))
    # the classes' probabilities are 10^(s * LOG_RIGHT + (total - s) * LOG_WRONG); over that of the top class, the
    # others add up to this. Against strong evidence for the top class they sum to 0 in floats; below 1e-9 the quality
    # is far above its cap of 40 anyway
    others = F.greatest(sum((F.pow(F.lit(10.0), (LOG_RIGHT - LOG_WRONG) * (c - bases)) for c in each), F.lit(-1.0)), F.lit(1e-9))
    phred = 10 * F.log10((1 + others) / others)
    q = F.least(F.lit(40), F.greatest(F.lit(0), F.floor(phred + 0.5))).cast("int")
    blank = (non_gap == 0) | (top_count > 1)
    rows = rows.withColumn("q", F.when(blank, 0).otherwise(q))
    letter = F.when(F.col("a") == bases, "A").when(F.col("c") == bases, "C").when(F.col("g") == bases, "G").otherwise("T")
    return rows.select(
        *[c for c in rows.columns if c != "q"],
        F.when(blank | (F.col("q") < 4), "N").otherwise(letter).alias("base"),
        "q",
        F.when(non_gap > 0, second / non_gap).alias("minor"),
        F.when(blank, 0).otherwise(non_gap).alias("calls"),
        F.when(blank, 0).otherwise(non_gap - bases).alias("missense"),
        F.when(blank, 0).otherwise(F.col("gap")).alias("indels"),
    )


def consensus_of(calls: DataFrame, group: str = "bcid") -> DataFrame:
    """(bcid, seq, qual, minor_frac_max, minor_frac_mean, calls, missense, indels) of called positions."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "base", F.char(F.col("q") + 33).alias("c"))))
    return (
        calls.groupBy(group)
        .agg(
            parts.alias("p"),
            F.coalesce(F.max("minor"), F.lit(0.0)).alias("minor_frac_max"),
            F.coalesce(F.avg("minor"), F.lit(0.0)).alias("minor_frac_mean"),
            F.sum("calls").alias("calls"),
            F.sum("missense").alias("missense"),
            F.sum("indels").alias("indels"),
        )
        .select(
            group,
            F.array_join(F.col("p.base"), "").alias("seq"),
            F.array_join(F.col("p.c"), "").alias("qual"),
            "minor_frac_max",
            "minor_frac_mean",
            "calls",
            "missense",
            "indels",
        )
    )
