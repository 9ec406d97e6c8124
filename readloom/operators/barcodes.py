"""Extraction, validity and counting of barcodes, and their neighbours."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.config import Settings
from readloom.functions.dna import barcode_of, packed, packed_hamming, unknown_bases, without
from readloom.operators.salted import hot_keys, salted_lookup
from readloom.session import spread


def extracted(reads: DataFrame, how: Settings) -> DataFrame:
    """Reads with ``barcode`` (upper case), ``n_unknown`` and ``status``.

    status is ``ok``, ``unknown`` (usable, with N), ``failed`` (no barcode, a character other than
    bases, or more than max_n N). A null read fails. Existing columns of these names are replaced.
    """
    raw = barcode_of(F.col("seq"), how.extraction)
    out = reads.withColumn("barcode", F.upper(raw)).withColumn("n_unknown", unknown_bases(F.col("barcode")))
    return out.withColumn(
        "status",
        F.when(F.col("n_unknown").isNull() | (F.col("n_unknown") > how.max_n), "failed").when(F.col("n_unknown") > 0, "unknown").otherwise("ok"),
    )


def barcode_counts(found: DataFrame) -> DataFrame:
    """(barcode, n) of the valid barcodes without N; counted partially before the shuffle."""
    return found.where("status = 'ok'").groupBy("barcode").agg(F.count(F.lit(1)).alias("n"))


def substitution_pairs(counts: DataFrame, most: int) -> DataFrame:
    """(a, b) of barcodes of one length with 1 to ``most`` substitutions, each pair both ways.

    Cut into 3 pieces for each substitution, two such barcodes agree in two thirds of the pieces at least, so
    candidates come from an equi-join on every choice of so many pieces (3 choices for one substitution, 15 for two).
    These hold two thirds of the bases, so few barcodes meet by chance however large the table.
    """
    most = min(most, 2)
    if most < 1:
        return counts.select(F.col("barcode").alias("a"), F.col("barcode").alias("b")).limit(0)
    n, parts = F.length("barcode"), 3 * most
    cut = lambda k: F.floor(n * k / parts).cast("int")
    piece = [F.substring("barcode", cut(k) + 1, cut(k + 1) - cut(k)) for k in range(parts)]
    signs = F.array(*[F.xxhash64(n, F.lit(i), *(piece[k] for k in kept)) for i, kept in enumerate(combinations(range(parts), 2 * most))])
    keyed = spread(counts.select("barcode")).select("barcode", F.explode(signs).alias("sign"))
    one, two = (keyed.select("sign", F.col("barcode").alias(c)) for c in "ab")
    # the exploded side is far larger than the table it comes from, so it must not be broadcast by that table's size
    near = one.join(two.hint("shuffle_hash"), "sign").where((F.col("a") < F.col("b")) & (F.length("a") == F.length("b"))).select("a", "b").distinct()
    near = near.where(packed_hamming(packed(F.col("a")), packed(F.col("b"))) <= most)
    return near.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def indel_pairs(counts: DataFrame, most: int, fixed: bool) -> DataFrame:
    """(a, b): b is reached from a by 1 to ``most`` deletions only or insertions only.

    In context mode the lengths differ: the k-deletions of the longer one are joined to the shorter.
    At a fixed place the read shifts, so after k deletions k bases follow, and after k insertions the
    last k fall off: b is an insertion neighbour of a exactly if a without its last k bases is among
    the k-deletions of b, and a deletion neighbour the other way round.
    """
    base = counts.select("barcode")
    none = base.select(F.col("barcode").alias("a"), F.col("barcode").alias("b")).limit(0)
    out = none
    for k in range(1, min(most, 2) + 1):
        signs = spread(base.where(F.length("barcode") > k)).select(F.col("barcode").alias("b"), F.explode(without(F.col("barcode"), k)).alias("s"))
        # Spark takes the exploded side for as small as the table it comes from, and would send all of it to the driver
        signs = signs.hint("merge")
        if fixed:
            n = F.length("barcode")
            short = base.where(n > k).select(F.col("barcode").alias("a"), F.substring("barcode", F.lit(1), n - k).alias("s"))
            hits = short.join(signs, "s").where("a <> b").select("a", "b")
        else:
            hits = signs.join(base.select(F.col("barcode").alias("s")), "s").select(F.col("s").alias("a"), "b")
        out = out.unionByName(hits).unionByName(hits.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return out.distinct()


def neighbour_pairs(counts: DataFrame, how: Settings) -> DataFrame:
    """All pairs a greedy centroid may absorb, both ways; pure edits only, never mixed ones."""
    x = how.extraction
    return substitution_pairs(counts, how.max_mismatches).unionByName(indel_pairs(counts, x.max_indels, x.fixed)).distinct()


def _opened(x):
    """The four ways to fill the first N of a combination, or the combination itself."""
    at = F.locate("N", x["full"])
    tail = F.substring(x["full"], at + 1, F.length(x["full"]))
    filled = [
        F.struct(
            F.concat(F.substring(x["full"], F.lit(1), at - 1), F.lit(base), tail).alias("full"),
            (x["rank"] + x["step"] * i).alias("rank"),
            (x["step"] * 4).alias("step"),
        )
        for i, base in enumerate("ACGT")
    ]
    return F.when(at > 0, F.array(*filled)).otherwise(F.array(F.struct(x["full"].alias("full"), x["rank"].alias("rank"), x["step"].alias("step"))))


def resolve_unknown(found: DataFrame, counts: DataFrame, assignments: DataFrame) -> DataFrame:
    """(barcode, bcid) of barcodes with N: the counted barcode they match that has most reads.

    Ties go to the combination in which the first N varies fastest, in the order A, C, G, T. At
    most 4^max_n combinations of each distinct barcode are joined.
    """
    wanted = found.where("status = 'unknown'").select("barcode").distinct()
    made = F.array(F.struct(F.col("barcode").alias("full"), F.lit(0).alias("rank"), F.lit(1).alias("step")))
    for _ in range(5):
        made = F.flatten(F.transform(made, _opened))
    combos = wanted.select("barcode", F.explode(made).alias("c")).select("barcode", "c.full", "c.rank")
    known = counts.join(assignments.select("barcode", "bcid"), "barcode").withColumnRenamed("barcode", "full")
    return (
        combos.join(known, "full").groupBy("barcode").agg(F.min_by("bcid", F.struct(-F.col("n"), F.col("rank"))).alias("bcid"))
    )


def assigned(found: DataFrame, counts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Reads with their ``bcid``; null for failed reads and for N barcodes that match nothing.

    Reads of a barcode that owns a large share of them are spread over salts in the join.
    """
    known = assignments.select("barcode", "bcid").unionByName(resolve_unknown(found, counts, assignments))
    usable = F.when(F.col("status") != "failed", F.col("barcode"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keyed = found.withColumn("_key", usable)
    return salted_lookup(keyed, known.withColumnRenamed("barcode", "_key"), "_key", "read_idx", hot_keys(counts, "barcode", total, "n"), "left").drop("_key")
