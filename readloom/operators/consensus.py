"""One consensus record for each group of reads."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.config import Settings
from readloom.functions.dna import barcode_of, quality_stats
from readloom.operators.align import call, fold, fold_profiles
from readloom.operators.pileup import called, consensus_of, pileup
from readloom.session import Scratch

SCHEMA = "bcid long, count long, seq string, qual string, minor_frac_max double, minor_frac_mean double, calls long, missense long, indels long"
#: Reads after which a lockstep starts.
LOCKSTEP_READS = 20_000
#: An aligned group of more reads is folded in parts of about so many, whose profiles are then folded.
PART_READS = 1_000
FAN_IN = 32

_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_PARTS = SCHEMA + ", part long, profile binary"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.float64()] * 2, *[pa.int64()] * 3, pa.int64(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=[*_NAMES, "part", "profile"])


def _by_group(batches, most: int, width: int):
    """Rows sorted by (bcid, part, whole) in lists of (key, rows), each list of about ``most`` rows or of one group."""
    done, held, current, rows = [], 0, None, []
    for b in batches:
        for key, *row in zip(zip(*(c.to_pylist() for c in b.columns[:width])), *(c.to_pylist() for c in b.columns[width:])):
            if key != current:
                if rows:
                    done.append((current, rows))
                    held += len(rows)
                current, rows = key, []
                if held >= most:
                    yield done
                    done, held = [], 0
            rows.append(row)
    if rows:
        done.append((current, rows))
    if done:
        yield done


def _results(keys: list[tuple], counts: list[int], profiles: list) -> pa.RecordBatch:
    """Records of whole groups, and profiles of parts."""
    blank = ("", "", 0.0, 0.0, 0, 0, 0)
    return _batch(
        [
            (i, n, *call(p), None, None) if whole else (i, n, *blank, part, p.astype("<i8").tobytes())
            for (i, part, whole), n, p in zip(keys, counts, profiles)
        ]
    )


def _fold_reads(gap: float):
    """Reads sorted by group, many groups at a time; a group that straddles batches is carried over."""

    def run(batches):
        for groups in _by_group(batches, LOCKSTEP_READS, 3):
            alone = [(i, 1, g[0][0], g[0][1] or "", 0.0, 0.0, 0, 0, 0, None, None) for (i, _, whole), g in groups if len(g) == 1 and whole]
            if alone:
                yield _batch(alone)
            several = [(k, g) for k, g in groups if len(g) > 1 or not k[2]]
            if several:
                yield _results([k for k, _ in several], [len(g) for _, g in several], fold([g for _, g in several], gap))

    return run


def _fold_parts(gap: float):
    def run(batches):
        for groups in _by_group(batches, 4 * FAN_IN, 3):
            profiles = [[np.frombuffer(p, "<i8").reshape(-1, 5) for _, p in g] for _, g in groups]
            yield _results([k for k, _ in groups], [sum(n for n, _ in g) for _, g in groups], fold_profiles(profiles, gap))

    return run


def _aligned(usable: DataFrame, how: Settings) -> DataFrame:
    """Aligned groups; ones of more than PART_READS reads in parts, whose profiles are folded in a tree of FAN_IN."""
    scratch = Scratch(usable.sparkSession)
    sizes = usable.groupBy("bcid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_READS)
    sizes = scratch.put(sizes.select("bcid", F.ceil(F.col("n") / PART_READS).cast("long").alias("parts")))
    most = sizes.agg(F.max("parts")).first()[0] or 1
    if most > 1:
        cut = usable.join(sizes, "bcid", "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    else:
        cut = usable.withColumn("parts", F.lit(1).cast("long"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("file_idx", "read_idx"), F.col("parts")))
    ordered = cut.repartition("bcid", "part").sortWithinPartitions("bcid", "part", "file_idx", "read_idx")
    made = ordered.select("bcid", "part", (F.col("parts") == 1).alias("whole"), "seq", "qual").mapInArrow(_fold_reads(how.gap), _PARTS)
    if most == 1:
        return made.select(*_NAMES)
    done = []
    while most > 1:
        made = scratch.put(made)
        done.append(made.where("profile is null").select(*_NAMES))
        most = -(-most // FAN_IN)
        up = made.where("profile is not null").withColumn("into", F.floor(F.col("part") / FAN_IN))
        up = up.repartition("bcid", "into").sortWithinPartitions("bcid", "into", "part")
        made = up.select("bcid", F.col("into").alias("part"), F.lit(most == 1).alias("whole"), "count", "profile").mapInArrow(_fold_parts(how.gap), _PARTS)
    return reduce(DataFrame.unionByName, [*done, made.select(*_NAMES)])


def consensus(reads: DataFrame, how: Settings) -> DataFrame:
    """Consensus of the reads (bcid, file_idx, read_idx, seq, qual): the columns of SCHEMA.

    A group of one read keeps its sequence and quality as they are. Other groups are summed position
    by position, or aligned: there the reads are shuffled once, and one pass over the sorted partitions
    folds many groups at a time.
    A null or empty sequence is no read. An aligned group's fold is a chain, so groups of more than PART_READS
    reads are cut into parts by a hash of the read; the parts are folded like groups, and their profiles are
    folded in turn. Groups of any size are so spread over tasks.
    """
    usable = reads.where("bcid is not null and length(seq) > 0").select("bcid", "file_idx", "read_idx", "seq", "qual")
    if how.align:
        return _aligned(usable, how)
    size = usable.groupBy("bcid").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("seq", "qual")).alias("one"))
    zero = F.lit(0).cast("bigint")
    single = size.where("count = 1").select(
        "bcid", "count", "one.seq", F.coalesce("one.qual", F.lit("")).alias("qual"), F.lit(0.0).alias("minor_frac_max"), F.lit(0.0).alias("minor_frac_mean"),
        zero.alias("calls"), zero.alias("missense"), zero.alias("indels"),
    )
    several = size.where("count > 1").select("bcid", "count")
    # a group without any evidence keeps no position: its consensus is empty
    made = consensus_of(called(pileup(usable.join(several.select("bcid"), "bcid"))))
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("seq", "qual")]
    nums = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("minor_frac_max", "minor_frac_mean")]
    ints = [F.coalesce(c, zero).alias(c) for c in ("calls", "missense", "indels")]
    return single.unionByName(several.join(made, "bcid", "left").select("bcid", "count", *text, *nums, *ints))


def records(made: DataFrame, how: Settings) -> DataFrame:
    """Consensus records with the barcode found again in the consensus; bc is null where it is not (these fail)."""
    least, mean = quality_stats(F.col("qual"))
    return made.withColumn("bc", barcode_of(F.col("seq"), how.extraction)).withColumn("min_q", least).withColumn("mean_q", mean)


def error_rates(made: DataFrame) -> DataFrame:
    """One row: share of non-top base evidence and of gap evidence among the called base evidence."""
    return made.agg(
        F.sum("calls").alias("calls"),
        (F.sum("missense") / F.sum("calls")).alias("missense_rate"),
        (F.sum("indels") / F.sum("calls")).alias("indel_rate"),
    )


def fastq_lines(rec: DataFrame) -> DataFrame:
    """The four lines of each record that has its barcode, as one text column ``value``."""
    # three decimals of the exact binary value, ties to even, as C prints them; format_string would round half up
    # (and the JDK rounds 0.0005, which lies just above the tie, down)
    three = lambda c: F.when(F.col(c) == 0.0005, "0.001").otherwise(F.call_function("format_number", F.col(c), F.lit("0.000")))
    mean, most = three("minor_frac_mean"), three("minor_frac_max")
    head = F.format_string("@bc=%s;bcid=%d;count=%d;min_q=%d;mean_q=%d;minor_frac_mean=%s;minor_frac_max=%s", "bc", "bcid", "count", "min_q", "mean_q", mean, most)
    return rec.where("bc is not null").select(F.concat_ws("\n", head, "seq", F.lit("+"), "qual").alias("value"))


def failed_lines(rec: DataFrame, reads: DataFrame) -> DataFrame:
    """The four lines of reads without group, as they came, and of consensus records without barcode."""
    lost = rec.where("bc is null").select(
        F.concat_ws("\n", F.format_string("@bcid=%d;count=%d", "bcid", "count"), "seq", F.lit("+"), "qual").alias("value")
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    return reads.where("bcid is null").select(F.concat_ws("\n", text("header"), text("seq"), text("plus"), text("qual")).alias("value")).unionByName(lost)


def sorted_lines(reads: DataFrame) -> DataFrame:
    """Assigned reads as records in the order of their groups, each header ending in ``;UBID=`` and the group."""
    text = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(text("header"), F.lit(";UBID="), F.col("bcid").cast("string"))
    ordered = reads.where("bcid is not null").orderBy("bcid", "file_idx", "read_idx")
    return ordered.select(F.concat_ws("\n", head, text("seq"), text("plus"), text("qual")).alias("value"))


def paired_consensus(pairs: DataFrame, how: Settings) -> DataFrame:
    """Consensus of both mates of each group of paired reads (bcid, seq, qual, seq2, qual2): the columns of SCHEMA for the
    reads, and seq2 and qual2. The mates are collapsed on their own; a group whose mates are all empty has an empty seq2.
    """
    mates = pairs.select("bcid", "file_idx", "read_idx", F.col("seq2").alias("seq"), F.col("qual2").alias("qual"))
    other = consensus(mates, how).select("bcid", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("seq2", "qual2")]
    return consensus(pairs.drop("seq2", "qual2"), how).join(other, "bcid", "left").select(*(f.split()[0] for f in SCHEMA.split(", ")), *text)


def by_barcode(found: DataFrame) -> DataFrame:
    """Usable reads in the order of their barcodes' text, then of the files, as older releases sorted them."""
    return found.where("status <> 'failed'").orderBy("barcode", "file_idx", "read_idx")
