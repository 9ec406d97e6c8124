"""Extraction rules on reads made by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from readloom.config import Context, Extraction, Settings
from readloom.functions.dna import barcode_of, hamming, quality_stats, tag_id, true_barcode, unknown_bases, without


def one(spark, rows, expr, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expr).collect()]


def extract(spark, reads, **how):
    return one(spark, reads, barcode_of(F.col("x"), Extraction(**how)))


def test_fixed_needs_the_whole_barcode(spark):
    assert extract(spark, ["ACGTAC", "ACGTA", "", None], start=1, length=5) == ["CGTAC", None, None, None]


def test_prefix_takes_leftmost_of_fewest_mismatches(spark):
    ctx = Context.parse("GATTACANNN")
    got = extract(spark, ["GATTACAAAA", "CCGATTGCATTT", "GATGGCAAAA", "GATTGCAAAAGATTACACCC", "GATTGCAAACGATTGCAGGG"], context=ctx, max_indels=0)
    assert got == ["AAA", "TTT", None, "CCC", "AAA"[:2] + "C"]


def test_anchored_prefix_is_lost_to_a_better_hit(spark):
    ctx = Context.parse("^AACNNN")
    # offset 0 has one mismatch, offset 1 none
    assert extract(spark, ["AAACGTT", "AACGTTT", "ATCGTTT"], context=ctx) == [None, "GTT", "GTT"]


def test_suffix_window_and_indels(spark):
    ctx = Context.parse("^GGNNNNCCC")
    assert extract(spark, ["GGATATCCCT", "GGATACCCT"], context=ctx, max_indels=0, max_context_mismatches=0) == ["ATAT", None]
    assert extract(spark, ["GGATATCCCT", "GGATACCCT", "GGATATACCCT", "GGATATAACCC"], context=ctx, max_indels=1, max_context_mismatches=0) == ["ATAT", "ATA", "ATATA", None]


def test_end_anchor(spark):
    assert extract(spark, ["GGATATCCC", "GGATATCCCA"], context=Context.parse("^GGNNNNCCC$"), max_context_mismatches=0) == ["ATAT", None]
    assert extract(spark, ["GGATAT", "GGATATA", "GGATATAT"], context=Context.parse("^GGNNNN$"), max_indels=1) == ["ATAT", "ATATA", None]


def test_no_prefix_and_no_anchor_fails(spark):
    assert extract(spark, ["ACGTACGT"], context=Context.parse("NNNACG")) == [None]


def test_case_is_kept_but_ignored(spark):
    assert extract(spark, ["ggaTatccc"], context=Context.parse("^GGNNNNCCC")) == ["aTat"]


@pytest.mark.parametrize("pattern", ["ACGT", "NNANN", "N" * 65, "^$"])
def test_bad_patterns(pattern):
    with pytest.raises(ValueError):
        Context.parse(pattern)


@pytest.mark.parametrize("bad", [dict(max_n=6), dict(max_n=-1), dict(max_line=10), dict(max_mismatches=-1)])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


def brute(read, ctx, limit, indels):
    """The extraction rules as a plain loop."""

    def find(lo, hi, pat):
        if not pat:
            return lo
        best = None
        for p in range(max(lo, 0), min(hi, len(read)) - len(pat) + 1):
            m = sum(a.upper() != b.upper() for a, b in zip(read[p:], pat))
            if m <= limit and (best is None or m < best[0]):
                best = (m, p)
        return None if best is None else best[1]

    if ctx.prefix:
        at = find(0, min(len(read), len(ctx.prefix) + limit + 1) if ctx.starts else len(read), ctx.prefix)
        if at is None or (ctx.starts and at):
            return None
        begin = at + len(ctx.prefix)
    elif ctx.starts:
        begin = 0
    else:
        return None
    if ctx.suffix:
        at = find(max(begin + ctx.length - indels, begin), begin + ctx.length + indels + len(ctx.suffix), ctx.suffix)
        if at is None or (ctx.ends and at + len(ctx.suffix) != len(read)) or at - begin < 1 or abs(at - begin - ctx.length) > indels:
            return None
        size = at - begin
    elif ctx.ends:
        size = len(read) - begin
        if abs(size - ctx.length) > indels:
            return None
    else:
        size = ctx.length
    return read[begin : begin + size] if begin + size <= len(read) else None


@pytest.mark.parametrize("pattern", ["ACGNNNN", "^ACGNNNN", "ACGNNNNTT", "^NNNNTTA", "^NNNN$", "ACNNNNTTA$"])
def test_context_against_a_plain_loop(spark, pattern):
    rng = random.Random(pattern)
    reads = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 16))) for _ in range(300)]
    ctx = Context.parse(pattern)
    for limit, indels in itertools.product((0, 1, 2), (0, 1)):
        got = extract(spark, reads, context=ctx, max_context_mismatches=limit, max_indels=indels)
        assert got == [brute(r, ctx, limit, indels) for r in reads]


def test_unknown_bases(spark):
    assert one(spark, ["ACGT", "acnn", "AX", "", None], unknown_bases(F.col("x"))) == [0, 2, None, 0, None]


def test_hamming_and_deletions(spark):
    df = spark.createDataFrame([("ACGT", "ACCA"), ("AC", "ACG"), (None, "A")], "a string, b string")
    assert [r[0] for r in df.select(hamming(F.col("a"), F.col("b"))).collect()] == [2, None, None]
    assert [sorted(x) for x in one(spark, ["AAC", "A"], without(F.col("x"), 1))] == [["AA", "AC"], [""]]
    assert [sorted(x) for x in one(spark, ["ACGT"], without(F.col("x"), 2))] == [["AC", "AG", "AT", "CG", "CT", "GT"]]


def test_quality_stats(spark):
    q = quality_stats(F.col("x"))
    assert one(spark, ["!+5", "", "  ", "I"], q[0]) == [0, 0, 0, 40]
    assert one(spark, ["!+5", "", "I#"], q[1]) == [10, 0, 21]


def test_tags(spark):
    assert one(spark, ["@r;UBID=12 x", "@r", "@r;UBID=x;UBID=3", None], tag_id(F.col("x"))) == [12, None, None, None]
    heads = ["@r barcode=ACG\tx", "@r barcode= x", "@r", "@r barcode=" + "A" * 70, "@r barcode= barcode=AC"]
    assert one(spark, heads, true_barcode(F.col("x"))) == ["ACG", None, None, "A" * 64, None]
