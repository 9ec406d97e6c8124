"""Salted aggregation, pieces of a file and the reports."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from readloom.operators import evaluate
from readloom.operators.salted import group_summary, heavy_groups
from readloom.operators.split import split_by_barcodes

READS = "bc string, seq string, loaded_at timestamp, _salt int, n_reads long"


def reads(rng, n=4000):
    t0 = datetime(2024, 1, 1)
    out = []
    for i in range(n):
        bc = rng.choice(["HOT", " hot\r", "Hot"]) if rng.random() < 0.4 else rng.choice([None, f"b{rng.randint(0, 300)}", ""])
        seq = rng.choice([None, "acgt", "ACGT ", f"s{rng.randint(0, 500)}"])
        out.append((bc, seq, rng.choice([None, t0 + timedelta(seconds=i)]), 7, 9))
    return out


def test_groups_equal_a_plain_loop(spark):
    rows = reads(random.Random(1))
    want = defaultdict(lambda: [0, set(), []])
    for bc, seq, t, *_ in rows:
        if bc is not None:
            g = want[bc.strip().upper()]
            g[0] += 1
            if seq is not None:
                g[1].add(seq.strip().upper())
            if t:
                g[2].append(t)
    got = group_summary(spark.createDataFrame(rows, READS).repartition(5), share=0.01, splits=16).collect()
    assert {r["bc"]: (r["n_reads"], r["n_distinct_seq"], r["first_loaded_at"], r["last_loaded_at"]) for r in got} == {
        k: (n, len(s), min(t, default=None), max(t, default=None)) for k, (n, s, t) in want.items()
    }
    assert max(got, key=lambda r: r["n_reads"])["n_salts"] > 3


def test_heavy_groups_count_null_keys_in_the_total(spark):
    rows = [("A", "x", None, 0, 0)] * 2 + [(None, "x", None, 0, 0)] * 98
    df = spark.createDataFrame(rows, READS)
    assert [r[0] for r in heavy_groups(df, 0.02).collect()] == ["A"]
    assert heavy_groups(df, 0.03).collect() == []
    assert group_summary(df.limit(0)).collect() == [] and heavy_groups(df.limit(0)).collect() == []


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_pieces(spark, chunk):
    rng = random.Random(chunk)
    seqs = [rng.choice(["AAxx", "ACyy", "AGzz", "A", None]) for _ in range(60)]
    df = spark.createDataFrame([(f, i, s) for f in (0, 1) for i, s in enumerate(seqs)], "file_idx int, read_idx long, seq string")
    got = {(r["file_idx"], r["read_idx"]): (r["run"], r["file_no"]) for r in split_by_barcodes(df, 0, 2, 3, chunk=chunk).collect()}
    want, run, last = {}, 0, None
    for i, s in enumerate(seqs):
        if s and len(s) >= 2:
            run += s[:2] != last
            last = s[:2]
            for f in (0, 1):
                want[f, i] = (run, (run - 1) // 3 + 1)
    assert got == want
    with pytest.raises(ValueError):
        split_by_barcodes(df, 0, 2, 0)


def test_histograms(spark):
    pairs = spark.createDataFrame([("A", 1), ("A", 1), ("A", 2), ("B", 2)] + [("C", i) for i in range(9)], "true_bc string, bcid long")
    assert {tuple(r) for r in evaluate.split_histogram(pairs).collect()} == {(2, 1), (1, 1), (6, 1)}
    assert {tuple(r) for r in evaluate.merge_histogram(pairs).collect()} == {(1, 7), (2, 1), (3, 1)}
    sizes = spark.createDataFrame([(1, 1, 5), (2, 1, 7), (3, 40, 100), (4, 13, 9)], "bcid long, n_barcodes long, n_reads long")
    assert {tuple(r) for r in evaluate.size_histogram(sizes).collect()} == {(1, 2, 5, 7, 6.0), (13, 2, 9, 100, 54.5)}


def test_same_records(spark):
    cols = "header string, seq string, plus string, qual string"
    a = spark.createDataFrame([("@a", "A", "+", "I"), ("@a", "A", "+", "I"), ("@b", None, "+", "I")], cols)
    b = spark.createDataFrame([("@b", None, "+", "I"), ("@a", "A", "+", "I")], cols)
    assert tuple(evaluate.same_records(a, b).first()) == (0, 0, True)
    assert tuple(evaluate.same_records(a, b, as_sets=False).first()) == (1, 0, False)
    assert tuple(evaluate.same_records(a.limit(0), a.limit(0)).first()) == (0, 0, True)


def test_pairs_need_their_mates(spark):
    cols = "file_idx int, read_idx long, header string, seq string, plus string, qual string"
    a = spark.createDataFrame([(0, 0, "@a", "A", "+", "I"), (0, 1, "@b", "C", "+", "I")], cols)
    both = evaluate.paired(a, a.withColumn("seq", F.lower("seq"))).orderBy("read_idx").collect()
    assert [(r["seq"], r["seq2"]) for r in both] == [("A", "a"), ("C", "c")]
    with pytest.raises(Exception, match="no mate"):
        evaluate.paired(a, a.limit(1)).collect()


def test_read_stats_and_mixtures(spark):
    found = spark.createDataFrame([(0, "ok", 1), (0, "failed", None), (0, "unknown", None)], "file_idx int, status string, bcid long")
    assert tuple(evaluate.read_stats(found, found).first()) == (0, 3, 1, 1, 1, 1)
    calls = spark.createDataFrame([(1, 0.2), (1, 0.15), (1, 0.4), (2, 0.5), (2, None)], "bcid long, minor double")
    assert {tuple(r) for r in evaluate.mixed_groups(calls).collect()} == {(1, 3, True), (2, 1, False)}
