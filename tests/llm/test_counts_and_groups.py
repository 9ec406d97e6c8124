"""Frequent items, linked groups and survivors against plain loops."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm.components import connected_components, linked_entries
from readloom.llm.heavy_hitters import SpaceSaving, frequent_items, frequent_reads, summaries
from readloom.llm.survivorship import CURRENT, learn_relations, precedence, survivors
from readloom.session import Scratch


def test_space_saving_bounds():
    rng = random.Random(1)
    true, s = Counter(), SpaceSaving(20)
    for _ in range(60):
        batch = Counter(f"x{int(rng.paretovariate(0.8))}" for _ in range(200))
        true += batch
        s.merge({k: (n, 0) for k, n in batch.items()})
    assert len(s.counts) <= 20 and s.floor <= sum(true.values()) / 20
    for k, n in true.items():
        upper, error = s.counts.get(k, (s.floor, s.floor))
        assert upper - error <= n <= upper


@pytest.mark.parametrize("parts", [1, 9, 40])
def test_frequent_items(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["A", " a", "B\r", None, f"r{i}"]), rng.choice([None, "ACG", "acg ", f"s{i}"]), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "bc string, seq string, item string").repartition(parts)
    got = {(r["field_name"], r["item"]): r for r in frequent_reads(df, 0.01).collect()}
    want = {}
    for k, field in enumerate(("bc", "seq")):
        c = Counter(r[k].strip().upper() for r in rows if r[k] is not None)
        want |= {(field, v): n for v, n in c.items() if n >= 30}
    assert {k: r["n_rows"] for k, r in got.items()} == want
    for r in got.values():
        assert r["approx_count"] - r["max_error"] <= r["n_rows"] <= r["approx_count"]


def test_frequent_items_ties_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", None), ("b", None)], "f string, g string")
    assert {r["item"] for r in frequent_items(df, ["f", "g"], 0.5).collect()} == {"a", "b"}
    assert frequent_items(df.limit(0), ["f"], 0.5).collect() == []
    assert frequent_items(df.where("f = 'a'").select("g", "f"), ["g"], 0.5).collect() == []


def test_summaries_stay_within_capacity(spark):
    df = spark.range(20_000).selectExpr("cast(id as string) as f").repartition(20)
    assert summaries(df, ["f"], 50).count() == 50


def plain_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "shuffled chain", "rings", "zigzag"])
def test_components(spark, kind):
    rng = random.Random(kind)
    n = 400
    pairs = {
        "random": [(rng.randint(0, n), rng.randint(0, n)) for _ in range(300)],
        "chain": [(i, i + 1) for i in range(n)],
        "star": [(7, i) for i in range(n)],
        "shuffled chain": list(zip(x := rng.sample(range(n), n), x[1:])),
        "rings": [(10 * (i // 10) + i % 10, 10 * (i // 10) + (i + 1) % 10) for i in range(n)],
        "zigzag": [(i, n - i) for i in range(n // 2)] + [(n - i, i + 1) for i in range(n // 2)],
    }[kind]
    pairs += [(3, 3), (None, 4), (5, None), pairs[0], pairs[0][::-1]]
    df = spark.createDataFrame(pairs, "a long, b long")
    for last in (0, 20, 50_000):  # all rounds over the cluster, the last ones in one task, all in one task
        got = {r["id"]: r["component"] for r in connected_components(df, Scratch(spark), last=last).collect()}
        assert got == plain_components(pairs)


def test_components_with_hot_labels(spark):
    pairs = [(0, i) for i in range(1, 60_001)] + [(i, 100_000 + i) for i in range(1, 60_001)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = connected_components(df, Scratch(spark), last=0)
    assert got.where("component = 0").count() == got.count() == 120_001


def test_components_of_nothing(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert connected_components(df, Scratch(spark)).collect() == [] == connected_components(df, Scratch(spark), last=0).collect()


def test_linked_entries(spark):
    entries = spark.createDataFrame([("AC", 5, 30), ("AC", 5, 30), (" ag\r", 1, 10), ("AT", 2, 20), ("GG", None, 40), (None, 1, 50), ("TT", 1, 60)], "barcode string, n long, uf_idx long")
    matches = spark.createDataFrame(
        [("ac", "AG"), ("AG", "AC"), ("AT", "AC "), ("GG", "GG"), ("GG", None), ("GG", "none"), ("none", "TT"), (None, None)], "src string, dst string"
    ).selectExpr("*", "1 as id", "2 as a")
    got = sorted(tuple(r) for r in linked_entries(entries, matches).collect())
    assert got == [(10, 10), (10, 20), (10, 30)]
    assert linked_entries(entries.limit(0), matches).collect() == []
    assert linked_entries(entries, matches.limit(0)).collect() == []


COLS = "rec_id long, bc string, bcid long, n_reads long, min_q int, mean_q int, seq string, qual string, made_at timestamp, s int"
T0 = datetime(2024, 1, 1)


def rows_of(rng, n):
    out = []
    for i in range(n):
        seq = rng.choice([None, "", "ACGT", "ACNT", "acgt", "ACG"])
        qual = rng.choice([None, "", "IIII", "!!!!", "III"])
        out.append(
            (i, rng.choice(["A", "a ", "B", f"x{i}", None]), rng.choice([None, 1]), rng.choice([None, -1, 0, 3, 8]), rng.choice([None, 0, 10]), rng.choice([None, 20, 30]), seq, qual,
             rng.choice([None, T0 + timedelta(days=rng.randint(0, 9))]), 1)
        )
    return out


@pytest.mark.parametrize("seed", range(4))
def test_survivors(spark, seed):
    rows = rows_of(random.Random(seed), 60)
    groups = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            groups[r[1].strip().upper()].append(r)
    want = {}
    for bc, g in groups.items():
        if len(g) < 2:
            continue
        when = lambda r: r[8] or datetime.min
        s = [r for r in g if r[6] and r[7] and len(r[6]) == len(r[7])]
        c = [r for r in g if r[3] is not None and r[3] > 0]
        best = max(s, key=lambda r: (sum(x in "ACGTacgt" for x in r[6]), sum(map(ord, r[7])), when(r), r[0]), default=None)
        last = max(c, key=lambda r: (when(r), r[0]), default=None)
        want[bc] = (best and best[0], last and last[0], best and best[6], last and last[3])
    df = spark.createDataFrame(rows, COLS).repartition(3)
    got = {r["bc"]: r for r in survivors(df, texts=True).collect()}
    assert {k: (r["seq_rec_id"], r["count_rec_id"], r["seq"], r["n_reads"]) for k, r in got.items()} == want


def test_currency_is_learned(spark):
    # mean_q only ever rises with time, in many dated groups; the undated row of group Z has the highest
    rows = []
    for g in range(40):
        for k, q in enumerate((20, 30, 35)):
            rows.append((len(rows), f"g{g}", 1, 2 ** (k + 1), 1, q, "A", "I", T0 + timedelta(days=k), 1))
    rows += [(1000, "Z", 1, 2, 1, 30, "A", "I", T0, 1), (1001, "Z", 1, 4, 1, 35, "A", "I", None, 1)]
    rows += [(1002, "Y", 1, 2, 1, 30, "A", "I", T0, 1), (1003, "Y", 1, 1, 1, 20, "A", "I", None, 1)]
    rows += [(1004, "W", 1, 2, 1, 20, "A", "I", None, 1), (1005, "W", 1, 1, 1, 35, "A", "I", None, 1)]
    # unknown to the order: it stays beside the latest known value, and the larger rec_id wins
    rows += [(1006, "V", 1, 2, 1, 35, "A", "I", None, 1), (1007, "V", 1, 1, 1, 77, "A", "I", None, 1), (1008, "V", 1, 1, 1, 20, "A", "I", None, 1)]
    df = spark.createDataFrame(rows, COLS)
    for parts in (1, 13):
        found = learn_relations(df.repartition(parts), CURRENT, Scratch(spark))
        assert sorted(found["mean_q"]) == [(20, 30), (30, 35)] and sorted(found["n_reads_inferred"]) == [(2, 4), (4, 8)]
        assert found["min_q"] == []
    got = {r["bc"]: r for r in survivors(df, CURRENT).collect()}
    assert [got[g]["mean_q"] for g in "ZYWV"] == [35, 30, 35, 77]
    assert got["Z"]["n_reads"] == 2 and got["Z"]["n_reads_inferred"] == 4


def test_transitions_across_partitions(spark):
    # twelve partitions of twelve rows: nearly every change lies across a cut
    rows = [(i, "ABCD"[i // 3], 1, 1, 1, (10, 20, 30)[i % 3], "A", "I", T0 + timedelta(hours=i // 2), 1) for i in range(12)]
    df = spark.createDataFrame(rows, COLS)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(learn_relations(df, CURRENT, Scratch(spark))["mean_q"]) == []  # 4 against 0 is under three deviations
        more = df.unionByName(df.withColumn("bc", F.concat("bc", F.lit("x")))).unionByName(df.withColumn("bc", F.concat("bc", F.lit("y"))))
        assert sorted(learn_relations(more, CURRENT, Scratch(spark))["mean_q"]) == [(10, 20), (20, 30)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_precedence_is_a_partial_order():
    rng = np.random.default_rng(1)
    after = precedence([(int(a), int(b)) for a, b in rng.integers(0, 12, (16, 2)) if a != b])
    for u, seen in after.items():
        assert u not in seen
        for v in seen:
            assert u not in after[v] and after[v] <= seen
    assert precedence([(1, 2), (2, 3), (3, 2), (3, 4)]) == {1: {2, 3, 4}, 2: {4}, 3: {4}, 4: set()}


def test_survivors_of_nothing(spark):
    df = spark.createDataFrame(rows_of(random.Random(1), 3), COLS).limit(0)
    assert survivors(df, CURRENT, texts=True).collect() == []
