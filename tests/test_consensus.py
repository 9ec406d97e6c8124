"""Alignment, base calls and consensus against plain loops."""

import math
import random

import numpy as np
import pytest

from readloom.config import Extraction, Settings
from readloom.functions.dna import LOG_RIGHT, LOG_WRONG
from readloom.operators.align import align, call, fold, merge, profile
from readloom.operators.consensus import consensus, error_rates, failed_lines, fastq_lines, records
from readloom.plans.pipeline import run

f32 = np.float32


def sim(a, b):
    na, nb = math.sqrt(sum(float(x) * x for x in a)), math.sqrt(sum(float(x) * x for x in b))
    return 0.0 if na == 0 or nb == 0 else 2.0 * (sum(float(x) * y for x, y in zip(a, b)) / (na * nb)) - 1.0


def plain_band(ref, query, w, gap):
    """Cell by cell; None if the band proves nothing."""
    m, n, far = len(ref), len(query), f32(-1e30)
    g, score, move = f32(gap), {(0, 0): f32(0)}, {}
    for y in range(n + 1):
        for x in range(max(0, y - w), min(m, y + w) + 1):
            if (x, y) == (0, 0):
                continue
            if y == 0:
                score[x, 0], move[x, 0] = f32(score[x - 1, 0] + g), 2
                continue
            best, t = far, 0
            if x and (x - 1, y - 1) in score:
                best, t = f32(score[x - 1, y - 1] + f32(sim(ref[x - 1], query[y - 1]))), 1
            if x and (x - 1, y) in score:
                cost = g
                if ref[x - 1][4] > 0:
                    cost = f32(g * (f32(1) - f32(ref[x - 1][4]) / f32(sum(ref[x - 1]))))
                if (c := f32(score[x - 1, y] + cost)) > best:
                    best, t = c, 2
            if (x, y - 1) in score and (c := f32(score[x, y - 1] + g)) > best:
                best, t = c, 3
            score[x, y], move[x, y] = best, t
    return score.get((m, n)), move


def plain_align(ref, query, gap):
    m, n = len(ref), len(query)
    longer = max(m, n)

    def back(move):
        x, y, out = m, n, []
        while x or y:
            t = move[x, y]
            out.append(t)
            x, y = x - (t != 3), y - (t != 2)
        return out[::-1]

    if longer > 50:
        w = max(1, math.floor(math.sqrt(longer * 0.04)))
        while True:
            end, move = plain_band(ref, query, w, gap)
            bound = (2.0 * (w + 1) - abs(m - n)) * gap + (min(m, n) - (w + 1))
            if end is not None and float(end) >= bound:
                return back(move)
            if w > longer // 2:
                break
            w = 2 * w if 2 * w <= longer // 2 else longer // 2 + 1
    return back(plain_band(ref, query, longer, gap)[1])


def read(rng, base, rate):
    out = []
    for c in base:
        r = rng.random()
        if r < rate / 3:
            continue
        if r < 2 * rate / 3:
            out.append(rng.choice("ACGT"))
        out.append(rng.choice("ACGTN") if r > 1 - rate / 2 else c)
    s = "".join(out)
    return s, "".join(chr(33 + rng.randint(2, 41)) for _ in s)


@pytest.mark.parametrize("length,rate", [(12, 0.2), (30, 0.1), (60, 0.05), (75, 0.3), (120, 0.02)])
def test_alignment_equals_the_plain_loop(length, rate):
    rng = random.Random(length)
    base = "".join(rng.choice("ACGT") for _ in range(length))
    refs, queries = [], []
    for _ in range(6):
        reads = [read(rng, base, rate) for _ in range(3)]
        size = max(len(s) for s, _ in reads)
        a, b, q = (profile(s, x, size) for s, x in reads)
        refs.append(merge(a, b, np.array(plain_align(a, b, -1.0), np.int8)))
        queries.append(q)
    for gap in (-1.0, -0.5):
        got = align(refs, queries, gap)
        for r, q, moves in zip(refs, queries, got):
            assert moves.tolist() == plain_align(r.tolist(), q.tolist(), gap)


def test_merge_counts_the_other_sides_next_position():
    r, q = profile("AC", "II", 2), profile("GT", "??", 2)
    m = merge(r, q, np.array([2, 1, 3], np.int8))
    wa, wq = r[0, 0], q[0, 2]
    assert m.tolist() == [[wa, 0, 0, 0, wq], [0, wa, wq, 0, 0], [0, 0, 0, wq, 0]]


def plain_call(pile):
    total = [sum(p) for p in pile]
    if not any(total):
        return "", ""
    half = sum(total) / len(pile) / 2
    last = max(i for i, t in enumerate(total) if t > half)
    seq, qual = "", ""
    for p in pile[: last + 1]:
        top = max(p[:4])
        if p[4] > top:
            continue
        if top == 0 or p[:4].count(top) > 1:
            seq, qual = seq + "N", qual + "!"
            continue
        k = p.index(top)
        lp = [s * LOG_RIGHT + (sum(p) - s) * LOG_WRONG for s in p]
        den = math.log10(sum(10**v for v in lp))
        oth = math.log10(sum(10**v for j, v in enumerate(lp) if j != k))
        q = min(40, max(0, math.floor(10 * den - 10 * oth + 0.5)))
        seq, qual = seq + ("N" if q < 4 else "ACGT"[k]), qual + chr(33 + q)
    return seq, qual


def test_calls():
    assert call(np.array([[42, 0, 0, 0, 0]]))[:2] == ("A", chr(33 + 34))
    assert call(np.array([[5, 0, 0, 0, 0]]))[:2] == ("N", chr(33 + 2))
    assert call(np.array([[20, 20, 0, 0, 0]]))[:4] == ("N", "!", 0.5, 0.5)
    assert call(np.zeros((3, 5), int))[:2] == ("", "")
    assert call(np.array([[1, 0, 0, 0, 9], [30, 0, 0, 0, 0]]))[0] == "A"
    rng = random.Random(1)
    for _ in range(200):
        pile = [[rng.choice([0, 0, rng.randint(0, 60)]) for _ in range(5)] for _ in range(6)]
        assert call(np.array(pile))[:2] == plain_call(pile)


def frame(spark, groups, n=4):
    rows, k = [], 0
    for bcid, reads in groups.items():
        for s, q in reads:
            rows.append((bcid, 0, k, f"@r{k}", s, "+", q))
            k += 1
    return spark.createDataFrame(rows, "bcid long, file_idx int, read_idx long, header string, seq string, plus string, qual string").repartition(n, "read_idx")


def test_aligned_consensus_is_the_fold_of_each_group(spark):
    rng = random.Random(3)
    groups = {}
    for g in range(40):
        base = "".join(rng.choice("ACGT") for _ in range(70))
        groups[g] = [read(rng, base, 0.05) for _ in range(rng.choice([1, 2, 3, 9]))]
    how = Settings(extraction=Extraction(length=10))
    got = {r["bcid"]: r for r in consensus(frame(spark, groups), how).collect()}
    assert len(got) == 40
    for g, reads in groups.items():
        want = reads[0] if len(reads) == 1 else call(fold([reads], -1.0)[0])[:2]
        assert (got[g]["seq"], got[g]["qual"]) == tuple(want) and got[g]["count"] == len(reads)


def test_large_groups_are_folded_in_parts(spark, monkeypatch):
    from readloom.operators import consensus as module

    rng = random.Random(9)
    groups, bases = {}, {}
    for g, n in enumerate((1, 7, 20, 21, 230, 2)):
        bases[g] = "".join(rng.choice("ACGT") for _ in range(90))
        groups[g] = [read(rng, bases[g], 0.03) for _ in range(n)]
    how = Settings(extraction=Extraction(length=10))
    whole = {r["bcid"]: r for r in consensus(frame(spark, groups), how).collect()}
    monkeypatch.setattr(module, "PART_READS", 20)
    monkeypatch.setattr(module, "FAN_IN", 3)
    got = {r["bcid"]: r for r in consensus(frame(spark, groups), how).collect()}
    assert {g: r["count"] for g, r in got.items()} == {g: len(x) for g, x in groups.items()}
    assert all(got[g] == whole[g] for g in (0, 1, 2, 5))
    for g in (3, 4):
        assert got[g]["seq"] == bases[g] == whole[g]["seq"] and abs(got[g]["calls"] - whole[g]["calls"]) < 0.02 * whole[g]["calls"]
    again = {r["bcid"]: r for r in consensus(frame(spark, groups).repartition(7), how).collect()}
    assert again == got


def test_partitions_do_not_matter(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    groups = {g: [read(rng, base, 0.1) for _ in range(4)] for g in range(10)}
    how = Settings(extraction=Extraction(length=10))
    a, b = ({tuple(r) for r in consensus(frame(spark, groups, n), how).collect()} for n in (1, 7))
    assert a == b


def test_unaligned_consensus(spark):
    groups = {
        1: [("ACGT", "zzzz")],
        2: [("ACGT", "IIII"), ("ACGA", "IIII"), ("AC", "II")],
        3: [("acgt", "IIII"), ("ACGT", "!!!!")],
        4: [("ACGTT", None), ("ACGT", "5555")],
    }
    how = Settings(extraction=Extraction(length=3), align=False)
    made = records(consensus(frame(spark, groups), how), how)
    got = {r["bcid"]: r for r in made.collect()}
    assert (got[1]["seq"], got[1]["qual"]) == ("ACGT", "zzzz")
    for g in (2, 3, 4):
        length = max(len(s) for s, _ in groups[g])
        want = call(sum(profile(s, q, length) for s, q in groups[g]))
        assert (got[g]["seq"], got[g]["qual"]) == want[:2]
        assert got[g]["minor_frac_max"] == pytest.approx(want[2]) and got[g]["minor_frac_mean"] == pytest.approx(want[3])
        assert (got[g]["calls"], got[g]["missense"], got[g]["indels"]) == want[4:]
    assert got[3]["bc"] is None
    lines = [r["value"] for r in fastq_lines(made).collect()]
    assert any(x.startswith("@bc=ACG;bcid=1;count=1;min_q=89;mean_q=89;minor_frac_mean=0.000;minor_frac_max=0.000\nACGT\n+\nzzzz") for x in lines)
    fails = [r["value"] for r in failed_lines(made, frame(spark, {None: [("AC", "II")]})).collect()]
    assert sorted(fails) == ["@bcid=3;count=2\n\n+\n", "@r0\nAC\n+\nII"]
    rates = error_rates(made).first()
    assert rates["calls"] > 0 and 0 <= rates["missense_rate"] <= 1


@pytest.mark.parametrize("copies", [81, 400])
def test_strong_evidence_has_the_highest_quality(spark, copies):
    # from 81 reads at Q40 on, the other classes' probabilities are 0 in floats
    made = consensus(frame(spark, {1: [("ACGT", "IIII")] * copies}), Settings(align=False)).first()
    assert (made["count"], made.seq, made.qual, made.minor_frac_max, made.missense) == (copies, "ACGT", "IIII", 0.0, 0)


def test_a_strong_group_without_its_barcode_is_a_failed_record(spark):
    how = Settings(extraction=Extraction(length=20), align=False)
    reads = frame(spark, {1: [("ACGT", "IIII")] * 90})
    assert [r.value for r in failed_lines(records(consensus(reads, how), how), reads).collect()] == ["@bcid=1;count=90\nACGT\n+\nIIII"]


def test_pipeline_keeps_every_read(spark):
    rng = random.Random(8)
    bases = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(6)]
    reads = [(0, i, f"@r{i}", *read(rng, rng.choice(bases), 0.02)) for i in range(120)] + [(0, 120, "@s", "AC", "II"), (0, 121, "@n", None, None)]
    df = spark.createDataFrame([(f, i, h, s, "+", q) for f, i, h, s, q in reads], "file_idx int, read_idx long, header string, seq string, plus string, qual string")
    how = Settings(extraction=Extraction(length=8))
    r = run(df, how)
    stats = r.stats().first()
    assert stats["n_reads"] == 122 == r.assigned.count()
    assert stats["n_assigned"] + r.assigned.where("bcid is null").count() == 122
    assert r.assigned.where("status = 'ok' and bcid is null").count() == 0
    assert r.consensus.agg({"count": "sum"}).first()[0] == stats["n_assigned"]


def test_empty_reads(spark):
    df = frame(spark, {1: [("A", "I")]}).limit(0)
    for align_ in (True, False):
        assert consensus(df, Settings(align=align_)).collect() == []
