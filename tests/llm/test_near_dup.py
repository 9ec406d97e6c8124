"""Near-duplicate sequences against comparing all pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from readloom.llm import near_dup as nd


def edited(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        i = rng.randrange(len(s))
        r = rng.random()
        if r < 0.6:
            s[i] = rng.choice("ACGTN")
        elif r < 0.8:
            del s[i]
        else:
            s.insert(i, rng.choice("ACGT"))
    if rng.random() < 0.2:
        k = rng.randrange(len(s))
        s = s[k:] + s[:k]
    return "".join(s)


def reads_of(rng, families, size, length=120):
    out = []
    for _ in range(families):
        base = "".join(rng.choice("ACGT") for _ in range(length))
        out += [edited(rng, base, rng.randint(0, 4)) for _ in range(rng.randint(1, size))]
    return out


def grams(s):
    return {s[i : i + 12] for i in range(len(s) - 11)}


def truth(rows):
    sets = [(i, grams(s.upper())) for i, s in rows if s and len(s) >= 12]
    return {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(sets, 2) if len(x & y) / len(x | y) >= 0.4}


SCHEMA = "read_idx long, seq string, id long, packed string"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, 1, "x") for i, s in rows], SCHEMA).repartition(5)


def test_pairs(spark):
    rng = random.Random(1)
    seqs = reads_of(rng, 80, 6) + ["G" * n for n in (20, 25, 30, 200)] + ["ACGTACGTACGT", "acgtacgtacgtA", "ACGTACGTACG", "", None, "é" * 20, "é" * 21]
    seqs += [seqs[0]] * 5 + [seqs[1].lower()] * 3
    rows = list(enumerate(rng.sample(seqs, len(seqs))))
    want = truth(rows)
    got = [tuple(r) for r in nd.NearDuplicates(frame(spark, rows)).row_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want - set(got)) <= 0.003 * len(want)


def test_adapters_and_crowds(spark, monkeypatch):
    monkeypatch.setattr(nd, "COMMON_ROWS", 20)
    rng = random.Random(2)
    adapter = "".join(rng.choice("ACGT") for _ in range(40))
    seqs = [s[:80] + adapter for s in reads_of(rng, 60, 4)] + [adapter + rng.choice("ACGT") * 3 for _ in range(12)]
    rows = list(enumerate(seqs))
    want = truth(rows)
    got = {tuple(r) for r in nd.NearDuplicates(frame(spark, rows)).row_pairs().collect()}
    assert got <= want and len(want - got) <= 0.01 * len(want)


def test_pairs_alike_by_common_text(spark):
    """Short members of a family lie in long ones, and the text they share is common."""
    rng = random.Random(5)
    core = "".join(rng.choice("ACGT") for _ in range(80))
    long = [core + "".join(rng.choice("ACGT") for _ in range(75)) for _ in range(90)]
    brief = [core[: rng.randint(70, 80)] + rng.choice("ACGT") * rng.randint(1, 2) for _ in range(10)]
    rows = list(enumerate(long + brief + reads_of(rng, 10, 4)))
    want = truth(rows)
    got = {tuple(r) for r in nd.NearDuplicates(frame(spark, rows)).row_pairs().collect()}
    assert len(want) > 700 and got == want


def test_exact_join_at_odd_sizes(monkeypatch):
    rng = random.Random(6)
    seqs = [s[: rng.randint(12, 120)] for s in reads_of(rng, 12, 9) + ["ACGTACGTTACG" * 6] * 5]
    h, begin = nd.substring_hashes(*nd.unpack(nd.pack(pa.array(seqs))), nd.SHINGLE)
    order = np.unique(h)[::3]
    row, token, size, left, _ = nd._prefixes(h, begin, (order, np.arange(len(order)) % 5), 0.4)
    want = None
    for part in (1000, 7, 2):  # whole buckets, and buckets cut into parts
        monkeypatch.setattr(nd, "PART", part)
        entry, key, side = nd._parts(row, token, np.bincount(np.unique(token, return_inverse=True)[1])[np.unique(token, return_inverse=True)[1]])
        at = side << 60 | (size << 32 | left)[entry]
        pairs = [(a, b) for r in nd._overlaps(key.view(np.int64), row[entry], at, 0.4) for a, b in zip(*(c.to_pylist() for c in r.columns))]
        want = want or sorted(pairs)
        assert sorted(pairs) == want
    assert truth(list(enumerate(seqs))) <= set(want)


def test_order_of_exact_join_counts_all_rows(spark, monkeypatch):
    """Not those of a sample: the counts that _band_rows is given are the whole table's."""
    monkeypatch.setattr(nd, "ORDER_ROWS", 20, raising=False)
    real, given = nd._band_rows, []
    monkeypatch.setattr(nd, "_band_rows", lambda common, order, *rest: given.append((order, *rest)) or real(common, order, *rest))
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(2)]
    rows = list(enumerate([texts[0]] * 60 + [texts[1]] * 140 + ["".join(rng.choice("ACGT") for _ in range(100)) for _ in range(40)]))
    nd.NearDuplicates(frame(spark, rows)).class_pairs()
    (((codes, counts), scale, _),) = given
    want = {}
    for text, n in zip(texts, (60, 140)):
        h, _ = nd.substring_hashes(*nd.unpack(nd.pack(pa.array([text]))), nd.SHINGLE)
        want |= dict.fromkeys(h.tolist(), n)
    assert scale == 1 and dict(zip(codes.tolist(), counts.tolist())) == want


def test_crowded_buckets_pair_whole():
    """Each member shares the family's least anchor of a band with all others, and its next one with few."""
    rng = random.Random(7)
    anchor = "".join(rng.choice("ACGT") for _ in range(16))
    seqs = [anchor + "".join(rng.choice("ACGT") for _ in range(40)) for _ in range(150)]
    ids = pa.array(range(150), pa.int64())
    none = np.empty(0, np.uint64)
    rows = [r for b in nd._band_rows(none, (none, np.empty(0, np.int64)), 1, 0.4)([pa.RecordBatch.from_arrays([ids, nd.pack(pa.array(seqs))], names=["id", "packed"])]) for r in b.to_pylist()]
    h = nd.substring_hashes(*nd.unpack(nd.pack(pa.array(seqs))), nd.ANCHOR)
    least = nd._minima(*h, nd.BANDS)[1]
    want = {(a, b) for a, b in itertools.combinations(range(150), 2) if (least[a] == least[b]).any()}
    rows.sort(key=lambda r: r["key"])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 70]) for i in range(0, len(rows), 70)]
    got = {(a, b) for r in nd._pairs_in_runs(0.4)(iter(batches)) for a, b in zip(*(c.to_pylist() for c in r.columns))}
    assert got == want


def test_large_families_and_fragments(spark):
    """Hundreds of near copies of one read, and reads that hold another, at any partitioning and batch size."""
    rng = random.Random(8)
    base, core = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (150, 110))
    family = ["".join(rng.choice("ACGT") if i in cut else c for i, c in enumerate(base)) for cut in (set(rng.sample(range(150), 5)) for _ in range(400))]
    whole = [rng.choice("ACGT") * 2 + core + "".join(rng.choice("ACGT") for _ in range(60)) for _ in range(60)]
    rows = list(enumerate(family + whole + [core[rng.randint(0, 8) :] for _ in range(60)] + reads_of(rng, 60, 5)))
    want = truth(rows)
    found = []
    for parts, size in ((3, 10_000), (11, 50)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        found.append({tuple(r) for r in nd.NearDuplicates(frame(spark, rows).repartition(parts)).row_pairs().collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] <= want and len(found[0]) >= 0.99 * len(want) and len(want) > 10_000


def test_copies_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(nd, "COPIES", 3)
    rows = [(i, "acgtacgtacgtA" if i % 3 else "TTTTGGGGCCCCA") for i in range(40)]
    got = [tuple(r) for r in nd.NearDuplicates(frame(spark, rows)).copy_pairs().collect()]
    assert sorted(got) == sorted((a, b) for a, b in itertools.combinations(range(40), 2) if (a % 3 > 0) == (b % 3 > 0))


def test_groups(spark):
    rng = random.Random(3)
    seqs = reads_of(rng, 30, 5)
    rows = list(enumerate(seqs + seqs[:10]))
    pairs = truth(rows)
    got = {r["read_idx"]: r for r in nd.NearDuplicates(frame(spark, rows)).groups().collect()}
    assert set(got) == {i for i, s in rows}
    for a, b in pairs:
        assert got[a]["group_id"] == got[b]["group_id"]
    assert all(r["group_id"] <= i and r["class_id"] <= i for i, r in got.items())
    assert len({r["class_id"] for r in got.values()}) == len({s for _, s in rows})


def test_nothing(spark):
    none = frame(spark, [(1, "A" * 30)]).limit(0)
    assert nd.NearDuplicates(none).row_pairs().collect() == [] and nd.NearDuplicates(none).groups().collect() == []
    short = frame(spark, [(1, "ACG"), (2, None), (3, "")])
    assert nd.NearDuplicates(short).row_pairs().collect() == []


def test_packing_is_reversible():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACGT" if rng.random() < 0.7 else "ACGTN*é") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    packed = nd.pack(pa.array(texts))
    assert [nd.text_of(x) for x in packed.to_pylist()] == texts
    letters, starts = nd.unpack(packed.slice(5, 100))
    assert ["".join(map(chr, letters[a:b])) for a, b in itertools.pairwise(starts)] == texts[5:105]
    assert len(set(packed.to_pylist())) == len(set(texts))


@pytest.mark.parametrize("edits,low", [(0, 0.99), (1, 0.6), (3, 0.3)])
def test_odd_sketch_estimates(edits, low):
    rng = random.Random(edits)
    a = ["".join(rng.choice("ACGT") for _ in range(150)) for _ in range(60)]
    b = [edited(rng, s, edits) for s in a] if edits else list(a)
    row, h = nd.distinct_hashes(*nd.substring_hashes(*nd.unpack(nd.pack(pa.array(a + b))), 12))
    maps, filled = nd.bitmaps(row, h, 120)
    est = nd.sketch_similarity(maps[:60], maps[60:], np.maximum(filled[:60], filled[60:]))
    real = np.array([len(grams(x) & grams(y)) / len(grams(x) | grams(y)) for x, y in zip(a, b)])
    assert np.abs(est - real).max() < nd.SLACK and real.mean() > low - 0.2
    shared, either = nd.common_counts(row, h, 120, np.arange(60), np.arange(60) + 60)
    assert np.allclose(shared / either, real)
