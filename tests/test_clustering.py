"""Neighbours and greedy clustering against the sequential rule."""

import itertools
import random

import pytest

from readloom.config import Context, Extraction, Settings
from readloom.operators.barcodes import assigned, barcode_counts, extracted, indel_pairs, neighbour_pairs, resolve_unknown, substitution_pairs
from readloom.operators.cluster import cluster, diameters, numbered


def deletions(s, k):
    return {"".join(c) for c in itertools.combinations(s, len(s) - k)} if len(s) > k else set()


def near(a, b, mm, indels, fixed):
    if len(a) == len(b) and 0 < sum(x != y for x, y in zip(a, b)) <= min(mm, 2):
        return True
    for k in range(1, min(indels, 2) + 1):
        if fixed:
            if len(a) == len(b) and len(a) > k and (a[:-k] in deletions(b, k) or b[:-k] in deletions(a, k)):
                return a != b
        elif (len(a) == len(b) - k and a in deletions(b, k)) or (len(b) == len(a) - k and b in deletions(a, k)):
            return True
    return False


def greedy(counts, mm, indels, fixed):
    order = sorted(counts, key=lambda b: (-counts[b], len(b), b))
    owner = {}
    for c in order:
        if c in owner:
            continue
        owner[c] = c
        for b in order:
            if b not in owner and near(c, b, mm, indels, fixed):
                owner[b] = c
    return owner


def made(rng, n, lengths):
    out = {}
    while len(out) < n:
        out["".join(rng.choice("ACGT") for _ in range(rng.choice(lengths)))] = rng.randint(1, 6)
    return out


CASES = [(2, 0, True), (1, 1, True), (0, 2, True), (1, 1, False), (2, 2, False), (0, 1, True), (3, -1, True)]


def settings(mm, indels, fixed):
    how = Extraction(length=5, max_indels=indels) if fixed else Extraction(context=Context.parse("^NNNNN"), max_indels=indels)
    return Settings(extraction=how, max_mismatches=mm)


@pytest.mark.parametrize("fixed", [True, False])
def test_deletions_are_never_broadcast(spark, tmp_path, fixed):
    # by its size estimate, that of the small file, Spark would
    counts = made(random.Random(7), 60, [5, 6])
    spark.createDataFrame(list(counts.items()), "barcode string, n long").write.parquet(str(tmp_path / "counts"))
    pairs = indel_pairs(spark.read.parquet(str(tmp_path / "counts")), 2, fixed)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("mm,indels,fixed", CASES)
def test_neighbours_and_clusters(spark, mm, indels, fixed):
    counts = made(random.Random(mm * 100 + indels * 10 + fixed), 120, [5] if fixed else [4, 5, 6])
    df = spark.createDataFrame(list(counts.items()), "barcode string, n long")
    how = settings(mm, indels, fixed)
    pairs = {tuple(r) for r in neighbour_pairs(df, how).collect()}
    assert pairs == {(a, b) for a, b in itertools.permutations(counts, 2) if near(a, b, mm, indels, fixed)}
    for last in (0, 25, 50_000):  # all rounds over the cluster, the last ones in one task, all in one task
        got = {r["barcode"]: r["centroid"] for r in cluster(df, how, last).collect()}
        assert got == greedy(counts, mm, indels, fixed)


def test_chain_and_ids(spark):
    df = spark.createDataFrame([("AAAA", 10), ("AAAC", 5), ("AACC", 1)], "barcode string, n long")
    got = {tuple(r) for r in cluster(df, settings(1, 0, True)).collect()}
    assert got == {("AAAA", "AAAA", 1), ("AAAC", "AAAA", 1), ("AACC", "AACC", 2)}


def test_mixed_edits_do_not_cluster(spark):
    df = spark.createDataFrame([("AAAAA", 9), ("AACAAA", 1), ("AATAA", 1), ("CATAAA", 1)], "barcode string, n long")
    got = {r["barcode"]: r["centroid"] for r in cluster(df, settings(1, 1, False)).collect()}
    assert got["AATAA"] == "AAAAA" and got["CATAAA"] == "CATAAA"


def test_last_base_by_indel_only(spark):
    df = spark.createDataFrame([("ACGTA", 9), ("ACGTC", 1)], "barcode string, n long")
    assert {r["centroid"] for r in cluster(df, settings(0, 1, True)).collect()} == {"ACGTA"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "barcode string, n long")
    assert cluster(none, settings(1, 1, True)).collect() == []
    assert substitution_pairs(none, 2).collect() == [] and indel_pairs(none, 1, True).collect() == []


def test_numbers_are_dense_by_count(spark):
    rng = random.Random(5)
    counts = made(rng, 200, [8])
    got = {r["barcode"]: r["bcid"] for r in numbered(spark.createDataFrame(list(counts.items()), "barcode string, n long")).collect()}
    assert got == {b: i + 1 for i, b in enumerate(sorted(counts, key=lambda b: (-counts[b], b)))}


def test_unknown_bases_are_resolved(spark):
    reads = [(0, i, s) for i, s in enumerate(["AAAAA", "AAAAA", "ACAAA", "GAGAA", "CACAA", "ANAAA", "NANAA", "TNTTT", "NNNAA", "AX AA", None, "AC"])]
    found = extracted(spark.createDataFrame(reads, "file_idx int, read_idx long, seq string"), settings(0, 0, True))
    status = {r["read_idx"]: r["status"] for r in found.collect()}
    assert [status[i] for i in range(12)] == ["ok"] * 5 + ["unknown"] * 3 + ["failed"] * 4
    counts = barcode_counts(found)
    ids = numbered(counts)
    solved = {r["barcode"]: r["bcid"] for r in resolve_unknown(found, counts, ids).collect()}
    number = {r["barcode"]: r["bcid"] for r in ids.collect()}
    # NANAA fits AAAAA (2 reads), GAGAA and CACAA
    assert solved == {"ANAAA": number["AAAAA"], "NANAA": number["AAAAA"]}
    got = {r["read_idx"]: r["bcid"] for r in assigned(found, counts, ids).collect()}
    assert got[5] == number["AAAAA"] and got[7] is None and got[9] is None and got[10] is None


def test_tie_of_unknown_bases(spark):
    reads = [(0, i, s) for i, s in enumerate(["CAGAA", "GACAA", "NANAA"])]
    found = extracted(spark.createDataFrame(reads, "file_idx int, read_idx long, seq string"), settings(0, 0, True))
    counts = barcode_counts(found)
    ids = numbered(counts)
    number = {r["barcode"]: r["bcid"] for r in ids.collect()}
    # the first N varies fastest: GACAA has rank 2 + 4*1, CAGAA 1 + 4*2
    assert [r["bcid"] for r in resolve_unknown(found, counts, ids).collect()] == [number["GACAA"]]


def test_diameters(spark):
    rows = [("AAAA", 500), ("AAAC", 3), ("AACC", 2), ("AAA", 1), ("GGGG", 50)]
    counts = spark.createDataFrame(rows, "barcode string, n long")
    assign = spark.createDataFrame([(b, "GGGG" if b == "GGGG" else "AAAA", 2 if b == "GGGG" else 1) for b, _ in rows], "barcode string, centroid string, bcid long")
    (r,) = diameters(counts, assign, 100, 2).collect()
    assert (r.bcid, r.n_reads, r.max_distance, r.n_other_length, r.n_sampled, r.suspicious) == (1, 506, 2, 1, 3, True)
