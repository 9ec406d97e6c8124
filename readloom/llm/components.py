"""One group identifier for all records linked directly or indirectly."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.text import value_of
from readloom.operators.salted import HOT, HOT_ROWS, hot_keys, salted_lookup
from readloom.session import Scratch

#: Edges that one task can finish: 16 bytes each.
LAST_EDGES = 50_000


def boruvka(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, smallest label of its group) of all ends of edges u < v, by the rounds of ``connected_components``."""
    labels, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(ends, 2)
    group = np.arange(len(labels))
    while len(a):
        up = np.arange(len(labels))
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        smallest = np.full(len(labels), len(labels))
        np.minimum.at(smallest, x, y)
        up[x] = smallest[x]
        root = (up[up] == np.arange(len(up))) & (np.arange(len(up)) < up)
        up[root] = np.nonzero(root)[0]
        while not np.array_equal(up, up[up]):
            up = up[up]
        group = up[group]
        a, b = up[a], up[b]
        code = np.unique((np.minimum(a, b) * len(labels) + np.maximum(a, b))[a != b])
        a, b = code // len(labels), code % len(labels)
    return labels, labels[group]


def _last_rounds(batches):
    got = [b for b in batches if len(b)]
    if got:
        u, p = boruvka(*(np.concatenate([b.column(i).to_numpy() for b in got]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(p)], names=["u", "p"])


def _round(edges: DataFrame, left: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The label each label gives way to, and the edges between what is left."""
    ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
    chosen = scratch.put(ends.select("e.u", "e.v").groupBy("u").agg(F.min("v").alias("p"), F.count(F.lit(1)).alias("n")))
    # labels of many edges; no label is chosen by more others than it has edges
    least = max(2 * left // HOT, HOT_ROWS)
    hot = [r[0] for r in chosen.where(F.col("n") > least).select("u").collect()] if left > least else []
    # of two components that chose each other the smaller one becomes the root
    back = chosen.select(F.col("u").alias("p"), F.col("p").alias("pp"))
    root = (F.col("pp") == F.col("u")) & (F.col("u") < F.col("p"))
    tree = scratch.put(salted_lookup(chosen.select("u", "p"), back, "p", "u", hot).select("u", F.when(root, F.col("u")).otherwise(F.col("p")).alias("p")))
    done = [tree.where("u = p")]
    going, told = tree.where("u <> p"), hot
    while True:
        # a label whose parent is a root is done; the others point to their grandparents
        up = tree.select(F.col("u").alias("p"), F.col("p").alias("q"))
        step = scratch.put(salted_lookup(going, up, "p", "u", told).select("u", "p", "q"))
        done.append(step.where("p = q").select("u", "p"))
        going = step.where("p <> q").select("u", F.col("q").alias("p"))
        if not (n := going.count()):
            break
        told = hot_keys(going, "p", n)
        tree = reduce(DataFrame.unionByName, [*done, going])
    tree = scratch.put(reduce(DataFrame.unionByName, done))
    to = tree.select("u", F.col("p").alias("pu"))
    half = salted_lookup(edges, to, "u", "v", hot).select(F.col("v").alias("u"), F.col("pu"))
    whole = salted_lookup(half, to.withColumnRenamed("pu", "pv"), "u", "pu", hot).where(F.col("pu") != F.col("pv"))
    return tree, scratch.put(whole.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())


def connected_components(pairs: DataFrame, scratch: Scratch, src: str = "a", dst: str = "b", last: int = LAST_EDGES) -> DataFrame:
    """Deterministic Borůvka hooking: (id, component) of every id in a pair with another id.

    In each round every component selects its smallest outgoing edge. Edges are ordered by their
    smaller and then their larger end, so the selected edge leads to the smallest neighbour, the
    selections form trees whose only cycles are two components that chose each other, and the
    smaller of these two is the root, which is also the smallest label of its tree. Pointer
    doubling collapses each tree to its root, edges are relabelled and deduplicated, and the rounds
    end when no edge is left. At least half of the labels that still have edges vanish in a round.

    Every table of a round is written to the shared folder, so no lineage grows and a lost executor
    costs one step. Labels that own many edges are salted in the joins. Once no more than ``last`` edges are
    left, a fixed number, one task runs the same rounds on what is left.

    Nulls, self pairs, repeated and reversed pairs add nothing. ``component`` is the smallest id of
    the group. An empty input gives an empty result.
    """
    both = pairs.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    edges = scratch.put(
        both.select(F.least(src, dst).cast("long").alias("u"), F.greatest(src, dst).cast("long").alias("v")).distinct()
    )
    rounds: list[DataFrame] = []
    while (left := edges.count()) > last:
        tree, nxt = _round(edges, left, scratch)
        rounds.append(tree)
        scratch.drop(edges)
        edges = nxt
    out = edges.coalesce(1).mapInArrow(_last_rounds, "u long, p long")
    for tree in rounds[::-1]:
        up = out.select(F.col("u").alias("p"), F.col("p").alias("q"))
        size = tree.count()
        out = scratch.put(salted_lookup(tree, up, "p", "u", hot_keys(tree, "p", size), "left").select("u", F.coalesce("q", "p").alias("p")))
    return out.select(F.col("u").alias("id"), F.col("p").alias("component"))


def linked_entries(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """(group_uf_idx, uf_idx) of every entry linked to another entry by barcode matches.

    Barcodes are compared in upper case with white space removed at both ends. Repeated entries
    count once; matches with a null or with a barcode that has no entry link nothing.
    """
    spark = entries.sparkSession
    scratch = Scratch(spark)
    ids = entries.select(value_of("barcode").alias("bc"), "uf_idx").where("bc is not null and uf_idx is not null").groupBy("bc").agg(F.min("uf_idx").alias("id"))
    pairs = scratch.put(
        matches.select(value_of("src").alias("s"), value_of("dst").alias("d"))
        .where("s is not null and d is not null and s <> d")
        .select(F.least("s", "d").alias("bc"), F.greatest("s", "d").alias("other"))
        .distinct()
    )
    rows = pairs.count()
    one = salted_lookup(pairs, ids, "bc", "other", hot_keys(pairs, "bc", rows)).select(F.col("other").alias("bc"), F.col("id").alias("a"))
    two = salted_lookup(one, ids, "bc", "a", hot_keys(pairs, "other", rows)).select("a", F.col("id").alias("b"))
    groups = connected_components(two, scratch)
    return groups.select(F.col("component").alias("group_uf_idx"), F.col("id").alias("uf_idx"))
