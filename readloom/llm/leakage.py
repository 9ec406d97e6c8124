"""Held-out passages that appear, in whole or in part, inside documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.hashing import mix
from readloom.session import Scratch, spread

#: Words of the shingles that are min-hashed, and of the passages that count as leaked.
SHINGLE = 5
PASSAGE = 8
#: Bits of the filter for each key, and bits it has at most (32 MB), whatever the number of keys.
BITS_A_KEY = 64
MOST_BITS = 2**28

_STEP = np.uint64(0x9E3779B97F4A7C15)


def cue_words(text: Column) -> Column:
    """Words of a subtitle text: lines with ``-->``, and lines of digits right before one, are dropped,
    ``<...>`` and ``{...}`` become spaces; words are runs of letters and digits in lower case."""
    spoken = F.regexp_replace(text, r"(?dm)^(?:[0-9]+\r?\n)?[^\n]*-->[^\n]*(?:\n|\z)", "")
    return plain_words(F.regexp_replace(F.regexp_replace(spoken, "<[^>]*>", " "), r"\{[^}]*\}", " "))


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def set_minhashes(words: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, minhash) of every run of ``size`` words, as the set of its five-word shingles."""
    offsets = words.offsets.to_numpy()
    base, end = int(offsets[0]), int(offsets[-1])
    flat = words.values.slice(base, end - base)
    if len(flat) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    coded = flat.dictionary_encode()
    each = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    h = each[coded.indices.to_numpy()]
    n = len(h) - SHINGLE + 1
    shingle = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        shingle = shingle * _STEP + h[j : j + n]
    shingle = mix(shingle)
    m = len(h) - size + 1
    least = shingle[:m].copy()
    for j in range(1, size - SHINGLE + 1):
        np.minimum(least, shingle[j : j + m], out=least)
    starts = offsets[:-1] - base
    row = np.repeat(np.arange(len(words)), np.diff(offsets))
    at = np.nonzero(row[:m] == row[size - 1 :])[0]
    return row[at], at - starts[row[at]], least[at]


class KeyFilter:
    """A Bloom filter of two probes. It lets all its keys through and few others."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    @staticmethod
    def bits(keys: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return keys & mask, (keys >> np.uint64(32)) & mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        one, six = np.uint64(1), np.uint64(6)
        hit = np.ones(len(keys), bool)
        for bit in self.bits(keys, self.mask):
            hit &= (self.words[bit >> six] >> (bit & np.uint64(63)) & one).astype(bool)
        return hit

    @classmethod
    def of(cls, keys: DataFrame) -> "KeyFilter":
        """From a column of keys; the executors set the bits, and the driver gets at most MOST_BITS of them."""
        n = max(1, keys.count())
        size = min(MOST_BITS, 1 << max(12, (n * BITS_A_KEY - 1).bit_length()))
        mask = np.uint64(size - 1)

        def run(batches):
            for b in batches:
                bits = np.unique(np.concatenate(cls.bits(b.column(0).to_numpy().view(np.uint64), mask)))
                slot, word = bits >> np.uint64(6), np.uint64(1) << (bits & np.uint64(63))
                at = np.nonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))[0] if len(slot) else []
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slot[at].astype(np.int64)), pa.array(np.bitwise_or.reduceat(word, at).view(np.int64))], names=["slot", "word"]
                    )

        got = keys.mapInArrow(run, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toPandas()
        words = np.zeros(size // 64, np.uint64)
        words[got["slot"].to_numpy(np.int64)] = got["word"].to_numpy(np.int64).view(np.uint64)
        return cls(words)


def _runs(size: int, keep: KeyFilter | None = None):
    """The distinct runs of ``size`` words of each row whose minhash passes: id, key, words in a row."""

    def run(batches):
        for b in batches:
            ids, words = b.column(0), b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            for lo in range(0, len(b), 256):
                part = words.slice(lo, 256)
                row, start, key = set_minhashes(part, size)
                if keep is not None:
                    good = np.nonzero(keep(key))[0]
                    row, start, key = row[good], start[good], key[good]
                if not len(row):
                    continue
                seen = {}
                for r, s, k in zip(row.tolist(), start.tolist(), key.view(np.int64).tolist()):
                    seen[r, " ".join(part[r].values.slice(s, size).to_pylist())] = k
                rows = pa.array([r for r, _ in seen])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, 256).take(rows), pa.array(list(seen.values()), pa.int64()), pa.array([t for _, t in seen], pa.string())],
                    names=["id", "key", "words"],
                )

    return run


_RUNS = "id long, key long, words string"


def _sets(items: DataFrame, size: int) -> DataFrame:
    words = items.select("item_id", plain_words(F.col("text")).alias("words"))
    return words.mapInArrow(_runs(size), _RUNS).distinct().withColumnRenamed("id", "item_id")


def _texts(docs: DataFrame) -> DataFrame:
    return spread(docs.select("doc_id", "text")).select("doc_id", cue_words(F.col("text")).alias("words"))


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_passages, item_passages, containment) of each document that quotes an item.

    Containment search partitioned by size. The sets looked for are the items' passages, eight words or four
    five-word shingles; documents are cut into overlapping runs of that size, so the containment wanted, all four
    shingles, is a Jaccard similarity of 1 and a signature of one MinHash finds each for certain. (See
    ``contained_items`` for sets of other sizes. With documents left whole, a passage in a
    document of u shingles has similarity 4/u, and signatures long enough to find it would hold
    more hashes than the document has shingles.) A filter of the items' signatures, of bounded size, drops
    nearly all runs of the documents where they are read; the others are joined with the passages and
    verified word by word.

    An item or document under eight words, empty or null matches nothing. Repeated items match each
    under its own id; the rows of a repeated doc_id count as one document. n_passages counts distinct
    passages of the item found in the document, containment is their share of the item's distinct
    passages. Empty tables give an empty result. Whole texts are searched, and columns other than
    doc_id, item_id and text are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    index = scratch.put(_sets(items, PASSAGE))
    keep = KeyFilter.of(index.select("key").distinct())
    hits = _texts(docs).mapInArrow(_runs(PASSAGE, keep), _RUNS).withColumnRenamed("id", "doc_id")
    found = hits.join(index, ["key", "words"]).groupBy("doc_id", "item_id").agg(F.count_distinct("words").alias("n_passages"))
    sizes = index.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_passages"))
    return found.join(sizes, "item_id").select(
        "doc_id", "item_id", "n_passages", "item_passages", (F.col("n_passages") / F.col("item_passages")).alias("containment")
    )


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shared, item_shingles, containment) where a document has ``threshold`` of an item's five-word shingles.

    The shared shingles may stand anywhere in the document. Items are partitioned by their number of shingles
    n: at containment t a document has m = ceil(t n) of them, so in any order it has one of any n - m + 1, and
    the n - m + 1 least hashes (a bottom-k MinHash signature whose k follows from the partition's size) find
    every such document for certain, whatever its length. Documents that have a shingle of an item's signature are
    candidates, and their containment is counted exactly over all shingles.

    An item or document under five words, empty or null matches nothing; the rows of a repeated doc_id count as
    one document. Empty tables give an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    index = scratch.put(_sets(items, SHINGLE))
    sizes = scratch.put(index.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_shingles")))
    k = F.col("item_shingles") - F.ceil(F.col("item_shingles") * threshold - 1e-9) + 1

    def least(batches):
        for b in batches:
            pdf = b.to_pandas()
            out = [np.sort(np.asarray(keys).view(np.uint64))[: int(n)].view(np.int64) for keys, n in zip(pdf["keys"], pdf["k"])]
            ids = np.repeat(pdf["item_id"].to_numpy(), [len(o) for o in out])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([*out, np.empty(0, np.int64)]))], names=["item_id", "key"])

    # an item is one row of a table of texts, so its shingles fit in a task as the item does
    whole = index.groupBy("item_id").agg(F.collect_list("key").alias("keys")).join(sizes, "item_id").select("item_id", "keys", k.alias("k"))
    signatures = scratch.put(whole.mapInArrow(least, "item_id long, key long"))
    # the documents' shingles are verified against all shingles of an item, candidates need one of its signature
    keep = KeyFilter.of(index.select("key").distinct())
    hits = scratch.put(_texts(docs).mapInArrow(_runs(SHINGLE, keep), _RUNS).withColumnRenamed("id", "doc_id"))
    candidates = hits.join(signatures, "key").select("doc_id", "item_id").distinct()
    shared = hits.join(index, ["key", "words"]).join(candidates, ["doc_id", "item_id"], "left_semi")
    shared = shared.groupBy("doc_id", "item_id").agg(F.count_distinct("words").alias("n_shared"))
    return (
        shared.join(sizes, "item_id")
        .select("doc_id", "item_id", "n_shared", "item_shingles", (F.col("n_shared") / F.col("item_shingles")).alias("containment"))
        .where(F.col("containment") >= threshold - 1e-9)
    )
