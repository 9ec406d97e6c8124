"""Pairs of sequences alike but for small edits, and the groups they form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.components import connected_components
from readloom.llm.hashing import mix as _mix
from readloom.session import Scratch, spread

#: Length of the substrings that similarity counts.
SHINGLE = 12
#: Length of the substrings that are min-hashed into bands. Longer ones are not shared by chance.
ANCHOR = 16
BANDS = 16
#: Bins of the one-permutation MinHash that the parity bitmap folds, and bits of the bitmap.
SAMPLES = 64
BITS = 256
#: A candidate is dropped unverified if its sketch estimate is this far below the threshold.
SLACK = 0.3
#: Sequences shorter than this are joined exactly.
SHORT = 40
#: An anchor in at least this share of the sequences (and COMMON_ROWS of them) is common: an adapter, or one
#: with a misread base.
COMMON = 1e-4
COMMON_ROWS = 64
#: A sequence with this share of common anchors has twice the bands, since those it may share with a partner leave
#: the rest less alike; one with the second share is joined exactly.
SOME_COMMON, MANY_COMMON = 1 / 8, 1 / 4
#: Substrings of one length a partition holds before it counts them, and counters it keeps.
BUFFER = 4_000_000
#: Pairs are formed in blocks of as many as 256 buckets of this many sequences have, so a crowded bucket takes several.
CROWD = 64
#: A bucket of the exact join that may hold more sequences than this is cut into parts; each pair of parts is a bucket.
PART = 20_000
#: Copies of one text are paired in parts of this many.
COPIES = 2_000

_P = np.uint64(0x9E3779B97F4A7C15)
_ODD = (np.random.default_rng(20240302).integers(1, 2**62, 64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
_BASE = np.frombuffer(b"ACGT", np.uint8)
#: First byte of a packed text that is kept as UTF-8 since it has other characters than A, C, G, T.
_PLAIN = 255


def _indices(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[i], at[i] + 1, ... at[i] + size[i] - 1 for each i."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(at - before, size)


def pack(seqs: pa.Array) -> pa.Array:
    """Texts as bytes, equal where the texts are: four bases a byte after a byte with length mod 4, or UTF-8."""
    flat = seqs.cast(pa.string())
    offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    data = flat.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    starts = offsets - offsets[0]
    size = np.diff(starts)
    code = _CODE[raw]
    other = np.nonzero(code > 3)[0]
    plain = np.zeros(len(size), bool)
    plain[np.searchsorted(starts, other, "right") - 1] = True
    code[other] = 0
    quarter = (size + 3) // 4
    bases = np.zeros(int(quarter.sum()) * 4, np.uint8)
    bases[_indices((np.cumsum(quarter) - quarter) * 4, size)] = code
    four = bases.reshape(-1, 4)
    byte = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    held = np.where(plain, size, quarter)
    out_at = np.concatenate([[0], np.cumsum(held + 1)])
    out = np.zeros(out_at[-1], np.uint8)
    out[out_at[:-1]] = np.where(plain, _PLAIN, size % 4)
    good = np.nonzero(~plain)[0]
    out[_indices(out_at[good] + 1, held[good])] = byte[_indices((np.cumsum(quarter) - quarter)[good], held[good])] if plain.any() else byte
    bad = np.nonzero(plain)[0]
    out[_indices(out_at[bad] + 1, held[bad])] = raw[_indices(starts[bad], held[bad])]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(out_at.astype(np.int32)), pa.py_buffer(out)])


_FOUR = _BASE[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3]


def unpack(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all packed texts in a row, and where each text starts (one more entry than texts)."""
    if not len(packed):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    data = np.frombuffer(packed.buffers()[2], np.uint8)
    tag, held = data[offsets[:-1]], np.diff(offsets) - 1
    plain = tag == _PLAIN
    bad, good = np.nonzero(plain)[0], np.nonzero(~plain)[0]
    kept = data[_indices(offsets[bad] + 1, held[bad])]
    if len(kept) and kept.max() > 127:  # characters, not bytes, count
        texts = [text_of(x) for x in packed.to_pylist()]
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return letters, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    size = np.where(plain, held, held * 4 - (-tag.astype(np.int64)) % 4)
    starts = np.concatenate([[0], np.cumsum(size)])
    four = _FOUR[data[_indices(offsets[good] + 1, held[good])]].ravel()
    bases = four[_indices((np.cumsum(held[good]) - held[good]) * 4, size[good])]
    if not len(bad):
        return bases, starts
    letters = np.empty(starts[-1], np.uint8)
    letters[_indices(starts[good], size[good])] = bases
    letters[_indices(starts[bad], size[bad])] = kept
    return letters, starts


def text_of(x: bytes) -> str:
    if x[0] == _PLAIN:
        return x[1:].decode()
    codes = "".join("ACGT"[b >> k & 3] for b in x[1:] for k in (6, 4, 2, 0))
    return codes[: len(codes) - (-x[0]) % 4]


def _packed(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pack(b.column(1))], names=["read_idx", "packed"])


def _rolling(x: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all windows of k values; the hash of two windows in a row follows from theirs."""
    out, have, block, size = None, 0, x, 1
    while True:
        step = np.uint64(pow(int(_P), size, 1 << 64))
        if k & size:
            if out is None:
                out = block
            else:
                n = len(x) - have - size + 1
                out = out[:n] * step
                out += block[have : have + n]
            have += size
        if have == k:
            return out
        longer = block[:-size] * step
        longer += block[size:]
        block, size = longer, size * 2


def substring_hashes(letters: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-character substrings, text by text, and where each text's hashes start."""
    counts = np.maximum(np.diff(starts) - k + 1, 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    if len(letters) < k or begin[-1] == 0:
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    h = _rolling(letters.astype(np.uint64) + np.uint64(1), k)
    return _mix(h[_indices(starts[:-1], counts)]), begin


def _minima(hashes: np.ndarray, begin: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with any hash, their least hash under each of ``bands`` permutations)."""
    rows = np.nonzero(np.diff(begin))[0]
    if not len(rows):
        return rows, np.empty((0, bands), np.uint64)
    at = begin[:-1][rows]
    return rows, np.stack([np.minimum.reduceat(hashes * _ODD[i], at) for i in range(bands)], axis=1)


def _keep(hashes: np.ndarray, begin: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that are not in the sorted array ``drop``."""
    if not len(drop) or not len(hashes):
        return hashes, begin
    at = np.minimum(np.searchsorted(drop, hashes), len(drop) - 1)
    good = drop[at] != hashes
    return hashes[good], np.concatenate([[0], np.cumsum(good)])[begin]


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each stands in the array."""
    codes = np.sort(codes)  # np.unique hashes, which takes many times as long
    first = np.nonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))[0]
    return codes[first], np.diff(np.concatenate([first, [len(codes)]]))


def _merge(c: np.ndarray, n: np.ndarray, buffer: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted codes ``c`` with their counts ``n``, and those of the buffer added."""
    new, times = _runs(np.concatenate(buffer))
    if not len(c):
        return new, times
    codes, counts = np.concatenate([c, new]), np.concatenate([n, times])
    order = np.argsort(codes, kind="stable")  # fast, as both are sorted
    codes, counts = codes[order], counts[order]
    first = np.nonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))[0]
    return codes[first], np.add.reduceat(counts, first)


def _count_substrings(sizes: tuple[int, ...]):
    """Counts of the substrings of each size that are frequent in a partition, in at most BUFFER counters a size (lossy counting)."""

    def run(batches):
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        kept, buffer, held = [none for _ in sizes], [[] for _ in sizes], [0 for _ in sizes]
        rows, lost = 0, [0 for _ in sizes]
        for b in batches:
            letters, starts = unpack(b.column(0))
            rows += len(b)
            for i, size in enumerate(sizes):
                h, _ = substring_hashes(letters, starts, size)
                buffer[i].append(h)
                held[i] += len(h)
                if held[i] > BUFFER:
                    c, n = _merge(*kept[i], buffer[i])
                    while len(c) > BUFFER // 2:
                        lost[i] += 1
                        c, n = c[n > 1], n[n > 1] - 1
                    kept[i], buffer[i], held[i] = (c, n), [], 0
        for i, size in enumerate(sizes):
            c, n = _merge(*kept[i], buffer[i]) if held[i] else kept[i]
            often = n >= max(2, rows * COMMON * 0.8 - lost[i])
            code, n = c[often].view(np.int64), n[often].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), size, np.int32)), pa.array(code), pa.array(n)], names=["size", "code", "n"])

    return run


def frequent_substrings(seqs: DataFrame, rows: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes of the common anchors, and sorted hashes of the frequent shingles with their counts.

    Common anchors are found in at least COMMON of the rows, and frequent shingles too. All rows are counted, in one
    pass for both. There are at most (mean substrings of a sequence)/COMMON of either, whatever the number of rows, so
    they may go to the driver and into the tasks. Counts are lower bounds: an anchor spread so
    thinly that a partition drops it may stay in use, which costs time but loses no pair. In a partition a count falls short by
    0.8 COMMON of its rows, or by one more than their substrings / (BUFFER / 2), at most. The exact join is right with
    any order of the shingles; one that puts frequent ones last leaves it few candidates.
    """
    least = F.when(F.col("size") == ANCHOR, max(int(COMMON * rows), COMMON_ROWS)).otherwise(max(int(COMMON * rows), 4))
    got = seqs.mapInArrow(_count_substrings((ANCHOR, SHINGLE)), "size int, code long, n long")
    got = got.groupBy("size", "code").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    size, codes, n = got["size"].to_numpy(), got["code"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    by = np.argsort(codes)
    size, codes, n = size[by], codes[by], n[by]
    return codes[size == ANCHOR], (codes[size == SHINGLE], n[size == SHINGLE])


def _prefixes(hashes: np.ndarray, begin: np.ndarray, order: tuple[np.ndarray, np.ndarray], threshold: float):
    """(row, shingle, distinct shingles of the row, those of them from this one on, count in ``order``) for the prefix of each row.

    In one order of all shingles, two rows whose similarity reaches the threshold share a shingle of these: all
    but the last ``threshold`` of a row's shingles, as any partner has that many of them.
    """
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    codes, counts = order
    times = np.zeros(len(hashes), np.int64)
    if len(codes):
        at = np.minimum(np.searchsorted(codes, hashes), len(codes) - 1)
        times = np.where(codes[at] == hashes, counts[at], 0)
    by = np.lexsort((hashes, times, row))
    row, h, times = row[by], hashes[by], times[by]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, bool)
    row, h, times = row[new], h[new], times[new]
    size = np.bincount(row, minlength=len(begin) - 1)
    left = np.cumsum(size)[row] - np.arange(len(row))
    use = left >= threshold * size[row] - 1e-9
    return row[use], h[use], size[row[use]], left[use], times[use]


def _parts(ids: np.ndarray, token: np.ndarray, rows: np.ndarray):
    """(entry, key, side) of the buckets an entry (a sequence by a shingle) goes to.

    A shingle that ``rows`` sequences may have has parts of PART sequences. An entry goes to the bucket of its part
    with itself (side 2: all pair) and with each other part (sides 0 and 1: those of different sides pair).
    """
    parts = np.maximum(1, -(-rows // PART))
    own = (_mix(ids.view(np.uint64) ^ _P) % parts.astype(np.uint64)).astype(np.int64)
    entry = np.repeat(np.arange(len(token)), parts)
    other = _indices(np.zeros(len(token), np.int64), parts)
    own = own[entry]
    pair = (np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64)
    side = np.where(own == other, 2, own > other)
    return entry, _mix(token[entry] + pair * _P) | np.uint64(1), side


def _band_rows(common: np.ndarray, order: tuple[np.ndarray, np.ndarray], scale: int, threshold: float):
    """Keys by which sequences meet.

    Even ones are band keys, of a sequence's least rare anchor under each permutation. Odd ones are shingles of
    sequences that are joined exactly, with the side, the number of shingles and of those left (``at``: side << 60 | size << 32 |
    left; 2, 1 and 1 in the rows of bands, so that all of a bucket pair). ``order`` counts one of ``scale`` sequences, 1 being all.
    """

    def batch(key, ids, rows, at):
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.take(pa.array(rows)), pa.array(at)], names=["key", "id", "at"])

    def bands(rows, minima, ids, space: int):
        tag = np.arange(minima.shape[1], dtype=np.uint64) + np.uint64(space * 64)
        # 48 bits tell buckets apart, and the zeros need no disk
        key = _mix(minima + tag[None, :] * _P) >> np.uint64(16) << np.uint64(16)
        return batch(key.ravel(), ids, np.repeat(rows, minima.shape[1]), np.full(key.size, 2 << 60 | 1 << 32 | 1))

    def run(batches):
        for big in batches:
            for lo in range(0, len(big), 4000):
                b = big.slice(lo, 4000)
                ids = b.column(0)
                letters, starts = unpack(b.column(1))
                h, begin = substring_hashes(letters, starts, ANCHOR)
                rare, rare_begin = _keep(h, begin, common)
                anchors = np.diff(begin)
                share = 1 - np.diff(rare_begin) / np.maximum(anchors, 1)
                rows, minima = _minima(rare, rare_begin, BANDS)
                yield bands(rows, minima, ids, 0)
                some = share[rows] >= SOME_COMMON
                if some.any():
                    again = _minima(_mix(rare), rare_begin, BANDS)[1]
                    yield bands(rows[some], again[some], ids, 1)
                exact = np.nonzero((np.diff(starts) < SHORT) | (share >= MANY_COMMON) & (anchors > 0))[0]
                if len(exact):
                    size = np.diff(starts)[exact]
                    chosen = letters[_indices(starts[exact], size)]
                    h, begin = substring_hashes(chosen, np.concatenate([[0], np.cumsum(size)]), SHINGLE)
                    row, token, n, left, times = _prefixes(h, begin, order, threshold)
                    entry, key, side = _parts(ids.to_numpy()[exact[row]], token, times * scale)
                    yield batch(key, ids, exact[row[entry]], side << 60 | (n << 32 | left)[entry])

    return run


def _overlaps(key: np.ndarray, ids: np.ndarray, at: np.ndarray, threshold: float):
    """Pairs of ids in whole buckets whose sizes and remaining shingles allow the threshold.

    A pair shares nothing before the first shingle it meets by, so what is left of both bounds what it shares.
    Within a bucket the partners of a row are searched by size, so rows that cannot reach any partner cost nothing.
    """
    by = np.argsort(key, kind="stable")  # fast, as keys come sorted
    key, ids, at = key[by], ids[by], at[by]
    twin = key[1:] == key[:-1]
    several = np.concatenate([twin, [False]]) | np.concatenate([[False], twin])
    key, ids, at = key[several], ids[several], at[several]
    if not len(key):
        return
    side, size, left = at >> 60, at >> 32 & 0xFFFFFFF, at & 0xFFFFFFFF
    need = threshold / (1 + threshold)
    by = np.lexsort((size, key))
    key, ids, side, size, left = key[by], ids[by], side[by], size[by], left[by]
    most = np.floor(left / need - size + 1e-6).astype(np.int64)  # size of the largest partner
    bucket = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
    shorter = np.nonzero(most >= size)[0]
    place = (bucket << 32) + size
    base = place - size
    lo = np.searchsorted(place[shorter], base + np.ceil(threshold * size - 1e-6).astype(np.int64))
    # partners up to its own size that stand before it
    hi = np.minimum(np.searchsorted(place[shorter], base + np.clip(most, 0, size), "right"), np.searchsorted(shorter, np.arange(len(key))))
    width = np.maximum(hi - lo, 0)
    ends = np.cumsum(width)
    done = 0
    while done < len(key) and ends[-1]:
        before = ends[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, before + 256 * CROWD**2, "right")))
        x = np.repeat(np.arange(done, stop), width[done:stop])
        y = shorter[_indices(lo[done:stop], width[done:stop])]
        good = (most[y] >= size[x]) & ((side[x] != side[y]) | (side[x] == 2))
        x, y = ids[x[good]], ids[y[good]]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
        done = stop


def _pairs_in_runs(threshold: float):
    """From rows sorted by key: the pairs of ids in one bucket, a run of equal keys. The last one is held until it ends."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            rows = [c.to_numpy() for c in batch.columns]
            last = rows[0][-1]
            if held and held[-1][0][-1] == last and rows[0][0] == last:
                held.append(rows)
                continue
            cut = int(np.nonzero(rows[0] != last)[0][-1]) + 1 if rows[0][0] != last else 0
            held.append([c[:cut] for c in rows])
            yield from _overlaps(*(np.concatenate(c) for c in zip(*held)), threshold)
            held = [[c[cut:] for c in rows]]
        if held:
            yield from _overlaps(*(np.concatenate(c) for c in zip(*held)), threshold)

    return run


def distinct_hashes(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 44-bit hashes, sorted and distinct within each row."""
    row = np.repeat(np.arange(len(begin) - 1, dtype=np.uint64), np.diff(begin))
    key = _runs((row << np.uint64(44)) | (hashes >> np.uint64(20)))[0] if len(hashes) else hashes
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64(2**44 - 1)


def bitmaps(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd sketches of n texts and how many samples each folds.

    The top bits of a hash name its bin, so in sorted order the first hash of a bin is its MinHash
    sample; each sample toggles one of the BITS bits of its text's bitmap.
    """
    slot = row * SAMPLES + (h >> np.uint64(38)).astype(np.int64)
    first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, bool)
    at, sample = row[first], h[first]
    bit = (_mix(sample * _P) >> np.uint64(11)) % np.uint64(BITS)
    one, word = np.uint64(1) << (bit & np.uint64(63)), bit >> np.uint64(6)
    maps, filled = np.zeros((n, BITS // 64), np.uint64), np.bincount(at, minlength=n)
    some = np.nonzero(filled)[0]
    start = np.searchsorted(at, some)
    for w in range(BITS // 64):
        maps[some, w] = np.bitwise_xor.reduceat(np.where(word == w, one, np.uint64(0)), start) if len(some) else 0
    return maps, filled


def _spread(row_start: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``pick``, index) of all entries of the picked rows."""
    size = row_start[pick + 1] - row_start[pick]
    which = np.repeat(np.arange(len(pick)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + row_start[pick][which]


def common_counts(row: np.ndarray, h: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in both and in either text of each pair (a[i], b[i])."""
    start = np.searchsorted(row, np.arange(n + 1))
    wa, xa = _spread(start, a)
    wb, xb = _spread(start, b)
    shift = np.uint64(44)
    both = np.sort(np.concatenate([(wa.astype(np.uint64) << shift) | h[xa], (wb.astype(np.uint64) << shift) | h[xb]]))
    twice = both[1:][both[1:] == both[:-1]] >> shift
    shared = np.bincount(twice.astype(np.int64), minlength=len(a))
    size = np.diff(start)
    return shared, size[a] + size[b] - shared


def sketch_similarity(x: np.ndarray, y: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Similarity estimated from the bits in which two odd sketches differ; ``filled`` bins were sampled."""
    ones = np.bitwise_count(x ^ y).sum(axis=1).astype(float)
    differing = -BITS / 2 * np.log(np.maximum(1 - 2 * ones / BITS, 1e-9))
    # d samples differ: each adds two toggles, and of the samples in either text J = (n - d) / (n + d)
    d = np.minimum(differing / 2, filled)
    return (filled - d) / np.maximum(filled, 1)


def _verify(threshold: float):
    """Odd-sketch estimates first, then exact similarity of what they leave."""

    def exact(x: str, y: str) -> float:
        p, q = ({t[i : i + SHINGLE] for i in range(len(t) - SHINGLE + 1)} for t in (x, y))
        return len(p & q) / len(p | q)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            one, two = b.column(2).dictionary_encode(), b.column(3).dictionary_encode()
            texts = pa.concat_arrays([one.dictionary, two.dictionary])
            ia, ib = one.indices.to_numpy().astype(np.int64), two.indices.to_numpy().astype(np.int64) + len(one.dictionary)
            row, h = distinct_hashes(*substring_hashes(*unpack(texts), SHINGLE))
            maps, filled = bitmaps(row, h, len(texts))
            close = np.nonzero(sketch_similarity(maps[ia], maps[ib], np.maximum(filled[ia], filled[ib])) >= threshold - SLACK)[0]
            shared, either = common_counts(row, h, len(texts), ia[close], ib[close])
            sim = shared / either
            # equal hashes of different substrings could decide only next to the threshold
            for k in np.nonzero(np.abs(shared - threshold * either) <= 3)[0]:
                sim[k] = exact(text_of(texts[ia[close[k]]].as_py()), text_of(texts[ib[close[k]]].as_py()))
            good = sim >= threshold
            at = pa.array(close[good])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(sim[good])], names=["a", "b", "s"])

    return run


class NearDuplicates:
    """Near-duplicate sequences of ``reads`` at a Jaccard similarity of SHINGLE-character substrings.

    Exact copies (in upper case) form a class that its smallest read_idx represents; all searching is
    among representatives. Each has BANDS band keys, one for each MinHash permutation of its anchors;
    those with a key in common are candidates. Candidates are compared by odd sketches (parity
    bitmaps of MinHash samples whose XOR population count estimates the similarity), and what the
    estimate does not exclude is verified exactly. At similarity 0.4 the sketch's estimate is coarse
    (it is precise for high similarities), so it only excludes pairs far below.

    Anchors common to COMMON of all sequences (adapters) are left out of the bands, since they would
    put unrelated reads into one bucket. A pair may then be alike by these alone, so sequences with a
    share of MANY_COMMON of them, and those shorter than SHORT, are joined exactly among themselves by
    prefixes of their shingles, rare ones first, whatever their lengths; those with a share of SOME_COMMON
    have twice the bands. All sequences of a bucket are compared, however many: a bucket of the bands holds at
    most COMMON of all sequences, one of the exact join is cut into parts.

    A null seq or one under SHINGLE characters is in no pair. Empty input gives empty results. Other
    columns are ignored; read_idx is taken to be unique.
    """

    def __init__(self, reads: DataFrame, threshold: float = 0.4):
        self.rows = spread(reads.select("read_idx", "seq")).select("read_idx", F.upper("seq").alias("seq")).where((F.length("seq") >= SHINGLE) & F.col("read_idx").isNotNull())
        self.threshold = threshold
        self.spark = reads.sparkSession
        self._members = None

    def members(self) -> DataFrame:
        """(id, read_idx, n) of the rows whose class has several rows, n of them; id is the representative."""
        if self._members is not None:
            return self._members
        keyed = self.rows.select("read_idx", F.xxhash64("seq").alias("h1"), F.xxhash64("seq", F.lit(1)).alias("h2"))
        several = keyed.groupBy("h1", "h2").agg(F.min("read_idx").alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1")
        self._members = Scratch(self.spark).put(keyed.join(several, ["h1", "h2"]).select("id", "read_idx", "n"))
        return self._members

    def class_pairs(self) -> DataFrame:
        """(a, b, s) of the representatives a < b whose similarity s reaches the threshold."""
        n = self.rows.count()
        seq = self.rows.mapInArrow(_packed, "read_idx long, packed binary")
        common, order = frequent_substrings(seq.select("packed"), n)
        reps = seq.groupBy("packed").agg(F.min("read_idx").alias("id")).select("id", "packed")
        bands = reps.mapInArrow(_band_rows(common, order, 1, self.threshold), "key long, id long, at long")
        pairs = bands.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs_in_runs(self.threshold), "a long, b long")
        pairs = pairs.repartition("a").dropDuplicates(["a", "b"])
        full = pairs.join(seq.select(F.col("read_idx").alias("a"), F.col("packed").alias("sa")), "a")
        full = full.join(seq.select(F.col("read_idx").alias("b"), F.col("packed").alias("sb")), "b")
        return full.select("a", "b", "sa", "sb").mapInArrow(_verify(self.threshold), "a long, b long, s double")

    def row_pairs(self) -> DataFrame:
        """(read_a, read_b) of all rows, copies included."""
        found, copies = self.class_pairs().select("a", "b"), self.members().select("id", "read_idx")
        one = found.join(copies.select(F.col("id").alias("a"), F.col("read_idx").alias("x")), "a", "left")
        two = one.join(copies.select(F.col("id").alias("b"), F.col("read_idx").alias("y")), "b", "left")
        x, y = F.coalesce("x", "a"), F.coalesce("y", "b")
        across = two.select(F.least(x, y).alias("read_a"), F.greatest(x, y).alias("read_b"))
        return across.unionByName(self.copy_pairs())

    def copy_pairs(self) -> DataFrame:
        """(read_a, read_b) of exact copies, a class in parts of about COPIES rows, of which each two meet in a task of their own."""
        parts = F.ceil(F.col("n") / COPIES).cast("int")
        mine = self.members().withColumn("own", F.pmod(F.xxhash64("read_idx"), parts).cast("int")).withColumn("parts", parts)
        one = mine.select("id", F.col("read_idx").alias("x"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("parts") - 1)).alias("j"))
        two = mine.select("id", F.col("read_idx").alias("y"), F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))
        met = one.join(two, ["id", "i", "j"]).where("i < j or x < y")
        return met.select(F.least("x", "y").alias("read_a"), F.greatest("x", "y").alias("read_b"))

    def groups(self) -> DataFrame:
        """One row a read: read_idx, class_id (its representative), n_links (classes linked with it), group_id.

        group_id is the smallest read_idx of all reads linked directly or over others.
        """
        scratch = Scratch(self.spark)
        found = scratch.put(self.class_pairs())
        links = (
            found.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
        )
        comp = connected_components(found.select("a", "b"), scratch).select(F.col("id").alias("class_id"), F.col("component").alias("group_id"))
        of = self.members().select("read_idx", F.col("id").alias("class_id"))
        rows = self.rows.select("read_idx").join(of, "read_idx", "left").select("read_idx", F.coalesce("class_id", "read_idx").alias("class_id"))
        return (
            rows.join(links, "class_id", "left")
            .join(comp, "class_id", "left")
            .select("read_idx", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
        )
