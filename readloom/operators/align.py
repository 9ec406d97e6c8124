"""Alignment of weighted profiles, many groups at once. Plain numpy, no Spark.

Every group of a batch folds its reads one after the other into its reference. The folds of
different groups do not depend on each other, so step k aligns the k-th read of all groups in
lockstep: each cell of the band is one vector operation over the groups.
"""

from __future__ import annotations

import numpy as np

from readloom.functions.dna import LOG_RIGHT, LOG_WRONG, WEIGHTS

FAR = np.float32(-1e30)
_WEIGHT = np.zeros(256, np.int64)
_WEIGHT[33:74] = WEIGHTS
_WEIGHT[74:] = 42
_CLASS = np.full(256, -1, np.int64)
_CLASS[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def profile(seq: str, qual: str | None, length: int) -> np.ndarray:
    """Evidence [length, 5] of one read; only upper-case bases count, and a missing quality weighs 0."""
    out = np.zeros((length, 5), np.int64)
    s = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)[:length]
    q = np.zeros(len(s), np.uint8)
    given = np.frombuffer((qual or "").encode("latin-1", "replace"), np.uint8)[: len(s)]
    q[: len(given)] = given
    at = np.nonzero(_CLASS[s] >= 0)[0]
    out[at, _CLASS[s[at]]] = _WEIGHT[q[at]]
    return out


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scaled cosine 2c - 1 over the last axis; 0 where either side has no evidence."""
    dot = (x * y).sum(-1)
    size = np.sqrt((x * x).sum(-1)) * np.sqrt((y * y).sum(-1))
    return np.where(size > 0, 2.0 * (dot / np.where(size > 0, size, 1)) - 1.0, 0.0)


def _band_scores(refs: np.ndarray, queries: np.ndarray, m: np.ndarray, n: np.ndarray, w: int, gap: np.float32):
    """Scores of the end cells, and moves by anti-diagonal d = x + y and y; cells with |x - y| > w are outside.

    References are profiles. Queries are single reads, which have one class at each position, or, all of
    them, profiles too; their share of gaps then lowers the cost of a gap as a reference's does. All
    cells of an anti-diagonal, of all groups, are one vector operation. A cell needs only smaller x
    and y, so groups of different lengths share the arrays.
    """
    groups, cols, rows = len(refs), refs.shape[1], queries.shape[1]
    r_size = np.sqrt((refs.astype(np.float64) ** 2).sum(-1))
    weight = queries.max(-1).astype(np.float64)
    kind = queries.argmax(-1)
    single = not (np.count_nonzero(queries, axis=-1) > 1).any()
    if not single:
        weight = np.sqrt((queries.astype(np.float64) ** 2).sum(-1))
    total = refs.sum(-1)
    share = refs[:, :, 4].astype(np.float32) / np.maximum(total, 1).astype(np.float32)
    left_cost = np.where(refs[:, :, 4] > 0, gap * (np.float32(1) - share), gap).astype(np.float32)
    up_share = queries[:, :, 4].astype(np.float32) / np.maximum(queries.sum(-1), 1).astype(np.float32)
    up_cost = np.where(queries[:, :, 4] > 0, gap * (np.float32(1) - up_share), gap).astype(np.float32)
    each = np.arange(groups)[:, None]
    moves = np.zeros((cols + rows + 1, groups, min(rows, w) + 2), np.int8)
    end = np.full(groups, FAR, np.float32)
    two = np.full((groups, rows + 2), FAR, np.float32)  # by y + 1, so that y - 1 is never outside
    one = two.copy()
    for d in range(cols + rows + 1):
        low, high = max(0, d - cols, (d - w + 1) // 2), min(rows, d, (d + w) // 2)
        now = np.full((groups, rows + 2), FAR, np.float32)
        if low <= high:
            ys = np.arange(low, high + 1)
            xs = d - ys
            best = np.full((groups, len(ys)), FAR, np.float32)
            move = np.zeros((groups, len(ys)), np.int8)
            i, j = (1 if low == 0 else 0), (len(ys) - 1 if high == d else len(ys))  # x > 0 and y > 0
            if i < j:
                cx, cy = xs[i:j] - 1, ys[i:j] - 1
                wt = weight[:, cy]
                size = r_size[:, cx] * wt
                dot = refs[each, cx[None, :], kind[:, cy]] * wt if single else (refs[:, cx] * queries[:, cy]).sum(-1)
                match = np.where(size > 0, 2.0 * (dot / np.where(size > 0, size, 1.0)) - 1.0, 0.0).astype(np.float32)
                best[:, i:j] = two[:, low + i : low + j] + match
                move[:, i:j] = 1
            if j > 0:  # x > 0: from the left
                cand = one[:, low + 1 : low + 1 + j] + left_cost[:, xs[:j] - 1]
                if low == 0:
                    cand[:, 0] = one[:, 1] + gap if d else FAR
                take = cand > best[:, :j]
                best[:, :j][take], move[:, :j][take] = cand[take], 2
            if i < len(ys):  # y > 0: from above
                cand = one[:, low + i : high + 1] + up_cost[:, ys[i:] - 1]
                if high == d:  # before the reference begins
                    cand[:, -1] = one[:, high] + gap
                take = cand > best[:, i:]
                best[:, i:][take], move[:, i:][take] = cand[take], 3
            if d == 0:
                best[:, 0] = 0
            now[:, low + 1 : high + 2] = best
            moves[d, :, : len(ys)] = move
        two, one = one, now
        done = np.nonzero((m + n == d) & (np.abs(m - n) <= w))[0]
        end[done] = now[done, n[done] + 1]
    return end, moves


def _trace(moves: np.ndarray, m: int, n: int, w: int, cols: int, g: int) -> np.ndarray:
    x, y, out = m, n, []
    mine = moves[:, g, :]
    while x > 0 or y > 0:
        if x - y > w:
            out.append(2)
            x -= 1
            continue
        if y - x > w:
            out.append(3)
            y -= 1
            continue
        d = x + y
        t = int(mine[d, y - max(0, d - cols, (d - w + 1) // 2)])
        if t == 0:
            break
        out.append(t)
        if t != 3:
            x -= 1
        if t != 2:
            y -= 1
    return np.array(out[::-1], np.int8)


def align(refs: list[np.ndarray], queries: list[np.ndarray], gap: float) -> list[np.ndarray]:
    """Moves (1 both, 2 gap in the query, 3 gap in the reference) of each pair.

    Pairs up to 50 long are aligned in full. Longer ones start in a band of half-width
    floor(sqrt(longer/25)) that doubles until the score reaches what no path outside it could
    have, and are aligned in full if the band would cover half the length.
    """
    out: list[np.ndarray | None] = [None] * len(refs)
    g = np.float32(gap)
    todo: dict[tuple[int, bool], list[int]] = {}
    for i, (r, q) in enumerate(zip(refs, queries)):
        longer, shorter = max(len(r), len(q)), min(len(r), len(q))
        full = longer <= 50
        w = longer if full else max(1, int(np.sqrt(longer * 0.04)))
        if not full:
            # a position scores 1 at most, and one without evidence 0: bands that could not prove enough are passed over
            most = int((q.any(axis=1)).sum())
            while w <= longer // 2 and most < (2.0 * (w + 1.0) - (longer - shorter)) * gap + (shorter - (w + 1.0)):
                w = 2 * w if 2 * w <= longer // 2 else longer // 2 + 1
        todo.setdefault((w, full), []).append(i)
    while todo:
        (w, full), items = todo.popitem()
        w_used = max(w, 1)
        across = max(len(queries[i]) for i in items)
        size = 60_000_000 // max(1, (min(w_used, across) + 2) * (across + max(len(refs[i]) for i in items))) + 1
        for lo in range(0, len(items), size):
            part = items[lo : lo + size]
            m = np.array([len(refs[i]) for i in part])
            n = np.array([len(queries[i]) for i in part])
            r = np.zeros((len(part), max(1, m.max()), 5), np.int64)
            q = np.zeros((len(part), max(1, n.max()), 5), np.int64)
            for j, i in enumerate(part):
                r[j, : m[j]], q[j, : n[j]] = refs[i], queries[i]
            end, moves = _band_scores(r, q, m, n, w_used, g)
            for j, i in enumerate(part):
                long_, short = max(m[j], n[j]), min(m[j], n[j])
                bound = (2.0 * (w + 1.0) - (long_ - short)) * gap + (short - (w + 1.0))
                if full or (end[j] > FAR / 2 and float(end[j]) >= bound):
                    out[i] = _trace(moves, int(m[j]), int(n[j]), w_used, r.shape[1], j)
                elif w > long_ // 2:
                    todo.setdefault((int(long_), True), []).append(i)
                else:
                    wider = 2 * w if 2 * w <= long_ // 2 else int(long_ // 2) + 1
                    todo.setdefault((wider, False), []).append(i)
    return out


def merge(ref: np.ndarray, query: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The reference with the query's evidence added along the moves.

    A gap on one side adds to the gap class what the other side's next position weighs.
    """
    on_ref, on_query = moves != 3, moves != 2
    at_r, at_q = np.cumsum(on_ref) - on_ref, np.cumsum(on_query) - on_query
    pad_r, pad_q = np.vstack([ref, np.zeros((1, 5), ref.dtype)]), np.vstack([query, np.zeros((1, 5), query.dtype)])
    r, q = pad_r[np.minimum(at_r, len(ref))], pad_q[np.minimum(at_q, len(query))]
    out = np.where((on_ref & on_query)[:, None], r + q, np.where(on_ref[:, None], r, q))
    out[:, 4] += np.where(on_ref & on_query, 0, np.where(on_ref, q.sum(1), r.sum(1)))
    return out


def call(pile: np.ndarray) -> tuple[str, str, float, float, int, int, int]:
    """(seq, qual, largest and mean minor share, calls, missense, indels) of a profile."""
    total = pile.sum(1)
    if not len(pile) or not total.any():
        return "", "", 0.0, 0.0, 0, 0, 0
    last = np.nonzero(total > 0.5 * total.sum() / len(pile))[0]
    p = pile[: last[-1] + 1]
    bases, gap = p[:, :4], p[:, 4]
    top = bases.max(1)
    p, bases, gap, top = (x[gap <= top] for x in (p, bases, gap, top))
    non_gap, total = bases.sum(1), p.sum(1)
    which = bases.argmax(1)
    rest = bases.copy()
    rest[np.arange(len(p)), which] = 0
    has = non_gap > 0
    minor = rest.max(1)[has] / non_gap[has] if has.any() else np.empty(0)
    clear = has & ((bases == top[:, None]).sum(1) == 1)
    logs = p * LOG_RIGHT + (total[:, None] - p) * LOG_WRONG
    high = logs.max(1, keepdims=True)
    power = 10.0 ** (logs - high)
    mask = np.ones_like(power, bool)
    mask[np.arange(len(p)), which] = False
    others = np.where(mask, logs, -np.inf)
    high_o = others.max(1, keepdims=True)
    exact = 10 * (high[:, 0] + np.log10(power.sum(1))) - 10 * (high_o[:, 0] + np.log10((10.0 ** (others - high_o)).sum(1)))
    q = np.where(clear, np.clip(np.floor(exact + 0.5), 0, 40), 0).astype(int)
    letters = np.where(clear & (q >= 4), np.frombuffer(b"ACGT", np.uint8)[which], ord("N")).astype(np.uint8)
    return (
        letters.tobytes().decode(),
        (q + 33).astype(np.uint8).tobytes().decode(),
        float(minor.max()) if len(minor) else 0.0,
        float(minor.mean()) if len(minor) else 0.0,
        int(non_gap[clear].sum()),
        int((non_gap - top)[clear].sum()),
        int(gap[clear].sum()),
    )


def fold(groups: list[list[tuple[str, str | None]]], gap: float) -> list[np.ndarray]:
    """The merged profile of each group of (seq, qual) reads, given in input order.

    The reads of a group are padded to its longest one and taken by falling similarity to their plain sum, ties in
    input order; the first is the reference and the others are merged into it one by one.
    """
    ordered = []
    for reads in groups:
        length = max(len(s) for s, _ in reads)
        piles = np.stack([profile(s, q, length) for s, q in reads])
        like = similarity(piles, piles.sum(0)).sum(1)
        ordered.append(piles[np.argsort(-like, kind="stable")])
    return fold_profiles(ordered, gap)


def fold_profiles(ordered: list, gap: float) -> list[np.ndarray]:
    """The profiles of each group merged one by one into the first."""
    state = [p[0] for p in ordered]
    for k in range(1, max((len(p) for p in ordered), default=0)):
        live = [i for i, p in enumerate(ordered) if len(p) > k]
        moves = align([state[i] for i in live], [ordered[i][k] for i in live], gap)
        for i, mv in zip(live, moves):
            state[i] = merge(state[i], ordered[i][k], mv)
    return state
