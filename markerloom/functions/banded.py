"""Alignment with affine gaps in a band around a diagonal, for many pairs at once.

The whole query is aligned, ends of the target are free. Rows of the matrix are worked off one after another for all pairs;
in a row, gaps in the query come from a running maximum, as a gap that follows another one of the same kind never pays."""

from __future__ import annotations

import numpy as np

MATCH, MISMATCH, OPEN, EXTEND = 2, -8, -12, -2
#: Cells of the matrices of pairs that are aligned together.
CELLS = 6_000_000
_NONE = np.int32(-(1 << 29))


def align_batch(queries: list[bytes], targets: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Score, first place in the target, and CIGAR of each pair. A target has ``width - 1`` bases more than its query: the
    query's base ``i`` meets the target's places ``i`` to ``i + width - 1`` (before gaps move it). Of equally good places that nearest
    to the middle is given."""
    n = len(queries)
    score, begin, cigars = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
    order = sorted(range(n), key=lambda i: len(queries[i]))
    at = 0
    while at < n:
        upto = at + 1
        while upto < n and (upto + 1 - at) * width * max(1, len(queries[order[upto]])) <= CELLS:
            upto += 1
        part = order[at:upto]
        for i, s, b, c in zip(part, *_together([queries[i] for i in part], [targets[i] for i in part], width)):
            score[i], begin[i], cigars[i] = s, b, c
        at = upto
    return score, begin, cigars


def score_batch(queries: list[bytes], targets: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, first place in the target and bases of the target of each pair, whose targets are those of :func:`align_batch`. Of equally
    good places that which begins nearest to the middle is given. A cell holds its score and, in its last digits, where it began, so
    the way back isn't kept. Queries hold no other letters than those that may match."""
    n = len(queries)
    score, begin, span = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = sorted(range(n), key=lambda i: len(queries[i]))
    at = 0
    while at < n:
        part = order[at : at + max(1, CELLS // 16 // width)]
        at += len(part)
        sizes = np.array([len(queries[i]) for i in part])
        most = int(sizes[-1])
        q = np.ascontiguousarray(np.frombuffer(b"".join(queries[i].ljust(most, b"\0") for i in part), np.uint8).reshape(len(part), most).T)
        t = np.ascontiguousarray(np.frombuffer(b"".join(targets[i].ljust(most + width - 1, b"\1") for i in part), np.uint8).reshape(len(part), -1).T)
        unit = 1 << int(width).bit_length()
        kind, none = (np.int32, -(1 << 29)) if 16 * unit * (most + width) < 1 << 29 else (np.int64, -(1 << 50))
        band = np.arange(width, dtype=kind)[:, None]
        first = np.argsort(-np.abs(2 * band[:, 0] - (width - 1)), kind="stable")  # the last digits, and the place that each stands for
        digit = np.empty(width, kind)
        digit[first] = np.arange(width)
        h = np.repeat(digit[:, None], len(part), axis=1)
        e = np.full(h.shape, none, kind)
        slope = band * (EXTEND * unit)
        last = np.zeros(h.shape, kind)
        for i in range(most):
            # An insertion leads to the diagonal to the left, a deletion to one to the right, by a running maximum.
            best = h + ((t[i : i + width] == q[i]) * kind((MATCH - MISMATCH) * unit) + kind(MISMATCH * unit))
            if width > 1:
                e[:-1] = np.maximum(h[1:] + (OPEN + EXTEND) * unit, e[1:] + EXTEND * unit)
                e[-1] = none
                np.maximum(best, e, out=best)
                top = np.maximum.accumulate(best - slope, axis=0)
                np.maximum(best[1:], top[:-1] + slope[1:] + OPEN * unit, out=best[1:])
            h = best
            if i + 1 >= sizes[0]:
                ends = sizes == i + 1
                last[:, ends] = h[:, ends]
        j = last.argmax(axis=0)
        found = last[j, np.arange(len(part))]
        score[part], begin[part] = found // unit, first[found % unit]
        span[part] = sizes + j - first[found % unit]
    return score, begin, span


def _together(queries: list[bytes], targets: list[bytes], width: int) -> tuple[list[int], list[int], list[str]]:
    n, sizes = len(queries), np.array([len(q) for q in queries])
    most = int(sizes.max())
    q = np.frombuffer(b"".join(x.ljust(most, b"\0") for x in queries), np.uint8).reshape(n, most)
    t = np.frombuffer(b"".join(x[: most + width - 1].ljust(most + width - 1, b"\1") for x in targets), np.uint8).reshape(n, -1)
    band = np.arange(width, dtype=np.int32)
    h, e = np.zeros((n, width), np.int32), np.full((n, width), _NONE)
    gap = np.zeros((n, width), np.int32)  # length of the insertion that e ends with
    how = np.zeros((most, n, width), np.int8)
    inserted, deleted = np.zeros((most, n, width), np.int32), np.zeros((most, n, width), np.int16)
    last = np.zeros((n, width), np.int32)
    known = np.isin(q, np.frombuffer(b"ACGT", np.uint8))
    for i in range(most):
        same = (t[:, i : i + width] == q[:, i, None]) & known[:, i, None]
        diagonal = h + np.where(same, np.int32(MATCH), np.int32(MISMATCH))
        # An insertion takes a base of the query and none of the target.
        opened, longer = np.full_like(h, _NONE), np.full_like(e, _NONE)
        opened[:, :-1], longer[:, :-1] = h[:, 1:] + (OPEN + EXTEND), e[:, 1:] + EXTEND
        e = np.maximum(opened, longer)
        kept = np.zeros_like(gap)
        kept[:, :-1] = gap[:, 1:]
        gap = np.where(opened >= longer, 1, kept + 1).astype(np.int32)
        best = np.maximum(diagonal, e)
        # A deletion takes bases of the target: from the best cell to the left, by a running maximum.
        level = best - EXTEND * band
        top = np.maximum.accumulate(level, axis=1)
        source = np.maximum.accumulate(np.where(level == top, band, 0), axis=1)
        f, run = np.full_like(h, _NONE), np.zeros_like(source)
        f[:, 1:] = top[:, :-1] + OPEN + EXTEND * band[1:]
        run[:, 1:] = band[1:] - source[:, :-1]
        h = np.maximum(best, f)
        how[i] = np.where(h == diagonal, 0, np.where(h == e, 1, 2))
        inserted[i], deleted[i] = gap, run
        ends = sizes == i + 1
        last[ends] = h[ends]
    # Of equally good places the one nearest to the middle of the band.
    middle = np.argsort(np.abs(2 * band - (width - 1)), kind="stable")
    j = middle[last[:, middle].argmax(axis=1)]
    total = last[np.arange(n), j]
    i, rows = sizes - 1, np.arange(n)
    runs: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    matched = np.zeros(n, np.int64)

    def flush(r: int, length: int, kind: str) -> None:
        if matched[r]:
            runs[r].append((int(matched[r]), "M"))
            matched[r] = 0
        runs[r].append((length, kind))

    while (going := rows[i >= 0]).size:
        step = how[i[going], going, j[going]]
        plain = going[step == 0]
        matched[plain] += 1
        i[plain] -= 1
        for r in going[step == 1].tolist():
            length = int(inserted[i[r], r, j[r]])
            flush(r, length, "I")
            i[r] -= length
            j[r] += length
        for r in going[step == 2].tolist():
            length = int(deleted[i[r], r, j[r]])
            flush(r, length, "D")
            j[r] -= length
    cigars = ["".join(f"{length}{kind}" for length, kind in reversed([*own, *([(int(m), "M")] if m else [])])) for own, m in zip(runs, matched.tolist())]
    return total.tolist(), j.tolist(), cigars
