"""Areas that polygons of two layers share: NumPy over one batch of cells, in steps of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of pieces, and pairs of segments, that are looked at in one step.
CANDIDATES, STEP = 400_000, 100_000


def _expand(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, item): for every owner its ``counts`` items from ``starts`` on."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Columns as numbers, equal where their values are."""
    both = pa.chunked_array([c for col in columns for c in col.chunks], type=columns[0].type).combine_chunks()
    found = both.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(found, np.cumsum([len(c) for c in columns])[:-1])


def _steps(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of some ``most`` in all, one item at least."""
    step = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1), len(sizes)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)


@dataclass
class Pieces:
    """Boxes of pieces and their segments, those of a piece side by side."""

    x0: np.ndarray
    x1: np.ndarray
    y0: np.ndarray
    y1: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    x: np.ndarray
    y: np.ndarray
    dx: np.ndarray
    dy: np.ndarray
    s: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, t: pa.Table) -> Pieces:
        segs = pa.concat_arrays(t["segs"].chunks) if t["segs"].num_chunks else pa.array([], t["segs"].type)
        counts = pc.list_value_length(segs).to_numpy(zero_copy_only=False).astype(np.int64)
        x0, y0, x1, y1, s = (c.to_numpy(zero_copy_only=False).astype(float) for c in segs.flatten().flatten())
        box = [t[c].to_numpy() for c in ("x0", "x1", "y0", "y1")]
        return cls(*box, counts, np.cumsum(counts) - counts, x0, y0, x1 - x0, y1 - y0, s, np.minimum(x0, x1), np.minimum(y0, y1), np.maximum(y0, y1))

    def at(self, e: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the segments e are at the heights p and q."""
        x, y, dx, dy = self.x[e], self.y[e], self.dx[e], self.dy[e]
        return x + dx * (p - y) / dy, x + dx * (q - y) / dy


def _positive(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Mean over a unit step of the positive part of lines from u to v."""
    low, high = np.minimum(u, v), np.maximum(u, v)
    out = np.where(low >= 0, (u + v) / 2, 0.0)
    mixed = np.flatnonzero((low < 0) & (high > 0))
    out[mixed] = high[mixed] ** 2 / (2 * (high[mixed] - low[mixed]))
    return out


def _shared(one: Pieces, two: Pieces, i: np.ndarray, j: np.ndarray, box: list[np.ndarray], closed: bool) -> np.ndarray:
    """Area that the pieces i of one and j of two share in their common box: over pairs of segments, the area right of both, with their signs. Closed
    pieces of two are whole polygons: those that lie left of the box over its heights share nothing."""
    bx0, bx1, by0, by1 = box
    own, f = _expand(two.counts[j], two.starts[j])
    near = np.flatnonzero((two.low[f] < by1[own]) & (two.high[f] > by0[own]))
    own, f = own[near], f[near]
    near = two.left[f] < bx1[own]
    if closed and len(own):
        reach, heads = np.maximum(*two.at(f, np.maximum(by0[own], two.low[f]), np.minimum(by1[own], two.high[f]))), np.flatnonzero(np.diff(own, prepend=-1))
        meets = np.zeros(len(i), bool)
        meets[own[heads]] = np.maximum.reduceat(reach, heads) > bx0[own[heads]]
        near &= meets[own]
    own, f = own[near], f[near]
    which, e = _expand(one.counts[i[own]], one.starts[i[own]])
    own, f = own[which], f[which]
    p, q = np.maximum(np.maximum(by0[own], one.low[e]), two.low[f]), np.minimum(np.minimum(by1[own], one.high[e]), two.high[f])
    right = bx1[own]
    near = np.flatnonzero((p < q) & (one.left[e] < right))
    own, e, f, p, q, right, base = own[near], e[near], f[near], p[near], q[near], right[near], bx0[own[near]]
    (e0, e1), (f0, f1) = one.at(e, p, q), two.at(f, p, q)
    start, end, d0, d1 = np.maximum(e0, f0), np.maximum(e1, f1), e0 - f0, e1 - f1

    def clipped(u: np.ndarray, v: np.ndarray, right: np.ndarray, base: np.ndarray) -> np.ndarray:
        out, k = _positive(right - u, right - v), np.flatnonzero(np.minimum(u, v) < base)
        out[k] -= _positive(base[k] - u[k], base[k] - v[k])
        return out

    x = clipped(start, end, right, base)
    k = np.flatnonzero(d0 * d1 < 0)  # they cross
    t = d0[k] / (d0[k] - d1[k])
    middle = e0[k] + (e1[k] - e0[k]) * t
    x[k] = t * clipped(start[k], middle, right[k], base[k]) + (1 - t) * clipped(middle, end[k], right[k], base[k])
    return np.bincount(own, one.s[e] * two.s[f] * (q - p) * x, minlength=len(i))


def overlaps(left: pa.Table, right: pa.Table, keys: list[str], within: list[str], a: str, b: str, rounding: float, least: float, home: bool, closed: bool) -> pa.Table:
    """Pairs of pieces with equal ``keys`` whose boxes overlap, added up by (a, b). At home, where all pieces of every a are in this batch, pairs of up to
    ``least`` go and ``share`` is that of the pairs of a; else ``share`` is the width of the box, for the sums and shares that follow."""
    one, two = Pieces.of(left), Pieces.of(right)
    lk, rk = np.zeros(left.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
    for c in keys:
        u, v = _codes(left[c], right[c])
        both = np.concatenate([lk, rk]) * (max(u.max(initial=0), v.max(initial=0)) + 1) + np.concatenate([u, v])
        lk, rk = np.split(np.unique(both, return_inverse=True)[1], [left.num_rows])
    (la,), (rb,) = _codes(left[a]), _codes(right[b])
    low, widest = min(one.x0.min(initial=np.inf), two.x0.min(initial=np.inf)), (two.x1 - two.x0).max(initial=0)
    room = 4 * max(1e-300, one.x1.max(initial=-np.inf) - low, two.x1.max(initial=-np.inf) - low) if len(lk) and len(rk) else 1.0
    by, order = rk + (two.x0 - low) / room, np.argsort(la, kind="stable")  # pieces of a key by their left ends: those behind a piece's right end, or too far left to reach it, are no candidates
    across = np.argsort(by)
    first = np.searchsorted(by[across], lk[order] + (one.x0[order] - low - widest) / room - 1e-6)
    met = np.searchsorted(by[across], lk[order] + (one.x1[order] - low) / room + 1e-6) - first
    ids, heads = np.unique(la[order], return_index=True)
    out = []
    for part in _steps(np.add.reduceat(met, heads) if len(heads) else met, CANDIDATES):  # all pieces of an a in one step
        rows = slice(heads[part.start], heads[part.stop] if part.stop < len(heads) else len(order))
        owner, at = _expand(met[rows], first[rows])
        i, j = order[rows][owner], across[at]
        box = [np.maximum(one.x0[i], two.x0[j]), np.minimum(one.x1[i], two.x1[j]), np.maximum(one.y0[i], two.y0[j]), np.minimum(one.y1[i], two.y1[j])]
        near = np.flatnonzero((box[0] < box[1]) & (box[2] < box[3]))
        i, j, box = i[near], j[near], [c[near] for c in box]
        if not len(i):
            continue
        area = np.concatenate([_shared(one, two, i[k], j[k], [c[k] for c in box], closed) for k in _steps(one.counts[i] * two.counts[j], STEP)])
        width = np.maximum(box[1] - box[0], box[3] - box[2])
        pair, head, inverse = np.unique(la[i] * (rb.max() + 1) + rb[j], return_index=True, return_inverse=True)
        if len(pair) < len(i):
            most = np.zeros(len(pair))
            np.maximum.at(most, inverse, width)
            area, width = np.bincount(inverse, area), most
        else:
            area, width = area[head], width[head]
        i, j = i[head], j[head]
        share = width
        if home:
            kept = np.flatnonzero(area > np.maximum(width * rounding, least))
            i, j, area = i[kept], j[kept], area[kept]
            share = area / np.bincount(la[i], area, minlength=len(ids))[la[i]]
        out.append((i, j, area, share))
    i, j, area, share = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, float, float)))
    return pa.table({**{c: left[c].take(pa.array(i)) for c in [*within, a]}, b: right[b].take(pa.array(j)), "area": area, "share": share})
