"""Vectorised text measures over Arrow batches, for the Python side of the operators.

A batch is worked in blocks of a few MB of whole texts, so memory follows the block size (or the
longest single text), not the batch.  Spans are hashed with a polynomial over their bytes
modulo 2^64, read off running sums, so a block costs a few passes whatever the span lengths."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


def worker_state() -> types.SimpleNamespace:
    """What a Python worker keeps from task to task: the functions themselves travel with every
    task, so their own module globals are new each time."""
    if not hasattr(sys, "_zonecraft_worker"):
        sys._zonecraft_worker = types.SimpleNamespace()
    return sys._zonecraft_worker


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i <= n."""
    state = worker_state()
    if getattr(state, "powers", None) is None or len(state.powers[0]) <= n:
        size = max(n + 1, BLOCK + (BLOCK >> 2))
        both = []
        for step in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, step, dtype=U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        state.powers = tuple(both)
    return state.powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def blocks(column, limit: int = BLOCK):
    """(first row, end row, bytes, row offsets) of runs of whole texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


SPACE = table(b" \t\n\x0b\x0c\r")
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def spans(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the longest runs of bytes outside `gap`; rows end runs."""
    return runs(~gap[buf], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the longest runs of bytes marked in `inside`; rows end runs."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    cut = np.zeros(len(inside) + 1, dtype=bool)
    cut[offsets] = True
    before = cut[:-1].copy()
    before[1:] |= ~inside[:-1]
    after = cut[1:].copy()
    after[:-1] |= ~inside[1:]
    start = np.flatnonzero(inside & before)
    return start, np.flatnonzero(inside & after) + 1, np.searchsorted(offsets, start, side="right") - 1


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the \\n-separated lines of every row, empty ones included."""
    breaks = np.flatnonzero(buf == 10)
    row = np.searchsorted(offsets, breaks, side="right") - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    rows = np.concatenate([np.arange(len(offsets) - 1), row])
    order = np.lexsort((start, rows))
    start, rows = start[order], rows[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    last = np.append(rows[1:] != rows[:-1], True)
    end[last] = offsets[rows[last] + 1]
    return start, end, rows


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    power, inverse = _powers(len(buf))
    total = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum((buf.astype(U) + U(1)) * power[:len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U))


def grams(h: np.ndarray, row: np.ndarray, k: int, shorter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the k-grams of consecutive word hashes; with `shorter`, a row of fewer
    words (at least one) gives one gram of all of them.  Ordered by row and position."""
    n = len(h)
    if not n:
        return h, row
    power, inverse = _powers(n + k)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(h * power[:n], out=total[1:])
    start = np.flatnonzero(row[:n - k + 1] == row[k - 1:]) if n >= k else np.zeros(0, np.int64)
    end = start + k
    if shorter:
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        last = np.append(first[1:], n)
        few = last - first < k
        start, end = np.concatenate([start, first[few]]), np.concatenate([end, last[few]])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U)), row[start]


def distinct(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row; rows ascend."""
    if not len(g):
        return g, row
    g = g.copy()
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(g)]):
        if hi - lo > 1:
            g[lo:hi].sort()
    keep = np.append(True, (g[1:] != g[:-1]) | (row[1:] != row[:-1]))
    return g[keep], row[keep]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
