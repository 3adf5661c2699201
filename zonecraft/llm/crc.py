"""CRC-32 of many byte strings at once.

Strings of equal length are the rows of a two-dimensional array of bytes; the checksums of all of
them are updated column by column and scattered back to where the strings came from."""

from __future__ import annotations

import zlib

import numpy as np

POLYNOMIAL, LONG, ROWS = 0xEDB88320, 256, 1 << 16


def _table() -> np.ndarray:
    """The checksum step of every byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


TABLE = _table()
FULL = np.uint32(0xFFFFFFFF)


def of_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The CRC-32 of every span of `buf`, or of the bytes whose CRC-32 is `before` and the span behind them.

    A bucket of one length is worked at most ROWS strings at a time.  Strings of more than LONG bytes,
    whose buckets hold one or two, go one by one through zlib."""
    out = np.zeros(len(start), np.uint32) if before is None else before.astype(np.uint32)
    size = np.minimum(end - start, LONG + 1)
    order = np.argsort(size, kind="stable")
    edges = np.searchsorted(size[order], np.arange(1, LONG + 2))
    for length in range(1, LONG + 1):
        for lo in range(edges[length - 1], edges[length], ROWS):
            rows = order[lo:min(lo + ROWS, edges[length])]
            columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, length)[start[rows]].T)
            state = out[rows] ^ FULL
            for column in columns:
                state = TABLE[(state.astype(np.uint8)) ^ column] ^ (state >> np.uint32(8))
            out[rows] = state ^ FULL
    for i in order[edges[-1]:].tolist():
        out[i] = zlib.crc32(buf[start[i]:end[i]], int(out[i]))
    return out
