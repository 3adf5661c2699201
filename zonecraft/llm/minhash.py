"""Word shingles, min-max signatures and their bands, computed in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecraft.llm import arrow_text as T

U = np.uint64


def permutations(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of x -> a x + b modulo 2^64, a odd: a permutation of 64-bit values."""
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 1 << 63, size=(2, count), dtype=np.uint64)
    return (a << U(1)) | U(1), b


def band_chance(threshold: float, rows: int, both: bool) -> float:
    """The least probability with which two sets at the threshold, whatever their size, agree in a band.

    With `both`, a permutation's minimum and maximum are drawn without putting back, so of a union of
    u shingles with i in common both agree with i (i - 1) / (u (u - 1)): less than the square on small sets."""
    single = threshold
    pair = min([threshold ** 2, *(i * (i - 1) / (u * (u - 1)) for u in range(2, 1000) if (i := math.ceil(threshold * u - 1e-9)) < u)])
    # a band of an odd number of rows has one value whose partner is in the next band
    return pair ** (rows // 2) * single ** (rows % 2) if both else single ** rows


def choose_bands(threshold: float, values: int, recall: float, both: bool = False) -> tuple[int, int]:
    """(rows, bands) with the most rows a band may have so that a pair at the threshold still
    shares a band with the wanted probability; `both` as for `bands_of`."""
    fit = [(r, values // r) for r in range(1, values + 1) if 1 - (1 - band_chance(threshold, r, both)) ** (values // r) >= recall]
    if not fit:
        raise ValueError(f"{values} signature values cannot reach recall {recall} at {threshold}")
    return fit[-1]


def sets_of(buf, offsets, k: int, pieces=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, owner, sizes): sorted distinct k-word shingles of every owner, lower-casing A-Z.

    Owners are the rows, or the spans `pieces` = (start, end, row)."""
    folded = T.FOLD[buf]
    start, end, row = T.spans(folded, offsets, T.SPACE)
    owners = len(offsets) - 1
    if pieces is not None:
        row = np.searchsorted(pieces[0], start, side="right") - 1
        owners = len(pieces[0])
    values, owner = T.distinct(*T.grams(T.span_hash(folded, start, end), row, k, shorter=True))
    return values, owner, np.bincount(owner, minlength=owners)


def keys_of(values, owner, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set, in two halves: sums of its mixed values."""
    a, b = np.zeros(owners, dtype=U), np.zeros(owners, dtype=U)
    if len(values):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        a[owner[first]] = T.mix(np.add.reduceat(T.mix(values + U(0x1234567)), first))
        b[owner[first]] = T.mix(np.add.reduceat(T.mix(values ^ U(0xABCDEF0123456789)), first) + U(1))
    return a, b


def bands_of(values, owner, owners: int, perms, rows: int, bands: int, both: bool) -> np.ndarray:
    """Band keys, owners x bands.  With `both`, every permutation gives its minimum and its maximum,
    so a band of `rows` values takes half as many hash evaluations."""
    out = np.zeros((owners, bands), dtype=U)
    if not len(values):
        return out
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    who = owner[first]
    x = np.empty_like(values)
    need = rows * bands
    i = 0
    for a, b in zip(*perms):
        np.multiply(values, a, out=x)
        np.add(x, b, out=x)
        for least in (np.minimum, np.maximum)[:1 + both]:
            if i < need:
                j = i // rows
                out[who, j] = T.mix(out[who, j] * U(T.BASE) + least.reduceat(x, first) + U(j + 1))
                i += 1
    return out


def band_column(keys: np.ndarray, present: np.ndarray) -> pa.Array:
    """One list of band keys per owner, empty for an empty set."""
    sizes = np.where(present, keys.shape[1], 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(T.signed(keys[present].ravel())))


def set_column(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(T.signed(values)))


def signatures(texts: DataFrame, k: int, rows: int, bands: int, both: bool) -> DataFrame:
    """(id, n, a, b, bands) for every row of (id, text): set size, set key and band keys."""
    perms = permutations((rows * bands + both) // (1 + both))

    def work(batches):
        for batch in batches:
            for lo, hi, buf, offsets in T.blocks(batch.column(1)):
                values, owner, n = sets_of(buf, offsets, k)
                a, b = keys_of(values, owner, hi - lo)
                keys = bands_of(values, owner, hi - lo, perms, rows, bands, both)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(T.signed(a)), pa.array(T.signed(b)), band_column(keys, n > 0)],
                    ["id", "n", "a", "b", "bands"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", F.col("text").cast("string").alias("text")).mapInArrow(work, f"id {kind}, n bigint, a bigint, b bigint, bands array<bigint>")


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(key, s) for every row of (key, text) whose set has that key: its shingles as 64-bit hashes."""

    def work(batches):
        for batch in batches:
            for lo, hi, buf, offsets in T.blocks(batch.column(2)):
                values, owner, n = sets_of(buf, offsets, k)
                a, b = keys_of(values, owner, hi - lo)
                mine = pa.array((batch.column(0).slice(lo, hi - lo).to_numpy() == T.signed(a)) & (batch.column(1).slice(lo, hi - lo).to_numpy() == T.signed(b)))
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(a)), pa.array(T.signed(b)), set_column(values, n)], ["a", "b", "s"]).filter(mine)

    found = texts.select("key.a", "key.b", F.col("text").cast("string")).mapInArrow(work, "a bigint, b bigint, s array<bigint>")
    return found.select(F.struct("a", "b").alias("key"), "s")
