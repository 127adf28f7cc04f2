"""Hashes of byte windows, and a bit filter of hashes that is small enough to broadcast whatever it is made of."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bits a key, and at most (a 32 MB broadcast); a part of the filter is built in one place.
BITS, MOST_BITS, PART = 16, 1 << 28, 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the power of 0 to n, modulo 2^64."""
    out = np.full(n + 1, base)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Windows:
    """Hashes of any windows of some bytes, each in constant time; equal windows have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:n], dtype=np.uint64)])
        self.back = powers(INVERSE, n)

    def __call__(self, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        x = (self.sums[start + size] - self.sums[start]) * self.back[start] + np.asarray(size, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _spots(keys: np.ndarray, bits: int):
    for shift in (0, 20, 36):
        yield ((keys >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64)


def bit_filter(keys: DataFrame, n: int) -> np.ndarray:
    """keys: one column of longs, n of them. Built in parts on the executors. It holds every key; beyond its bound others pass more often."""
    bits = min(MOST_BITS, max(PART, 1 << (BITS * n).bit_length()))
    name = keys.columns[0]

    def spots(batches):
        for b in batches:
            k = b.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            at = np.unique(np.concatenate(list(_spots(k, bits)))) if len(k) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // PART, pa.int32()), pa.array(at % PART, pa.int32())], ["part", "spot"])

    def merge(key, rows):
        part = np.zeros(PART, np.uint8)
        part[rows["spot"].to_numpy()] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(part).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in keys.mapInArrow(spots, "part int, spot int").groupBy("part").applyInArrow(merge, "part int, bits binary").collect():  # at most MOST_BITS in all
        out[r["part"] * PART // 8 : (r["part"] + 1) * PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys that the filter holds, or seems to."""
    at = None
    for i in range(3):
        k = keys if at is None else keys[at]
        spot = next(islice(_spots(k, 8 * len(bits)), i, None))
        ok = np.flatnonzero(bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1)
        at = ok if at is None else at[ok]
    return at
