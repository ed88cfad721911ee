"""Static binary-fuse filters, and screening rows on the map side before anything large moves.

``split_by`` parts a table into rows that are certainly not among some keys and
rows that may be: only the latter need a join.  The filters take about 2.3 bytes
a key and are broadcast only up to ``MOST_KEYS`` keys; beyond, every row may be
among them and the join that follows does all the work, so results never depend
on the screen.  Keys are hashes and never null; equal keys of different rows only
send more rows to the join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Keys to a bucket, so that a bucket and its filter fit a Python worker many times over.
BUCKET_ROWS = 200_000
#: Keys whose filters are broadcast: 16 million take less than 40 MB.
MOST_KEYS = 16_000_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class BinaryFuse:
    """A static 3-wise binary-fuse filter with 16-bit fingerprints over 64-bit keys."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int):
        h = _mix(keys, seed)
        at = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * segment
        mask = np.uint64(segment - 1)
        slots = np.stack([at + ((h >> np.uint64(s)) & mask).astype(np.int64) + k * segment for k, s in enumerate((0, 16, 5))])
        return slots, (_mix(h, 7) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """Peel the 3-uniform hypergraph in rounds; a seed that fails is followed by the next."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(16, int(np.log2(max(n, 2)) / np.log2(3.33) + 2.25)))
        capacity = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))) + 12
        segments = max(1, -(-capacity // segment) - 2)
        for seed in range(1, 1000):
            slots, prints = cls._places(keys, seed, segment, segments)
            size = (segments + 2) * segment
            count = np.bincount(slots.ravel(), minlength=size)
            owner = np.zeros(size, np.int64)
            for k in range(3):
                np.bitwise_xor.at(owner, slots[k], np.arange(n))
            order, left = [], n
            while left:
                single = np.flatnonzero(count == 1)
                if not len(single):
                    break
                who, first = np.unique(owner[single], return_index=True)
                order.append((who, single[first]))
                for k in range(3):
                    np.subtract.at(count, slots[k][who], 1)
                    np.bitwise_xor.at(owner, slots[k][who], who)
                left -= len(who)
            if not left:
                table = np.zeros(size, np.uint16)
                for who, at in reversed(order):
                    a, b, c = (table[slots[k][who]] for k in range(3))
                    table[at] = prints[who] ^ a ^ b ^ c ^ table[at]
                return cls(seed, segment, segments, table)
        raise RuntimeError("no seed builds the filter")

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._places(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        a, b, c = (self.prints[s] for s in slots)
        return (a ^ b ^ c) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.int64).tobytes() + self.prints.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse:
        head = np.frombuffer(data, np.int64, 3)
        return cls(*map(int, head), np.frombuffer(data, np.uint16, offset=24))


def split_by(rows: DataFrame, key: Column, keys: DataFrame, most: int = MOST_KEYS) -> tuple[DataFrame | None, DataFrame]:
    """(rows that are surely not among ``keys``, rows that may be): ``key`` and the one column of ``keys`` are bigints.

    The first is None where there are too many keys to screen by.
    """
    told = keys.select(F.col(keys.columns[0]).alias("k"))
    n = told.count()
    if n > most:
        return None, rows
    buckets = max(1, -(-n // BUCKET_ROWS))

    def build(table: pa.Table) -> pa.Table:
        own = table["k"].to_numpy().view(np.uint64)
        return pa.table({"bucket": table["bucket"][:1], "filter": pa.array([BinaryFuse.build(own).to_bytes()], pa.binary())})

    made = told.select("k", F.pmod("k", F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInArrow(lean(build), "bucket bigint, filter binary").collect() if n else []
    held = rows.sparkSession.sparkContext.broadcast({r["bucket"]: bytes(r["filter"]) for r in made})
    ready: dict[int, BinaryFuse] = {}

    @F.pandas_udf("boolean")
    def may_hold(values: pd.Series) -> pd.Series:
        if not ready:
            ready.update({b: BinaryFuse.from_bytes(f) for b, f in held.value.items()})
        own = values.to_numpy(np.int64)
        out, bucket = np.zeros(len(own), bool), own % buckets
        for b, f in ready.items():
            at = np.flatnonzero(bucket == b)
            if len(at):
                out[at] = f.contains(own[at].view(np.uint64))
        return pd.Series(out)

    hit = may_hold(key)
    return rows.filter(~hit), rows.filter(hit)
