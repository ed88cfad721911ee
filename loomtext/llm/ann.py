"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` hash tables cuts ``width`` wide slots on ``hashes`` Gaussian
projections (2-stable, for Euclidean distance).  A query visits its own bucket
and perturbed ones, in the order of the estimated chance that a neighbour lies
there: the smaller the sum of squared distances to the slot borders crossed, the
sooner.  The candidates of all tables are merged and ranked by exact distance in
double precision.

The width follows the data's scale: that of unit vectors times what distances
between at most ``SAMPLE`` queries and as many rows (the smallest hashes of ids)
have over those of unit vectors, for each length of vectors.  The sample decides
the width only; lengths it lacks are scanned exactly.

Queries come in blocks of at most ``block_rows`` (so what is broadcast is bounded
by parameters), and every row is hashed and indexed where it lies; a task keeps
the best ``k`` of each query it has met and emits those alone.  Queries that
found fewer than ``k`` although there are more rows are answered by an exact scan.

Vectors that are null, zero, or hold null or non-finite components take no part.
Vectors of another length than the query's are not its candidates.  Rows that
repeat a vec_id are candidates of their own, but a query never finds a row with
its own id; a null id takes no part.  Ties go to the smaller id.  Other columns
are ignored; empty tables give empty results.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

K = 10
QUERY_EVERY = 100
#: Rows and queries from which the scale is read; the distance that nine in ten unit vectors of many dimensions keep within.
SAMPLE, TYPICAL = 512, 1.5
FOUND = "query_id bigint, vec_id bigint, score double"
USABLE = "id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"


class Tables:
    """The hash functions of all tables, fixed by a seed."""

    def __init__(self, dim: int, tables: int = 24, hashes: int = 8, width: float = 2.0, probes: int = 32, seed: int = 7):
        self.tables, self.hashes, self.width, self.probes = tables, hashes, width, probes
        rng = np.random.default_rng(seed)
        self.axes = rng.standard_normal((dim, tables * hashes))
        self.shift = rng.uniform(0, width, tables * hashes)
        self.salt = rng.integers(1, 2**62, hashes, dtype=np.uint64) | np.uint64(1)

    def slots(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot numbers, place inside the slot from 0 to 1) by row, table and hash."""
        at = (x @ self.axes + self.shift) / self.width
        low = np.floor(at)
        shape = (len(x), self.tables, self.hashes)
        return low.astype(np.int64).reshape(shape), (at - low).reshape(shape)

    def keys(self, slots: np.ndarray) -> np.ndarray:
        mixed = slots.astype(np.uint64) * self.salt
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return mixed.sum(-1, dtype=np.uint64)

    def template(self) -> np.ndarray:
        """(probes, 2 * hashes): which borders to cross, nearest first, in the order of estimated success.

        The j-th nearest of the 2 * hashes borders is at an expected squared distance that
        depends on j alone, so one order of border sets, by the sum of those, serves all queries.
        A set that crosses both borders of one slot is left out.
        """
        m = self.hashes
        j = np.arange(1, 2 * m + 1)
        cost = np.where(j <= m, j * (j + 1.0), 4.0 * (m + 1) * (m + 2) * (1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4.0 * (m + 1) * (m + 2))))
        sets, heap = [()], [(cost[0], (0,))]
        while heap and len(sets) < self.probes:
            total, own = heapq.heappop(heap)
            if all(2 * m - 1 - e not in own for e in own):
                sets.append(own)
            if (last := own[-1]) + 1 < 2 * m:
                heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*own[:-1], last + 1)))
                heapq.heappush(heap, (total + cost[last + 1], (*own, last + 1)))
        out = np.zeros((len(sets), 2 * m), np.int64)
        for p, own in enumerate(sets):
            out[p, list(own)] = 1
        return out

    def visits(self, queries: np.ndarray) -> np.ndarray:
        """Bucket keys by query, table and probe."""
        slots, inside = self.slots(queries)
        m = self.hashes
        near = np.argsort(np.concatenate([inside, 1 - inside], -1), -1, kind="stable")
        step = np.where(near < m, -1, 1)[..., None] * (near[..., None] % m == np.arange(m))
        return self.keys(slots[:, :, None, :] + np.einsum("pe,qteh->qtph", self.template(), step))


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, member) of all members of the integer ranges [low, high)."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def candidates(rows: np.ndarray, visits: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (query, row) pairs that share a visited bucket in any table."""
    keys = tables.keys(tables.slots(rows)[0])
    hit = np.zeros((len(visits), len(rows)), bool)
    for t in range(tables.tables):
        order = np.argsort(keys[:, t], kind="stable")
        held = keys[order, t]
        wanted = visits[:, t].ravel()
        which, at = ranges(np.searchsorted(held, wanted, "left"), np.searchsorted(held, wanted, "right"))
        hit[which // visits.shape[2], order[at]] = True
    return np.nonzero(hit)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k nearest, ties to the smaller id."""
    order = np.lexsort((ids, score, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def vectors(ids, values) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the usable vectors, by length."""
    by: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, values, strict=True):
        if i is None or v is None or not len(v) or any(x is None for x in v):
            continue
        own = by.setdefault(len(v), ([], []))
        own[0].append(i)
        own[1].append(v)
    out = []
    for a, b in by.values():
        m = np.array(b, np.float64)
        good = np.isfinite(m).all(1) & (m != 0).any(1)
        if good.any():
            out.append((np.array(a, np.int64)[good], m[good]))
    return out


def matrices(ids: pa.Array, lists: pa.ListArray):
    """(ids, matrix) of usable vectors, by length."""
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    ids, size = ids.to_numpy(), np.diff(at)
    for d in np.unique(size).tolist():
        own = size == d
        yield ids[own], values[at[:-1][own][:, None] + np.arange(d)]


def scales(rows: DataFrame, queries: DataFrame) -> dict[int, float]:
    """By length of vectors, the distance within which nine in ten pairs of a sampled query and a sampled row lie, over that of unit vectors."""

    def sample(df: DataFrame) -> dict[int, np.ndarray]:
        own = df.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        return {m.shape[1]: m for _, m in vectors([r["id"] for r in own], [r["v"] for r in own])}

    held, out = sample(rows), {}
    for d, asked in sample(queries).items():
        if d in held:
            far = np.concatenate([np.sqrt(((held[d] - q) ** 2).sum(1)) for q in asked])
            far = far[far > 0]
            if len(far) and np.isfinite(far).all():
                out[d] = float(np.quantile(far, 0.9)) / TYPICAL
    return out


def _search(block: list[tuple[np.ndarray, np.ndarray]], settings: dict, scale: dict[int, float], k: int, exact: bool):
    """A mapInArrow function: the best k of each query of the block among the rows of a task."""

    def run(it):
        ready = {}
        for ids, m in block:
            d = m.shape[1]
            tables = None if exact or d not in scale else Tables(d, **settings)
            if tables and "width" not in settings:
                tables = Tables(d, **settings, width=tables.width * scale[d])
            ready[d] = (ids, m, tables, tables and tables.visits(m))
        kept = {d: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for d in ready}
        for batch in it:
            for ids, rows in matrices(batch.column(0), batch.column(1)):
                if (d := rows.shape[1]) not in ready:
                    continue
                qids, qs, tables, visits = ready[d]
                for a in range(0, len(rows), 4096):
                    rid, part = ids[a : a + 4096], rows[a : a + 4096]
                    for b in range(0, len(qs), 512):
                        q, r = np.nonzero(np.ones((min(512, len(qs) - b), len(part)), bool)) if visits is None else candidates(part, visits[b : b + 512], tables)
                        q = q + b
                        other = qids[q] != rid[r]
                        q, r = q[other], r[other]
                        score = np.empty(len(q))
                        for c in range(0, len(q), 20_000):
                            score[c : c + 20_000] = np.sqrt(((part[r[c : c + 20_000]] - qs[q[c : c + 20_000]]) ** 2).sum(1))
                        old = kept[d]
                        q, rr, score = np.r_[old[0], q], np.r_[old[1], rid[r]], np.r_[old[2], score]
                        top = best(q, rr, score, k)
                        kept[d] = q[top], rr[top], score[top]
        for d, (q, r, score) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(ready[d][0][q]), pa.array(r), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def _blocks(queries: DataFrame, n: int, block_rows: int):
    blocks = max(1, -(-n // block_rows))
    for i in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()
        yield vectors([r["id"] for r in part], [r["v"] for r in part])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 2048, **settings) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of ``queries`` among ``rows``."""
    spark = rows.sparkSession
    work = Workspace(spark, "ann")
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(USABLE)
    rows, queries = pick(rows), pick(queries).dropDuplicates(["id"])

    scale = scales(rows, queries)

    def scan(asked: DataFrame, n: int, name: str, exact: bool) -> DataFrame:
        parts = []
        for i, block in enumerate(_blocks(asked, n, block_rows)):
            parts.append(work.save(rows.mapInArrow(_search(block, settings, scale, k, exact), FOUND), f"{name}-{i}"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return _ranked(out, k)

    found = scan(queries, queries.count(), "found", False)
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    short = queries.join(enough, queries.id == enough.query_id, "left_anti")
    if n := short.count():
        exact = scan(short, n, "exact", True)
        found = found.join(exact.select("query_id").distinct(), "query_id", "left_anti").unionByName(exact)
    return found.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.filter(F.col("vec_id") % QUERY_EVERY == 0))
