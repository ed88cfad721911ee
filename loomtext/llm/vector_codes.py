"""Product codes of vectors, their codebooks learned by Elkan's form of Lloyd's algorithm.

A vector's components become integers ``floor(scale * x)`` and the vector is cut into equal
consecutive parts; each part has a codebook.  A round assigns every part to its nearest
entry (squared Euclidean distance, ties to the lower index) and moves each entry to the
floored mean of its parts; an entry without parts stays.

Every row keeps, for each part, an upper bound of the distance to its entry and one lower
bound for each entry, in a table of the shared folder that each round reads and writes
anew.  Before a round the bounds are shifted by how far the entries moved.  An entry is
passed over only where its lower bound, or half its distance from the row's entry, is
strictly above the upper bound; what is left, ties included, is decided by exact integer
distances.  Bounds are always rounded to the safe side: lower ones are the upper half of a
32-bit float (2 bytes an entry), upper ones 64-bit floats.  So codes are those of plain
Lloyd, whatever the bounds.

Rows are assigned where they lie.  Sums for the next codebook are added up inside a task
first; the driver sees codebooks only (``parts * entries`` rows at most).

Vectors that are null or hold null or non-finite components are dropped.  Codebooks begin
as the ``entries`` smallest ids (null ids last, equal ids in the order of their vectors);
with fewer vectors they are smaller.  Repeated rows are rows of their own.  Other columns
are ignored, an empty table gives an empty one.  ``ValueError``: vectors of different
lengths or of one that ``parts`` does not divide, or a component beyond 2**28 in integers
(sums of squares must fit 64 bits).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, lean

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: The largest integer component.
MOST = 1 << 28
#: What bounds are widened by, far above the error of a square root and far below what matters.
SLACK = 1e-12
#: Pairs of a row and an entry that are compared at a time.
BLOCK = 1 << 18
#: A label's sum is dealt to so many keys, as one label may have a third of the rows.
SALTS = 16


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by entries: by a float product where no number in it can pass 2**53."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(book)), np.int64)
    for k, e in enumerate(book):
        out[:, k] = ((x - e) ** 2).sum(1)
    return out


def below(squares: np.ndarray) -> np.ndarray:
    """Lower bounds of the roots of integers."""
    return np.sqrt(squares.astype(np.float64)) * (1 - SLACK)


def above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK)


def pack(lower: np.ndarray) -> np.ndarray:
    """Lower bounds as the upper halves of 32-bit floats, never above what they were."""
    near = lower.astype(np.float32)
    return (np.nextafter(near, np.float32(0)).view(np.uint32) >> 16).astype(np.uint16)


def unpack(packed: np.ndarray) -> np.ndarray:
    return (packed.astype(np.uint32) << 16).view(np.float32).astype(np.float64)


def assign_first(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper bound, lower bounds) of each row, from all distances."""
    squares = distances(x, book)
    code = squares.argmin(1)
    return code, above(squares[np.arange(len(x)), code]), below(squares)


def assign_again(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from the bounds of the round before, after entries have ``moved``; and how many distances that took."""
    lower = np.maximum(lower - moved, 0) * (1 - SLACK)
    upper = (upper + moved[code]) * (1 + SLACK)
    half = below(distances(book, book)) / 2
    may = (lower <= upper[:, None]) & (half[code] <= upper[:, None])
    may[np.arange(len(x)), code] = False
    rows = np.flatnonzero(may.any(1))
    if not len(rows):
        return code, upper, lower, 0
    own = code[rows]
    squares = np.full((len(rows), len(book)), np.iinfo(np.int64).max)
    squares[np.arange(len(rows)), own] = exact = ((x[rows] - book[own]) ** 2).sum(1)
    upper[rows], lower[rows, own] = above(exact), below(exact)
    i, k = np.nonzero(may[rows] & (lower[rows] <= upper[rows, None]) & (half[own] <= upper[rows, None]))
    for at in range(0, len(i), BLOCK):
        a, b = i[at : at + BLOCK], k[at : at + BLOCK]
        squares[a, b] = found = ((x[rows[a]] - book[b]) ** 2).sum(1)
        lower[rows[a], b] = below(found)
    code = code.copy()
    code[rows] = squares.argmin(1)
    upper[rows] = above(squares.min(1))
    return code, upper, lower, len(rows) + len(i)


class Coder:
    """Codebooks of ``vectors`` after ``rounds`` rounds, and the codes that they give."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE):
        if not (1 <= entries <= 256 and parts >= 1 and rounds >= 0):
            raise ValueError("entries must be 1 to 256, parts at least 1, rounds not negative")
        self.work, self.parts, self.scale = Workspace(vectors.sparkSession, "vector-codes"), parts, scale
        vector = F.col(f"`{vector_col}`")
        rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), vector.cast("array<double>").alias("v"))
        self.rows = rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        self.kinds = [self.rows.schema[c].dataType.simpleString() for c in ("id", "label")]
        told = self.rows.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
        self.size = told["low"] or 0
        if told["low"] != told["high"]:
            raise ValueError(f"vectors have {told['low']} to {told['high']} components")
        if self.size % parts:
            raise ValueError(f"{self.size} components cannot be cut into {parts} equal parts")
        if (told["most"] or 0) * scale >= MOST:
            raise ValueError(f"components must stay below {MOST} in integers")
        self.books = self._first(entries)
        self.pruned: list[DataFrame] = []
        self.coded = self._learn(rounds) if len(self.books[0]) else None

    def _first(self, entries: int) -> list[np.ndarray]:
        least = self.rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
        whole = np.floor(np.array([r["v"] for r in least], np.float64).reshape(len(least), self.size) * self.scale).astype(np.int64)
        return list(np.split(whole, self.parts, axis=1))

    def _learn(self, rounds: int) -> DataFrame:
        """The rows' table after the last assignment: id, label, vector, codes, upper, lower, computed."""
        state = self.work.save(self._assign(self.rows, None), "rows-0")
        for i in range(1, rounds + 1):
            before, self.books = self.books, self._moved(state)
            moved = [above(((a - b) ** 2).sum(1)) for a, b in zip(before, self.books, strict=True)]
            state, old = self.work.save(self._assign(state, moved), f"rows-{i}"), f"rows-{i - 1}"
            self.work.drop(old)
        return state

    def _assign(self, rows: DataFrame, moved: list[np.ndarray] | None) -> DataFrame:
        books, parts, scale = rows.sparkSession.sparkContext.broadcast((self.books, moved)), self.parts, self.scale
        entries, part = len(self.books[0]), self.size // self.parts

        def run(it):
            books_now, shift = books.value
            for batch in it:
                n = batch.num_rows
                if not n:
                    continue
                if shift is None:
                    x = np.floor(np.array(batch["v"].flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, parts * part) * scale).astype(np.int64)
                    vector, old = _binary(x.astype(np.int32)), None
                else:
                    vector = batch["vector"]
                    x = _rows(vector, np.int32, parts * part).astype(np.int64)
                    old = _rows(batch["codes"], np.uint8, parts), _rows(batch["upper"], np.float64, parts), _rows(batch["lower"], np.uint16, parts * entries).reshape(n, parts, entries)
                codes, uppers, lowers, took = np.empty((n, parts), np.uint8), np.empty((n, parts)), np.empty((n, parts, entries), np.uint16), 0
                for p, book in enumerate(books_now):
                    own = x[:, p * part : (p + 1) * part]
                    if old is None:
                        code, upper, lower = assign_first(own, book)
                        took += n * entries
                    else:
                        code, upper, lower, some = assign_again(own, book, old[0][:, p].astype(np.int64), old[1][:, p].copy(), unpack(old[2][:, p]), shift[p])
                        took += some
                    codes[:, p], uppers[:, p], lowers[:, p] = code, upper, pack(lower)
                counted = np.zeros(n, np.int64)
                counted[0] = took
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vector, _binary(codes), _binary(uppers), _binary(lowers.reshape(n, -1)), pa.array(counted)], ["id", "label", "vector", "codes", "upper", "lower", "computed"])

        return rows.mapInArrow(lean(run), f"id {self.kinds[0]}, label {self.kinds[1]}, vector binary, codes binary, upper binary, lower binary, computed bigint")

    def _moved(self, state: DataFrame) -> list[np.ndarray]:
        """The codebooks after a round: floored means of the entries' parts."""
        parts, part, entries = self.parts, self.size // self.parts, len(self.books[0])

        def add(it):
            sums, counts = np.zeros((parts, entries, part), np.int64), np.zeros((parts, entries), np.int64)
            for batch in it:
                x, codes = _rows(batch["vector"], np.int32, parts * part).astype(np.int64), _rows(batch["codes"], np.uint8, parts)
                for p in range(parts):
                    np.add.at(sums[p], codes[:, p], x[:, p * part : (p + 1) * part])
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
            p, e = np.nonzero(counts)
            whole = np.concatenate([counts[p, e][:, None], sums[p, e]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(whole.tolist(), pa.list_(pa.int64()))], ["part", "entry", "sums"])

        own = state.select("vector", "codes").mapInArrow(lean(add), "part int, entry int, sums array<bigint>")
        sums = own.select("part", "entry", F.posexplode("sums").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("x").alias("x")).toPandas()
        books = [b.copy() for b in self.books]
        for (p, e), group in sums.groupby(["part", "entry"]):
            x = group.sort_values("place")["x"].to_numpy(np.int64)
            books[p][e] = x[1:] // x[0]
        return books

    @property
    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and place."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """id, label, code (two hex digits a part) and error (squared distance summed over parts) of each vector."""
        kind = f"id {self.kinds[0]}, label {self.kinds[1]}, code string, error bigint"
        if self.coded is None:
            return self.rows.sparkSession.createDataFrame([], kind)
        books, parts = self.rows.sparkSession.sparkContext.broadcast(self.books), self.parts
        size = self.size

        def run(it):
            whole = books.value
            for batch in it:
                codes = _rows(batch["codes"], np.uint8, parts)
                x = _rows(batch["vector"], np.int32, size).astype(np.int64)
                near = np.concatenate([book[codes[:, p]] for p, book in enumerate(whole)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(((x - near) ** 2).sum(1))], ["id", "label", "code", "error"])

        return self.coded.select("id", "label", "vector", "codes").mapInArrow(lean(run), kind)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * (rows.shape[1] * rows.itemsize)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)]).cast(pa.binary())


def _rows(column: pa.Array, kind, width: int) -> np.ndarray:
    """The matrix whose rows a column of equally long binary values holds."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def compress(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together), codebooks_sha256 of each usable vector."""
    coder = Coder(vectors, id_col, **options)
    rows = coder.work.save(coder.codes().withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")), "codes")
    if coder.coded is not None:
        coder.work.drop(f"rows-{options.get('rounds', ROUNDS)}")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("to"))
    rows = rows.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("to")))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(coder.digest).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """Plain Lloyd, round by round."""
    width = "(SELECT max(len(x)) // 4 FROM v)"
    square = "list_inner_product(p.y, p.y) + list_inner_product(b.y, b.y) - 2 * list_inner_product(p.y, b.y)"
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"p AS MATERIALIZED (SELECT rid, part, x[part * {width} + 1 : (part + 1) * {width}] AS y FROM v, range(4) AS r(part))",
        "b0 AS MATERIALIZED (SELECT part, entry, y FROM (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS entry FROM v) JOIN p USING (rid) WHERE entry < 256)",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT rid, part, any_value(p.y) AS y, min({{'d': {square}, 'e': entry}}) AS m FROM p JOIN b{i} AS b USING (part) GROUP BY rid, part)")
        if i < ROUNDS:
            parts.append(f"s{i} AS MATERIALIZED (SELECT part, entry, list(CAST(z AS DOUBLE) ORDER BY place) AS y FROM (SELECT part, entry, place, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS z FROM (SELECT part, m.e AS entry, generate_subscripts(y, 1) AS place, CAST(unnest(y) AS BIGINT) AS c FROM a{i}) GROUP BY part, entry, place) GROUP BY part, entry)")
            parts.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.y, b.y) AS y FROM b{i} AS b LEFT JOIN s{i} AS s ON s.part = b.part AND s.entry = b.entry)")
    joined = ",\n".join(parts)
    return f"""
WITH {joined},
h AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
e AS (SELECT rid, string_agg(lower(printf('%02x', CAST(m.e AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (rid), h
"""


ORACLE = _oracle()
