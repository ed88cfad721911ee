"""Work inside array columns: running sums on the JVM, and what takes a whole batch's arrays at once through Arrow."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Elements that a running sum takes at a time: a fold copies what it has, so blocks are summed first and then shifted.
BLOCK = 64
#: Places that are counted at a time.
PLACES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Have rows cross to Python 1,000 at a time, unless the session names a number: of Spark's own 10,000 whole texts a worker would hold the words several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where a lambda would compute it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fenced(value: Column) -> Column:
    """The value, in a projection that is not merged into what uses it.

    Spark does not tell UDFs apart whose arguments hold lambdas that refer to outer ones, and so cannot run them.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def running_sums(values: Column) -> Column:
    """The running sums of an array of bigints, its own element included, in the row and without Python."""
    add = lambda done, x: F.concat(done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0).cast("bigint")) + x))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("before"))
    last = lambda b: F.get(b, F.size(b) - 1)
    ends = lambda sums: F.aggregate(sums, start, lambda done, b: F.struct((done["sum"] + last(b)).alias("sum"), F.concat(done["before"], F.array(done["sum"])).alias("before")))["before"]
    shifted = lambda sums: F.flatten(F.zip_with(sums, ends(sums), lambda b, base: F.transform(b, lambda x: x + base)))
    inner = lambda all_: F.transform(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(BLOCK)), lambda i: F.aggregate(F.slice(all_, i + 1, F.lit(BLOCK)), F.array().cast("array<bigint>"), add))
    return let(values, lambda all_: F.when(F.size(all_) > 0, let(inner(all_), shifted)).otherwise(F.array().cast("array<bigint>")))


def _lists(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets from 0, elements) of a list array; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.append(0, np.cumsum(sizes)), values.flatten()


def _made(offsets: np.ndarray, elements: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), elements)


def covered(own: Column, other: Column, places: Column, agg: str, distinct: bool) -> Column:
    """For each of a row's intervals (a, b) of places, how far the other intervals cover it.

    "count": pairs of a place and an interval that covers it, or with ``distinct`` places so covered;
    "bool": whether there are any; "frac": their share in the rows of a left join, null without places.
    Ends of intervals are summed up along the places.
    """

    @F.arrow_udf({"count": "array<bigint>", "bool": "array<boolean>", "frac": "array<double>"}[agg])
    def swept(own: pa.Array, other: pa.Array, places: pa.Array) -> pa.Array:
        offsets, mine = _lists(own)
        others, theirs = _lists(other)
        sizes = np.maximum(pc.fill_null(places, 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        side = lambda x, name: x.field(name).to_numpy(zero_copy_only=False).astype(np.int64)
        a, b, c, d = side(mine, "a"), side(mine, "b"), side(theirs, "a"), side(theirs, "b")
        hit, whole = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        at = 0
        while at < len(sizes):
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), PLACES, "right")))
            base = np.append(0, np.cumsum(sizes[at:end] + 1))
            ends = np.zeros(base[-1] + 1, np.int64)
            row = lambda cut: np.repeat(base[:-1], np.diff(cut[at : end + 1]))
            x, y = slice(offsets[at], offsets[end]), slice(others[at], others[end])
            full = c[y] <= d[y]
            shift = row(others)[full]
            np.add.at(ends, shift + c[y][full], 1)
            np.add.at(ends, shift + d[y][full] + 1, -1)
            count = np.cumsum(ends)[:-1]
            hits, rows = (np.append(0, np.cumsum(z)) for z in (np.minimum(count, 1) if distinct else count, np.ones_like(count) if distinct else np.maximum(count, 1)))
            shift, some = row(offsets), a[x] <= b[x]
            low, high = shift + a[x], shift + np.maximum(b[x] + 1, a[x])
            hit[x], whole[x] = np.where(some, hits[high] - hits[low], 0), np.where(some, rows[high] - rows[low], 0)
            at = end
        if agg == "frac":
            return _made(offsets, pa.array(hit / np.maximum(whole, 1), mask=whole == 0))
        return _made(offsets, pa.array(hit > 0 if agg == "bool" else hit))

    # So that it stays a projection of its own: inside other functions of arrays no UDF is computed.
    return swept.asNondeterministic()(own, other, places)


def term_counts(terms: Column) -> Column:
    """The distinct terms of each row's array and how often it has them, as (term, tf); none for a null array."""

    @F.arrow_udf("array<struct<term:string,tf:bigint>>")
    def counted(terms: pa.Array) -> pa.Array:
        offsets, flat = _lists(terms)
        coded = flat.dictionary_encode()
        row, size = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), max(1, len(coded.dictionary))
        keys, counts = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        sizes = np.bincount(keys // size, minlength=len(offsets) - 1)
        return _made(np.append(0, np.cumsum(sizes)), pa.StructArray.from_arrays([coded.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.array(counts.astype(np.int64))], ["term", "tf"]))

    return counted(terms)


def running_counts(levels: Column, kinds: int) -> Column:
    """For an array of levels from 1: arrays ``n1`` to ``n<kinds>``, how many elements of that level come up to each element."""

    @F.arrow_udf("struct<" + ",".join(f"n{k}:array<bigint>" for k in range(1, kinds + 1)) + ">")
    def counted(levels: pa.Array) -> pa.Array:
        offsets, flat = _lists(levels)
        own = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
        parts = []
        for k in range(1, kinds + 1):
            sums = np.append(0, np.cumsum(own == k))
            parts.append(_made(offsets, pa.array(sums[1:] - np.repeat(sums[offsets[:-1]], np.diff(offsets)))))
        return pa.StructArray.from_arrays(parts, [f"n{k}" for k in range(1, kinds + 1)])

    return counted.asNondeterministic()(levels)
