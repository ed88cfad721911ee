"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Lengths are small integers, so which bins hold which lengths is decided on the
histogram of lengths (at most ``capacity`` rows on the driver, whatever the
input's size), by large-item matching: pieces above a third of the capacity go
at most two to a bin, each longest piece with the longest one that still fits;
the rest go, longest first, to the bin with the least room that takes them.
The plan says for each run of ranks of a length which bins and offsets they
get.  Pieces are ranked within their length by sub-buckets of bounded size, and
find their place by binary search in the (small, capacity-bounded) plan.

A document is its ids and the end id.  Only longer documents are cut: into
pieces of exactly the capacity, but for the first, which takes what is over.  A
null text is empty: a piece of the end id alone.  Repeated rows are packed as
often as they come.  Empty tables give empty results.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, documents, lean, texts

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024
END = 2
#: Pieces that are ranked together.
SUB_ROWS = 100_000


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """(runs, bins) for a histogram of lengths.

    A run (length, first rank, ranks, first bin, pieces to a bin, offset) puts the
    ranks from the first on into the bins from the first on, so many to each, one
    after the other from the offset on.
    """
    left = {s: n for s, n in counts.items() if n}
    given = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first bin, bins)
    bins = 0

    def put(size: int, n: int, base: int, each: int, offset: int) -> None:
        runs.append((size, given[size], n, base, each, offset))
        given[size] += n
        left[size] -= n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((s for s in large if s <= capacity - a and s <= a and left[s] > (s == a)), None)
            m = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, m, bins, 1, 0)
            if b is not None:
                put(b, m, bins, 1, a)
            room[capacity - a - (b or 0)].append((bins, m))
            bins += m
    for s in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        while left[s]:
            gap = next((g for g in range(s, capacity + 1) if room[g]), None)
            if gap is None:
                gap, m = capacity, -(-left[s] // (capacity // s))
                room[gap].append((bins, m))
                bins += m
            base, m = room[gap].pop()
            each = gap // s
            full = min(m, left[s] // each)
            if full:
                put(s, full * each, base, each, capacity - gap)
                room[gap - each * s].append((base, full))
            if full < m and (over := min(left[s], each)) and left[s] < each:
                put(s, over, base + full, over, capacity - gap)
                room[gap - over * s].append((base + full, 1))
                full += 1
            if full < m:
                room[gap].append((base + full, m - full))
    return np.array(runs, np.int64).reshape(-1, 6), bins


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    head = n % capacity or capacity
    return [(0, min(n, head))] + [(i, capacity) for i in range(head, n, capacity)]


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes are themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Little-endian 32-bit ids of texts, as a byte-level tokenizer's file gives them.

    The file's vocabulary serves as ranks for the faster of the two public encoders; that is
    the same encoding where merges are listed in the order of the ids they make, which is
    checked.  Added tokens inside texts are found first, as the file's own library does.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, alphabet = file["model"], byte_alphabet()
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        raw = lambda t: bytes(map(alphabet.__getitem__, t))
        ranks = {raw(t): i for t, i in model["vocab"].items() if t not in added}
        made = [ranks[b"".join(map(raw, m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
        kept = (file["normalizer"], file["pre_tokenizer"]["type"], file["pre_tokenizer"]["add_prefix_space"], file["pre_tokenizer"]["use_regex"], model.get("ignore_merges"), model.get("dropout"))
        if made != sorted(made) or kept != (None, "ByteLevel", False, True, False, None) or any(t[x] for t in file["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("not a plain byte-level tokenizer")
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added).encode
        self.added = set(added)

    def __call__(self, text: str) -> bytes:
        return np.array(self.encode(text, allowed_special=self.added), "<u4").tobytes()


@lru_cache(2)
def load(path: str) -> Encoder:
    from public_tokenizers import PATTERN

    return Encoder(path, PATTERN)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece and, if asked for, its ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def run(it):
        encode = load(path)
        for batch in it:
            done = 0
            for _, held in texts(batch, "text", 1 << 20):
                who, rows, all_ids = [], [], []
                for i, t in enumerate(held):
                    ids = encode(t.decode("utf-8", "replace")) + last
                    for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + n)]
                        who.append(done + i)
                        rows.append((k, start, n, zlib.crc32(own)))
                        if with_ids:
                            all_ids.append(np.frombuffer(own, "<i4"))
                done += len(held)
                k, start, n, crc = zip(*rows, strict=True)
                cols = {"doc_id": batch.column(0).take(pa.array(who)), "piece": pa.array(k, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with a length of 1 to ``capacity``) plus sequence_id and offset, in place of columns of these names if there are any."""
    spark = items.sparkSession
    mine = {c: f"_in_{i}" for i, c in enumerate(c for c in items.columns if c not in ("sequence_id", "offset"))}
    size = mine["length"]
    # Written first: ranks must not change when a task runs again.
    held = Workspace(spark, "packing").save(items.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()]), "pieces")
    total = held.count()
    subs = max(1, -(-total // SUB_ROWS))
    own = F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(subs))
    rows = held.select("*", own.alias("_sub"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counted = rows.groupBy(F.col(size).alias("length"), "_sub").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(s is None or not 0 < s <= capacity for s in histogram):
        raise ValueError("lengths must be 1 to the capacity")
    runs, _ = plan(histogram, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    told = spark.sparkContext.broadcast(runs)
    before = Window.partitionBy("length").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select(F.col("length").alias(size), "_sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(size, "_sub").orderBy("_file", "_row")
    ranked = rows.withColumn("_at", F.row_number().over(within)).join(bases, [size, "_sub"]).select(*mine.values(), (F.col("_base") + F.col("_at") - 1).alias("_rank"))

    names = list(mine.values())

    def place(it):
        runs = told.value
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in it:
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (size, "_rank"))
            run = runs[np.searchsorted(keys, (n << 48) + rank, "right") - 1]
            k = rank - run[:, 1]
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(run[:, 3] + k // run[:, 4]), "offset": pa.array(run[:, 5] + k % run[:, 4] * n)})

    schema = ", ".join(f"{n} {held.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(lean(place), schema).select(*[F.col(n).alias(c) for c, n in mine.items()], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids of each sequence, from packed pieces that carry their ids."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, path, capacity, end, id_col, text_col, with_ids), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
