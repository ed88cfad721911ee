"""Removal of repeated substrings with a suffix array, over any number of documents.

A byte goes when it is covered by a string of ``length`` bytes that also starts
anywhere else, in the same document or another; matches never cross documents
and are judged on the input.

Equal strings have equal content-defined anchors: of the ``length`` bytes the
``gram`` bytes with the least hash, the leftmost if tied.  So every start of a
string belongs to one anchor, and whether it repeats is decided among the places
with the same anchor.  A place is cut out as a segment, the bytes that its starts
cover.  A segment spans starts at most ``SPANS[0]`` apart, and the bytes that all of
these cover are its key.  Equal segments are one, with a weight.  Keys met once are
done with, and segments that equal texts alone have repeat with them.  The rest go by hash of the key to buckets of bounded size, and in each
bucket a Burrows-Wheeler transform with threshold-bounded interval expansion (see
``suffix_array``) finds the strings that repeat.  Where all segments of a key are
equal, the bytes of two of their places go there; neighbours that go on alike in
both places are strung together, so that their common bytes go once.

A key with more than ``hot`` distinct segments, such as a common line in
unlike surroundings, is not gathered: its segments are split by the distance of
start and anchor, which makes the keys longer, and in the end strings are their
own keys.  Nothing is dropped at any step.

A null text is empty.  Equal texts are one from the start, with their number as its
weight.  Texts move only where a table of runs asks for them, others are screened
out where they lie.  Texts shorter than ``length`` lose nothing.  Repeated rows get equal results.
Other columns are ignored or kept, whatever their names.  Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import ranges
from .common import Workspace, documents, lean, text_of, texts
from .screen import split_by
from .suffix_array import repeats

LENGTH, GRAM = 200, 32
#: Bytes that a bucket holds on average, few enough for the processor's caches, and distinct segments of a key that are gathered.
BUCKET_BYTES = 450_000
HOT = 900_000 // (LENGTH + 50)
#: Distances of start and anchor that one segment spans, from the first split to the last.
SPANS = (57, 8, 1)
#: Bytes of text that are hashed at a time: arrays of 8 bytes for each stay near the processor.
SLICE = 1 << 17
#: Equal segments that are strung together at most.
CHAIN = 64


def byte_words(data: np.ndarray) -> np.ndarray:
    """A hash, another for any other bytes, of the 8 bytes from each byte on."""
    n = max(0, len(data) - 7)
    h = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        own = len(h[k::8])
        h[k::8] = data[k : k + 8 * own].view(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` (8 times a power of two) bytes from each byte on, from those of 8."""
    h, m = words, 8
    while m < gram:
        mixed = h[:-m] * np.uint64(0xD6E8FEB86659FD93)
        mixed += h[m:]
        mixed ^= mixed >> np.uint64(32)
        h, m = mixed, 2 * m
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def window_min(keys: np.ndarray, width: int) -> np.ndarray:
    m, out = 1, keys
    while 2 * m <= width:
        out = np.minimum(out[:-m], out[m:])
        m *= 2
    rest = width - m
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Spans:
    """Hashes of any spans of some bytes: a polynomial of the mixed hashes of the 8 bytes at each place."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.power, self.inverse = _powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.power[:n], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
        h = (self.total[end - 7] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))).view(np.int64)


@lru_cache(1)
def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (base, pow(base, -1, 1 << 64)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _table(max(2 * SLICE, 1 << n.bit_length()))


def cells(spans: Spans, p: np.ndarray, n: np.ndarray, at: np.ndarray, span: int, length: int) -> tuple[np.ndarray, ...]:
    """(run, first start, starts, key, segment's hash) of the segments of runs of starts, by rising start.

    Starts of a segment have distances to the anchor between two multiples of ``span``.
    """
    high, low = (at - p) // span, (at - p - n + 1) // span
    which, down = ranges(low, high + 1)
    j = (high + low)[which] - down
    first = np.maximum(p[which], at[which] - j * span - span + 1)
    last = np.minimum((p + n)[which], at[which] - j * span + 1) - 1
    core = at[which] - j * span
    return which, first, last - first + 1, spans(core, core - span + 1 + length, j), spans(first, last + length, at[which] - first)


def anchors(held: list[bytes], length: int, gram: int, span: int) -> tuple[np.ndarray, ...]:
    """(text, starts, anchor's distance from the first, key, segment's hash) of each segment, by text and start."""
    data = np.frombuffer(b"".join(held), np.uint8)
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    ends = np.cumsum(sizes)
    begin, close = ends - sizes, ends - length + 1  # a text's starts are those from begin to before close
    if not (close > begin).any():
        return (np.zeros(0, np.int64),) * 5
    words = byte_words(data)
    gram = max(gram, 8)
    least = gram_hashes(words, gram)
    least &= np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(least), dtype=np.uint64)
    least = window_min(least, length - gram + 1)
    p = np.unique(np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, begin[close > begin], close[close > begin]]))
    n = np.diff(p, append=p[-1])
    o = np.searchsorted(begin, p, "right") - 1
    own = p < close[o]
    p, n, o = p[own], n[own], o[own]
    a = (least[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    which, lo, n, key, seg = cells(Spans(words), p, n, a, span, length)
    return o[which], n, a[which] - lo, key, seg


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def distinct_texts(docs: DataFrame, length: int, text_col: str, work: Workspace) -> DataFrame:
    """rid, tkey, w (how many rows have it), text (bytes) of each distinct text of ``length`` bytes or more."""
    rows = docs.select(text_of(f"`{text_col}`").cast("binary").alias("text")).filter(F.length("text") >= length).withColumn("tkey", text_key(F.col("text")))
    several = rows.groupBy("tkey").agg(F.count(F.lit(1)).alias("w")).filter("w > 1").select(F.xxhash64("tkey").alias("k"))
    alone, others = split_by(rows, F.xxhash64("tkey"), work.save(several, "copied"))
    found = others.groupBy("tkey").agg(F.count(F.lit(1)).alias("w"), F.first("text").alias("text"))
    if alone is not None:
        found = found.unionByName(alone.withColumn("w", F.lit(1).cast("long")))
    return work.save(found.withColumn("rid", F.monotonically_increasing_id()), "texts")


def scan(held: DataFrame, length: int, gram: int, span: int) -> DataFrame:
    """rid, w, and the text's segments by rising start as parallel lists: key, seg, n (starts), gap (to the anchor)."""

    def run(it):
        for batch in it:
            done = 0
            for _, own in texts(batch, "text", SLICE):
                o, n, gap, key, seg = anchors(own, length, gram, span)
                ends = pa.array(np.searchsorted(o, np.arange(len(own) + 1)).astype(np.int32))
                listed = lambda x, t: pa.ListArray.from_arrays(ends, pa.array(x, t))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(own)), batch.column(1).slice(done, len(own)), listed(key, pa.int64()), listed(seg, pa.int64()), listed(n.astype(np.int16), pa.int16()), listed(gap.astype(np.int16), pa.int16())], ["rid", "w", "key", "seg", "n", "gap"])
                done += len(own)

    return held.select("rid", "w", "text").mapInArrow(lean(run), "rid bigint, w bigint, key array<bigint>, seg array<bigint>, n array<smallint>, gap array<smallint>")


def split(rows: DataFrame, span: int, length: int) -> DataFrame:
    """key, seg, rid, w, lo, n, gap of the finer segments of ``rows``: rid, w, text and runs, an array of (lo, n, gap)."""

    def run(it):
        for batch in it:
            for rid, w, t, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data = np.frombuffer(t.as_buffer(), np.uint8)
                lo, n, gap = (np.array([r[c] for r in runs], np.int64) for c in ("lo", "n", "gap"))
                which, lo, n, key, seg = cells(Spans(byte_words(data)), lo, n, (at := lo + gap), span, length)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(seg), pa.array(np.full(len(key), rid)), pa.array(np.full(len(key), w)), pa.array(lo, pa.int32()), pa.array(n, pa.int16()), pa.array(at[which] - lo, pa.int16())], ["key", "seg", "rid", "w", "lo", "n", "gap"])

    return rows.mapInArrow(lean(run), "key bigint, seg bigint, rid bigint, w bigint, lo int, n smallint, gap smallint")


#: A string for the transform: the key that names its bucket, bytes, weight, and the segments that it has one after the other.
STRING = "gkey bigint, bytes binary, w bigint, keys array<bigint>, segs array<bigint>, ns array<int>"


def strings(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], ["gkey", "bytes", "w", "keys", "segs", "ns"])


def extract(rows: DataFrame, length: int) -> DataFrame:
    """Strings of the segments of ``rows``: rid, w, text and runs, an array of (key, seg, c, lo, n, rid2, lo2).

    A segment whose key has unlike ones (rid2 is null) is a string with its weight ``c``.  Others
    have a second place, and those that lie one after the other both here and there are one
    string; rid2, lo2 and size say where its second place's bytes are.
    """

    def run(it):
        for batch in it:
            held, far = [], []
            for t, runs in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                text = t.as_py()
                runs.sort(key=lambda r: r["lo"])
                at = 0
                while at < len(runs):
                    first = last = runs[at]
                    end = at + 1
                    if first["rid2"] is not None:
                        while end < len(runs) and end - at < CHAIN and (q := runs[end])["rid2"] == last["rid2"] and q["lo"] == last["lo"] + last["n"] and q["lo2"] == last["lo2"] + last["n"]:
                            last, end = q, end + 1
                    own = runs[at:end]
                    stop = last["lo"] + last["n"] - 1 + length
                    held.append((first["key"], text[first["lo"] : stop], first["c"] if first["rid2"] is None else 1, [r["key"] for r in own], [r["seg"] for r in own], [r["n"] for r in own]))
                    far.append((first["rid2"], first["lo2"], stop - first["lo"]))
                    at = end
            if held:
                rid2, lo2, size = zip(*far, strict=True)
                b = strings(held)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rid2, pa.int64()), pa.array(lo2, pa.int32()), pa.array(size, pa.int32())], [*b.schema.names, "rid2", "lo2", "size"])

    return rows.mapInArrow(lean(run), STRING + ", rid2 bigint, lo2 int, size int")


def second_places(rows: DataFrame) -> DataFrame:
    """Strings of the bytes at the second places: rid, w, text and runs, an array of (gkey, lo, size)."""

    def run(it):
        for batch in it:
            held = [(r["gkey"], t.as_py()[r["lo"] : r["lo"] + r["size"]], 1, [], [], []) for t, runs in zip(batch.column(2), batch.column(3).to_pylist(), strict=True) for r in runs]
            if held:
                yield strings(held)

    return rows.mapInArrow(lean(run), STRING)


def find(held: DataFrame, buckets: int, length: int) -> DataFrame:
    """key, seg, and the runs of starts in the segment that repeat: (first, last)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        hits = repeats([x.as_py() for x in table["bytes"]], table["w"].to_numpy(), length)
        out: tuple[list, ...] = ([], [], [], [])
        for h, keys, segs, ns in zip(hits, table["keys"].to_pylist(), table["segs"].to_pylist(), table["ns"].to_pylist(), strict=True):
            if not len(h) or not keys:
                continue
            base = 0
            whole = len(h) == sum(ns)
            for key, seg, n in zip(keys, segs, ns, strict=True):
                if whole:
                    first, last = [0], [n - 1]
                else:
                    own = h[np.searchsorted(h, base) : np.searchsorted(h, base + n)] - base
                    a = np.flatnonzero(np.r_[True, np.diff(own) > 1]) if len(own) else own
                    first, last = own[a].tolist(), own[np.r_[a[1:], len(own)] - 1].tolist() if len(own) else []
                base += n
                if first:
                    for c, v in zip(out, (key, seg, first, last), strict=True):
                        c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["key", "seg", "first", "last"])

    bucket = F.pmod(F.xxhash64("gkey"), F.lit(buckets)).alias("bucket")
    return held.select(bucket, "bytes", "w", "keys", "segs", "ns").groupBy("bucket").applyInArrow(lean(run), "key bigint, seg bigint, first array<int>, last array<int>")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text", hot: int = HOT) -> DataFrame:
    """tkey of the distinct texts that lose bytes, and ranges of bytes that go as parallel lists a, b; they may overlap."""
    work = Workspace(docs.sparkSession, "suffix-dedup")
    held = distinct_texts(docs, length, text_col, work)
    rows = work.save(scan(held, length, gram, SPANS[0]), "rows")

    def with_text(runs: DataFrame, fields: list[str]) -> DataFrame:
        """rid, w, text and runs of the texts that ``runs`` (rid and fields) are about; no others move."""
        lists = runs.groupBy("rid").agg(F.collect_list(F.struct(*fields)).alias("runs"))
        _, asked = split_by(held.select("rid", "w", "text"), F.col("rid"), runs.select("rid").distinct())
        return asked.join(lists, "rid").select("rid", "w", "text", "runs")

    shared = work.save(rows.select("w", F.explode("key").alias("key")).groupBy("key").agg(F.sum("w").alias("c")).filter("c > 1").select("key"), "shared")
    segs = unrolled(rows).join(shared, "key").select("key", "seg", "rid", "w", "lo", "n", "gap")
    parts = []
    for level in range(len(SPANS)):
        segs = work.save(segs, f"segments-{level}")
        if not level:
            work.drop("rows", "shared")
        place = F.struct("rid", "lo", "n")
        one = segs.groupBy("key", "seg").agg(F.sum("w").alias("c"), F.min(place).alias("at"), F.max(place).alias("to"))
        one = work.save(one, f"distinct-{level}")
        met = one.groupBy("key").agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("d")).filter("all > 1")
        last = level + 1 == len(SPANS)
        cool = one.join(met if last else met.filter(F.col("d") <= hot), "key")
        # Segments of equal texts alone: the texts are equal as a whole.
        equal = cool.filter("d = 1 AND at = to").select("key", "seg", F.array(F.lit(0)).alias("first"), F.array(F.col("at.n").cast("int") - 1).alias("last"))
        second = lambda c: F.when(F.col("d") == 1, F.col(f"to.{c}")).alias(f"{c}2")
        asked = cool.filter("d > 1 OR at <> to").select(F.col("at.rid").alias("rid"), "key", "seg", "c", F.col("at.lo").alias("lo"), F.col("at.n").alias("n"), second("rid"), second("lo"))
        own = work.save(extract(with_text(asked, ["key", "seg", "c", "lo", "n", "rid2", "lo2"]), length), f"first-{level}")
        there = own.filter("rid2 IS NOT NULL").select(F.col("rid2").alias("rid"), "gkey", F.col("lo2").alias("lo"), "size")
        there = work.save(second_places(with_text(there, ["gkey", "lo", "size"])), f"second-{level}")
        own = own.drop("rid2", "lo2", "size").unionByName(there)
        size = own.agg(F.sum(F.length("bytes") + 1)).first()[0] or 0
        found = work.save(find(own, max(1, -(-size // BUCKET_BYTES)), length).unionByName(equal), f"found-{level}")
        work.drop(f"first-{level}", f"second-{level}")
        parts.append(segs.join(found, ["key", "seg"]).select("rid", F.transform("first", lambda x: x + F.col("lo")).alias("a"), F.transform("last", lambda x: x + F.col("lo") + length).alias("b")))
        if last:
            break
        hot_keys = work.save(met.filter(F.col("d") > hot).select("key"), f"hot-{level}")
        if not hot_keys.limit(1).count():
            break
        segs = split(with_text(segs.join(hot_keys, "key"), ["lo", "n", "gap"]), SPANS[level + 1], length)
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    spans = spans.groupBy("rid").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"))
    return work.save(spans.join(held.select("rid", "tkey"), "rid").select("tkey", "a", "b"), "spans")


def unrolled(rows: DataFrame) -> DataFrame:
    """A row for each segment of the lists: rid, w, key, seg, lo, n, gap; a segment starts where those before it end."""

    def run(it):
        for batch in it:
            rid, w, key, seg, n, gap = batch.columns
            sizes = key.value_lengths().to_numpy(zero_copy_only=False)
            n, gap = n.flatten(), gap.flatten()
            count = n.to_numpy().astype(np.int64)
            before = np.cumsum(count) - count
            first = np.cumsum(sizes) - sizes
            base = before[np.minimum(first, max(0, len(before) - 1))] if len(before) else np.zeros(len(sizes), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rid.to_numpy(), sizes)), pa.array(np.repeat(w.to_numpy(), sizes)), key.flatten(), seg.flatten(), pa.array((before - np.repeat(base, sizes)).astype(np.int32)), n, gap], ["rid", "w", "key", "seg", "lo", "n", "gap"])

    return rows.select("rid", "w", "key", "seg", "n", "gap").mapInArrow(lean(run), "rid bigint, w bigint, key bigint, seg bigint, lo int, n smallint, gap smallint")


def merge(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges of the union of the ranges from a to b."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    return list(zip(a[first].tolist(), b[np.r_[first[1:], len(a)] - 1].tolist(), strict=True))


def removals(a: pa.ListArray, b: pa.ListArray) -> list[list[tuple[int, int]]]:
    """The maximal removed ranges of each row; none where the lists are null."""
    at, x, y = a.offsets.to_numpy(), a.values.to_numpy(), b.values.to_numpy()
    shift = b.offsets.to_numpy()
    return [merge(x[at[i] : at[i + 1]], y[shift[i] : shift[i + 1]]) if at[i + 1] > at[i] else [] for i in range(len(a))]


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def whole_characters(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges widened to the characters they touch."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        while a and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        if out and a <= out[-1][1]:
            a, b = out.pop()[0], b
        out.append((a, b))
    return out


def _screened(own: DataFrame, text: Column, spans: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(rows that surely lose nothing, the others with their bytes ``_text`` and the lists a, b, null if they lose nothing)."""
    place = F.xxhash64(text_key(text))
    alone, others = split_by(own, place, spans.select(F.xxhash64("tkey").alias("k")))
    others = others.withColumns({"_text": text.cast("binary"), "_tkey": text_key(text)})
    return alone, others.join(spans, F.col("_tkey") == F.col("tkey"), "left").drop("_tkey", "tkey")


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    spans = repeated(docs, length, gram, text_col, hot)

    def run(it):
        for batch in it:
            out = []
            for t, gone in zip(batch.column(1), removals(batch.column(2), batch.column(3)), strict=True):
                text = t.as_py()
                out.append((len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(without(text, gone)).hexdigest()))
            size, removed, count, sha = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    alone, others = _screened(own, F.col("text"), spans)
    found = others.select("doc_id", "_text", "a", "b").mapInArrow(lean(run), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    none = F.lit(0).cast("long")
    return found if alone is None else found.unionByName(alone.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")))


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``docs`` without the repeated bytes; characters that would be broken go whole."""
    spans = repeated(docs, length, gram, text_col, hot)
    mine = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()])
    kinds = {n: own.schema[n].dataType.simpleString() for n in mine.values()}

    def run(it):
        for batch in it:
            out = []
            for t, gone in zip(batch.column(batch.num_columns - 3), removals(*batch.columns[-2:]), strict=True):
                out.append(without(t.as_py(), whole_characters(t.as_py(), gone)).decode("utf-8", "replace") if gone else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(out, pa.string())], [*batch.schema.names[:-3], "_new"])

    alone, others = _screened(own, text_of(mine[text_col]), spans)
    rows = others.select(*mine.values(), "_text", "a", "b").mapInArrow(lean(run), ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", _new string")
    rows = rows.select(*[(F.coalesce("_new", n) if n == mine[text_col] else F.col(n)).alias(n) for n in mine.values()])
    return (rows if alone is None else rows.unionByName(alone)).select(*[F.col(n).alias(c) for c, n in mine.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
