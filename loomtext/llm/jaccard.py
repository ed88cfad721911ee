"""Similarity join of documents on word n-grams by vertical partitioning.

The global order of n-grams is cut twice.

By hash into as many fragments as the input asks for: a fragment's task meets every
set's members there, counts in how many sets each is, and sends on those that more
than one set has.  What comes back to a set is all that it can share with any other,
so a set that gets back fewer than the link needs links with nothing and is done
with.  The order of the others' members is by frequency (its binary logarithm, then the
hash), and of two sets that link one n-gram at least is among the rarest of both,
those that can be missing and one more.  Sets with such an n-gram in common are a group.

Then the pairs that groups give are counted: members go by hash to ``PARTS`` fragments,
in each of which the pairs' partial overlaps are counted separately, and the partial
overlaps of a pair are summed.

A group is not expanded into its pairs.  Its hub, the member with the least n-grams of
its own, is paired with each member; then members that are still in another component
are paired with members that the sizes, the n-grams of their own, the distances to the
hub (a metric) and the parities of fine fragments allow, first one for each component
within reach, then what is left.  Pairs already connected are skipped, so all links are
found or implied.

N-grams that a slice of a task's rows has in ``HEAVY`` sets or more are known to be
frequent there and then: they come last in the order, and a slice sends on ``HEAVY - 1``
sets at most of any other, so that no n-gram, however common, gathers in one task.

N-grams are told apart by 64-bit hashes, sets by 96 bits.  Rows with fewer words than
``words`` are one n-gram of all their words; null or empty texts have no n-grams and link
with nothing.  Equal sets are one; repeated rows are equal sets.  A null id never names a
component that has another.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import ranges
from .common import BoundedCache, Workspace, documents, lean, text_of, texts
from .graph import components
from .screen import split_by

WORDS, PERCENT = 3, 90
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: N-grams that a task holds at a time: of a fragment, of a slice of its rows (8 bytes each; more ask for more memory of workers).
HELD, SLICE = 2_000_000, 1_000_000
#: Sets of a slice from which an n-gram counts as frequent.
HEAVY = 24
#: Rank of frequent n-grams in the global order; others have the logarithm of their frequency.
LAST = 255
#: Fragments in which pairs are counted.
PARTS = 16
HEAD = np.dtype([("a", "<u8"), ("b", "<u4"), ("n", "<u4"), ("c", "<u4")])


class Shingles:
    """The sorted distinct n-gram hashes of a text."""

    def __init__(self, words: int):
        self.words = words
        self.hashes = BoundedCache(xxhash.xxh3_64_intdigest)

    def __call__(self, text: bytes) -> np.ndarray:
        own = text.translate(LOWER).split()  # ASCII white space, as the contract has it
        h = np.fromiter(map(self.hashes.__getitem__, own), np.uint64, len(own))
        n = self.words if len(h) >= self.words else len(h)
        if not n:
            return h
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - n + 1 + k]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return np.unique(out ^ (out >> np.uint64(31)))


def fragment_of(grams: np.ndarray, fragments: int) -> np.ndarray:
    """The fragment of each n-gram: equal ranges of the order of hashes."""
    return ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal values."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(x)])


def packed(owner: np.ndarray, grams: np.ndarray, heads: np.ndarray) -> tuple[bytes, bytes]:
    """(heads with the number of their n-grams, n-grams) of members given by rising owner."""
    first, count = runs(owner)
    own = heads[owner[first]]
    own["c"] = count
    return own.tobytes(), grams.tobytes()


def least_overlap(n, percent: int):
    """Members that a set of ``n`` shares with any that it links with: at least so many."""
    return -(-n * percent // 100)


def linked(inter, total, percent: int):
    """100 * intersection >= percent * union, ``total`` being the sum of both sizes."""
    return (100 + percent) * inter >= percent * total


def cut(docs: DataFrame, words: int, fragments: int, id_col: str, text_col: str) -> DataFrame:
    """What goes to each fragment.

    kind 0: sets' members there (heads, grams); 1: frequent members, which need no counting
    (to any fragment); 2: n-grams that are frequent somewhere (grams); 3: a row's id, n and set.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    bare = {"heads": pa.binary(), "grams": pa.binary(), "n": pa.int64(), "set": pa.binary()}

    def send(frag, kinds, id_type, **cols):
        n = len(frag)
        made = {"frag": pa.array(frag, pa.int32()), "kind": pa.array([kinds] * n, pa.int8()), "id": cols.get("id", pa.nulls(n, id_type))}
        return pa.RecordBatch.from_pydict(made | {k: pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in bare.items()})

    def slices(held: dict, id_type):
        """The members of a slice's distinct sets, fragment by fragment."""
        heads = np.frombuffer(b"".join(held), np.dtype([("a", "<u8"), ("b", "<u4")]))
        heads = np.rec.fromarrays([heads["a"], heads["b"], [len(g) for g in held.values()], np.zeros(len(heads))], dtype=HEAD)
        owner = np.repeat(np.arange(len(heads), dtype=np.int32), heads["n"])
        grams = np.concatenate(list(held.values()))
        order = np.argsort(grams, kind="stable")  # owners rise among equal n-grams
        grams, owner = grams[order], owner[order]
        first, count = runs(grams)
        frequent = np.repeat(count >= HEAVY, count)
        borders = lambda g: np.searchsorted(fragment_of(g, fragments), np.arange(fragments + 1))
        out: dict[int, list] = {0: [], 1: [], 2: []}
        at = borders(marks := grams[first[count >= HEAVY]])
        out[2] = [(f, None, marks[x:y].tobytes()) for f, (x, y) in enumerate(zip(at, at[1:], strict=False)) if y > x]
        if frequent.any():
            g, o = grams[frequent], owner[frequent]
            by = np.argsort(o, kind="stable")
            out[1] = [(int(heads["b"][0]), *packed(o[by], g[by], heads))]
        g, o = grams[~frequent], owner[~frequent]
        at = borders(g)
        for f, (x, y) in enumerate(zip(at, at[1:], strict=False)):
            if y > x:
                by = np.argsort(o[x:y], kind="stable")
                out[0].append((f, *packed(o[x:y][by], g[x:y][by], heads)))
        for k, rows in out.items():
            for i in range(0, len(rows), 256):
                frag, h, g = zip(*rows[i : i + 256], strict=True)
                yield send([f % fragments for f in frag], k, id_type, heads=h, grams=g)

    def run(it):
        shingles, held, size, at = Shingles(words), {}, 0, 0
        id_type = None
        for batch in it:
            done, id_type = 0, batch.column(0).type
            for _, own in texts(batch, "text"):
                n, names = [], []
                for t in own:
                    g = shingles(t)
                    n.append(len(g))
                    names.append(xxhash.xxh3_128_digest(g.tobytes())[:12] if len(g) else None)
                    if len(g) and names[-1] not in held:
                        held[names[-1]] = g
                        size += len(g)
                    if size >= SLICE:
                        yield from slices(held, id_type)
                        held, size = {}, 0
                yield send([(at + i) % fragments for i in range(len(own))], 3, id_type, id=batch.column(0).slice(done, len(own)), n=n, set=names)
                done, at = done + len(own), at + len(own)
        if held:
            yield from slices(held, id_type)

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"frag int, kind tinyint, id {kind}, heads binary, grams binary, n bigint, set binary")


def unpack(table: pa.Table, **columns) -> list[np.ndarray]:
    """The bytes of the named columns, all rows one after the other, as arrays of the types given."""
    out = []
    for name, kind in columns.items():
        parts = []
        for chunk in table[name].chunks:
            chunk = chunk.drop_null()
            if len(chunk):
                ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
                parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]])
        out.append((np.concatenate(parts) if len(parts) != 1 else parts[0].copy()).view(kind) if parts else np.zeros(0, kind))
    return out


def distinct_sets(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct heads, for each head its place among them)."""
    order = np.lexsort((heads["b"], heads["a"]))
    held = heads[order]
    new = np.r_[True, (held["a"][1:] != held["a"][:-1]) | (held["b"][1:] != held["b"][:-1])] if len(held) else np.zeros(0, bool)
    place = np.empty(len(heads), np.int32)
    place[order] = np.cumsum(new) - 1
    return held[new], place


def count_fragments(pieces: DataFrame, buckets: int) -> DataFrame:
    """Of each fragment the members that several sets have, by bucket of sets, with their rank; rows' ids, n and set as they are."""
    names = [("bucket", pa.int32()), ("heads", pa.binary()), ("grams", pa.binary()), ("ranks", pa.binary()), ("n", pa.int64()), ("set", pa.binary())]

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        rows = table.filter(pa.array(kind == 3))
        out = [pa.table({k: rows[k] if k in ("n", "set") else pa.nulls(rows.num_rows, t) for k, t in names} | {"id": rows["id"]})]
        for k in (0, 1):
            part = table.filter(pa.array(kind == k))
            if not part.num_rows:
                continue
            heads, grams = unpack(part, heads=HEAD, grams=np.uint64)
            del part
            sets, place = distinct_sets(heads)
            owner = np.repeat(place, heads["c"])
            del heads, place
            if k:
                rank = np.full(len(grams), LAST, np.uint8)
            else:
                by = np.argsort(owner, kind="stable")
                grams, owner = grams[by], owner[by]
                by = np.argsort(grams, kind="stable")
                grams, owner = grams[by], owner[by]
                again = np.r_[False, (grams[1:] == grams[:-1]) & (owner[1:] == owner[:-1])]  # copies that came from other tasks
                grams, owner = grams[~again], owner[~again]
                del by, again
                first, count = runs(grams)
                marks = np.unique(*unpack(table.filter(pa.array(kind == 2)), grams=np.uint64))
                level = np.where(np.isin(grams[first], marks), LAST, np.log2(count).astype(np.int64)).astype(np.uint8)
                rank, shared = np.repeat(level, count), np.repeat((count > 1) | (level == LAST), count)
                grams, owner, rank = grams[shared], owner[shared], rank[shared]
                del first, count, level, shared
            bucket = (sets["a"] % np.uint64(buckets)).astype(np.int64)[owner]
            by = np.lexsort((owner, bucket))
            grams, owner, rank, bucket = grams[by], owner[by], rank[by], bucket[by]
            first, count = runs(bucket)
            blobs = [(int(bucket[x]), *packed(owner[x : x + c], grams[x : x + c], sets), rank[x : x + c].tobytes()) for x, c in zip(first, count, strict=True)]
            cols = list(zip(*blobs, strict=True)) if blobs else [()] * 4
            n = len(blobs)
            out.append(pa.table({"bucket": pa.array(cols[0], pa.int32()), "heads": pa.array(cols[1], pa.binary()), "grams": pa.array(cols[2], pa.binary()), "ranks": pa.array(cols[3], pa.binary()), "n": pa.nulls(n, pa.int64()), "set": pa.nulls(n, pa.binary()), "id": pa.nulls(n, table["id"].type)}))
        return pa.concat_tables(out)

    kind = pieces.schema["id"].dataType.simpleString()
    return pieces.groupBy("frag").applyInArrow(lean(run), f"bucket int, heads binary, grams binary, ranks binary, n bigint, set binary, id {kind}")


def bounds(grams: np.ndarray) -> np.ndarray:
    """The parities of the numbers of members in fine fragments, at least two for each member, in words of 64.

    The finest bits of a fragment's place in the order name the word, so that half as
    many fragments are the words of each two neighbours, combined by exclusive or.
    """
    words = 1
    while 64 * words < 2 * len(grams):
        words *= 2
    at = fragment_of(grams, 64 * words)
    at = at % words * 64 + at // words
    odd = (np.bincount(at, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def gather(shared: DataFrame, percent: int) -> DataFrame:
    """The sets that can link with any: set, n, own (members no other has), the rest in the global order, its rarest part, parities."""
    schema = "set binary, n bigint, own bigint, grams binary, rare array<bigint>, bounds array<bigint>"

    def run(table: pa.Table) -> pa.Table:
        heads, grams, rank = unpack(table, heads=HEAD, grams=np.uint64, ranks=np.uint8)
        sets, place = distinct_sets(heads)
        owner = np.repeat(place, heads["c"])
        by = np.lexsort((grams, rank, owner))
        grams, owner, rank = grams[by], owner[by], rank[by]
        again = np.r_[False, (grams[1:] == grams[:-1]) & (owner[1:] == owner[:-1])]
        grams, owner = grams[~again], owner[~again]
        got = np.bincount(owner, minlength=len(sets))
        n = sets["n"].astype(np.int64)
        need = least_overlap(n, percent)
        start = np.cumsum(got) - got
        out = []
        for i in np.flatnonzero(got >= need).tolist():
            g = grams[start[i] : start[i] + got[i]]
            out.append((sets["a"][i].tobytes() + sets["b"][i].tobytes(), n[i], n[i] - got[i], g.tobytes(), g[: got[i] - need[i] + 1].view(np.int64), bounds(g)))
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("set", "n", "own", "grams", "rare", "bounds"), cols, kinds, strict=True)})

    return shared.filter("bucket IS NOT NULL").select("bucket", "heads", "grams", "ranks").groupBy("bucket").applyInArrow(lean(run), schema)


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, total) with inter, the sum of the partial overlaps of all fragments; pairs without any are left out.

    A fragment's task has a block of the pairs (by ``b``, so that no hub's pairs meet in one
    task), and of each set in them its members there.
    """
    size = pairs.join(sets.select(F.col("node").alias("b"), (F.length("grams") / 4).alias("size")), "b").agg(F.sum("size")).first()[0] or 0
    blocks = max(1, -(-int(size) // (PARTS * HELD)))
    block = F.pmod(F.xxhash64("b"), F.lit(blocks)).cast("int").alias("block")
    wanted = pairs.select(F.col("b").alias("node"), block).unionByName(pairs.select(F.col("a").alias("node"), block)).distinct()

    def split(it):
        for batch in it:
            rows: list[tuple] = []
            for node, at, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                g = np.sort(np.frombuffer(g.as_buffer(), np.uint64))
                cuts = np.searchsorted(fragment_of(g, PARTS), np.arange(PARTS + 1))
                rows += [(f, at, node, g[x:y].tobytes()) for f, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "block", "node", "grams"])

    pieces = sets.select("node", "grams").join(wanted, "node").select("node", "block", "grams").mapInArrow(lean(split), "part int, block int, node bigint, grams binary")
    asked = pairs.select(F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), block, "a", "b")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "inter": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        nodes = left["node"].to_numpy()
        sizes = np.fromiter((len(x.as_buffer()) // 8 for x in left["grams"]), np.int64, len(nodes))
        grams = np.frombuffer(b"".join(x.as_py() for x in left["grams"]), np.uint64)
        names, ids = np.unique(grams, return_inverse=True)
        start, order = np.cumsum(sizes) - sizes, np.argsort(nodes, kind="stable")
        held = nodes[order]
        a, b = right["a"].to_numpy(), right["b"].to_numpy()
        at = [np.minimum(np.searchsorted(held, x), len(held) - 1) for x in (a, b)]
        both = (held[at[0]] == a) & (held[at[1]] == b)
        a, b, (x, y) = a[both], b[both], (order[p[both]] for p in at)
        inter = np.zeros(len(a), np.int64)
        ends = np.cumsum(sizes[x] + sizes[y]) // HELD
        for at in np.split(np.arange(len(a)), np.flatnonzero(np.diff(ends)) + 1):
            if not len(at):
                continue
            keys = []
            for p in (x[at], y[at]):
                which, member = ranges(start[p], start[p] + sizes[p])
                keys.append(which * np.int64(len(names)) + ids[member])
            keys = np.sort(np.concatenate(keys))
            inter[at] = np.bincount(keys[1:][keys[1:] == keys[:-1]] // len(names), minlength=len(at))
        some = inter > 0
        return pa.table({"a": pa.array(a[some]), "b": pa.array(b[some]), "inter": pa.array(inter[some])})

    partial = pieces.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(lean(count), "a bigint, b bigint, inter bigint")
    return pairs.join(partial.groupBy("a", "b").agg(F.sum("inter").alias("inter")), ["a", "b"]).select("a", "b", "total", "inter")


def least_apart(a: str, b: str) -> Column:
    """At least so many members are in one of two sets only: their own, and one for each fine fragment whose parities differ."""
    x, y = F.col(f"bounds{a}"), F.col(f"bounds{b}")
    halved = lambda fine, coarse: F.transform(coarse, lambda v, i: v.bitwiseXOR(fine[2 * i]).bitwiseXOR(fine[2 * i + 1]))
    apart = F.when(F.size(x) == F.size(y), F.zip_with(x, y, lambda v, w: v.bitwiseXOR(w))).when(F.size(x) == 2 * F.size(y), halved(x, y)).when(F.size(y) == 2 * F.size(x), halved(y, x)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(apart, F.lit(0), lambda s, v: s + F.bit_count(v)) + F.col(f"own{a}") + F.col(f"own{b}")


def in_reach(a: str, b: str, percent: int) -> Column:
    """Whether two sets may link by their sizes and their own members alone."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & ((F.col(f"own{a}") + F.col(f"own{b}")) * (100 + percent) <= (n + m) * (100 - percent))


def hubs(sets: DataFrame, work: Workspace) -> DataFrame:
    """key, node, n, own, hub (own's share, node, n, own) of each set of each group of two or more."""
    rows = sets.select(F.explode("rare").alias("key"), "node", "n", "own")
    groups = rows.groupBy("key").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "node", "n", "own")).alias("hub"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return work.save(rows.join(groups, "key"), "groups")


def star(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of a group's hub and its other members that may link."""
    pairs = groups.filter("node <> hub.node").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"), F.col("hub.own").alias("owna"), F.col("own").alias("ownb")).filter(in_reach("a", "b", percent)).distinct()
    held = lambda s: sets.select(F.col("node").alias(s), F.col("bounds").alias(f"bounds{s}"))
    total = F.col("na") + F.col("nb")
    return pairs.join(held("a"), "a").join(held("b"), "b").filter(least_apart("a", "b") * (100 + percent) <= total * (100 - percent)).select("a", "b", total.alias("total"))


def across(groups: DataFrame, sets: DataFrame, counted: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, total, apart, root: b's) of a group's members in different components that may link and are not counted yet.

    One of the two at least is not linked with the hub: the others are in the hub's component.
    """
    far = counted.select(F.col("a").alias("h"), F.col("b").alias("node"), (F.lit(1.0) - F.col("inter") / (F.col("total") - F.col("inter"))).alias("far"))
    rows = groups.withColumn("h", F.col("hub.node")).join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    rows = rows.filter("node <> h").join(split, "key", "left_semi").join(far, ["h", "node"], "left").join(sets.select("node", "bounds"), "node")
    hub = labels.select(F.col("node").alias("h"), F.col("root").alias("hroot"))
    rows = rows.join(hub, "h", "left").select("key", "node", "n", "own", "root", "far", "bounds", (F.col("root") != F.coalesce("hroot", "h")).alias("out"))
    side = lambda s: rows.select("key", *[F.col(c).alias(c + s) for c in ("node", "n", "own", "root", "far", "bounds", "out")])
    a, b = side("a").filter("outa"), side("b")
    near = F.coalesce(F.abs(F.col("fara") - F.col("farb")) <= (100 - percent) / 100 + 1e-9, F.lit(True))
    once = ~F.col("outb") | (F.col("nodea") < F.col("nodeb"))
    total = F.col("na") + F.col("nb")
    apart = least_apart("a", "b")
    pairs = a.join(b, (a.key == b.key) & (F.col("roota") != F.col("rootb")) & once & in_reach("a", "b", percent) & near & (apart * (100 + percent) <= total * (100 - percent)))
    pairs = pairs.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b"), F.col("nodea").alias("x"), F.col("rootb").alias("root"), total.alias("total"), apart.alias("apart")).dropDuplicates(["a", "b"])
    seen = counted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(seen, ["a", "b"], "left_anti")


def classed(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, Workspace]:
    """(id, n, set of each row; set, top, component_id of each set): ``top`` alone tells components apart, as ids may repeat."""
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    fragments = max(-(-size // (6 * HELD)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = work.save(count_fragments(cut(docs, words, fragments, id_col, text_col), fragments), "shared")
    rows = work.save(shared.filter("bucket IS NULL").select("id", "n", "set"), "rows")
    sets = work.save(gather(shared, percent).withColumn("node", F.monotonically_increasing_id()), "sets")
    work.drop("shared")
    groups = hubs(sets, work)
    counted = work.save(overlaps(work.save(star(groups, sets, percent), "star"), sets), "counted-star")
    links = lambda df: df.filter(linked(F.col("inter"), F.col("total"), percent)).select("a", "b")
    labels = components(links(counted), work, "labels-star")
    for i in range(2):
        pairs = work.save(across(groups, sets, counted, labels, percent), f"across-{i}")
        if not i:  # one pair, the likeliest, for each component within reach of a set
            pairs = work.save(pairs.groupBy("x", "root").agg(F.min(F.struct("apart", "a", "b", "total")).alias("m")).select("m.a", "m.b", "m.total").distinct(), "likely")
        counted = work.save(counted.unionByName(overlaps(pairs.select("a", "b", "total"), sets)), f"counted-{i}")
        labels = components(links(counted), work, f"labels-{i}")
    # Copies are rows of one set; sets that link with nothing are components of their own.
    own = rows.filter("n > 0").groupBy("set").agg(F.min("id").alias("id"))
    told = own.join(sets.select("set", "node").join(labels, "node", "left").select("set", F.coalesce("root", "node").alias("top")), "set", "left")
    named = told.filter("top IS NOT NULL").groupBy("top").agg(F.min("id").alias("component_id"))
    alone = told.filter("top IS NULL").select("set", "top", F.col("id").alias("component_id"))
    told = told.filter("top IS NOT NULL").join(named, "top").select("set", "top", "component_id").unionByName(alone)
    return rows, work.save(told, "classes"), work


def resolve(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, set, component_id of each row of ``docs``."""
    rows, classes, _ = classed(docs, words, percent, id_col, text_col)
    return rows.filter("n > 0").join(classes, "set").select("id", "n", "set", "component_id").unionByName(rows.filter("n = 0").withColumn("component_id", F.col("id")).select("id", "n", "set", "component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id, with the columns of ``docs``, whatever their names.

    A null id comes after all others, and of rows of a component that share the smallest id one
    stays.  Rows of other components stay whatever their ids, and so do all without n-grams.
    Rows that are surely alone in their component stay where they lie.
    """
    mine = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()])
    key, text = F.col(mine[id_col]), text_of(mine[text_col])
    # 128 bits that stand for a row's id, null among them, and text.
    digest = F.unhex(F.md5(F.concat(F.md5(text.cast("binary")), F.coalesce(F.concat(F.lit("i"), key.cast("string")), F.lit(""))).cast("binary")))
    rows, classes, work = classed(own.select(F.struct(key.isNull().alias("none"), key.alias("id"), digest.alias("digest")).alias("id"), text.alias("text")), words, percent, "id", "text")
    held = work.save(rows.filter("n > 0").join(classes, "set").select("id.digest", F.col("component_id.digest").alias("best")), "kept")
    several = held.groupBy("best").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    several = held.join(several, "best", "left_semi").select(F.xxhash64("digest").alias("place")).distinct()
    bare = F.translate(text, " \t\n\x0b\x0c\r", "") == ""
    alone, others = split_by(own.filter(~bare), F.xxhash64(digest), several)
    others = others.withColumn("_digest", digest).join(held.select(F.col("best").alias("_digest")).distinct(), "_digest", "left_semi").dropDuplicates(["_digest"]).drop("_digest")
    out = own.filter(bare).unionByName(others)
    return (out if alone is None else out.unionByName(alone)).select(*[F.col(n).alias(c) for c, n in mine.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS s FROM words),
classes AS (SELECT min(doc_id) AS id, any_value(s) AS s, h FROM (SELECT doc_id, list_sort(s) AS s, md5(array_to_string(list_sort(s), chr(10))) AS h FROM sets WHERE len(s) > 0) GROUP BY h),
grams AS (SELECT id, len(s) AS n, unnest(s) AS g FROM classes),
df AS (SELECT g, count(*) AS df FROM grams GROUP BY g),
ranked AS (SELECT id, n, g, row_number() OVER (PARTITION BY id ORDER BY df, g) AS r FROM grams JOIN df USING (g)),
prefix AS (SELECT id, n, g FROM ranked WHERE r <= n - ceil(0.9 * n) + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.g = b.g AND a.id < b.id AND least(a.n, b.n) * 10 >= greatest(a.n, b.n) * 9),
counted AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS t FROM pairs JOIN classes x ON x.id = a JOIN classes y ON y.id = b),
links AS (SELECT a, b FROM counted WHERE 190 * i >= 90 * t UNION SELECT b, a FROM counted WHERE 190 * i >= 90 * t),
reach(id, other) AS (SELECT id, id FROM classes UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
least_id AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN classes ON len(sets.s) > 0 AND classes.h = md5(array_to_string(list_sort(sets.s), chr(10))) LEFT JOIN least_id USING (id)
"""
