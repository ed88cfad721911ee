"""Phrase collocations by frequent n-grams, mined in partitions of pivot words.

Words of each language are ordered by frequency.  An n-gram belongs to its rarest word, the
pivot, at the first place where it has it.  For every place of a text the fragment around
it is cut out in which no word is rarer than the word there, at most ``longest - 1`` words
to either side and up to an infrequent word or the end of the piece; it is routed to a
bucket of its pivot.  A bucket counts those n-grams of its fragments that hold the pivot's
place, so each occurrence is counted once and all of an n-gram's occurrences meet.

Fragments travel as numbers: the ``known`` most frequent words of all (a bound on what is
broadcast) are numbered by frequency, and where there are more frequent words than that,
the others are rarer than all of these, ordered by their bytes, and travel as text.  Equal
fragments are counted before they move, and a row holds all fragments of a task for a
bucket.  A pivot with more than ``SPLIT`` occurrences is dealt to several buckets by its
fragments' hashes; their counts are added afterwards.

``collocations`` scores a phrase of 2 to ``longest`` words with ``a >= least`` occurrences by
its weakest cut, ``2000000 * a // (l + r)`` where l and r are the occurrences of both sides
(ties to the first cut), and drops phrases inside a longer one with at least ``covered``
percent of their occurrences.  Arithmetic is exact (decimals).

Texts are read whole and A-Z lower-cased; a null or empty text has no words, a null
language is ``und`` (as is that word itself).  Repeated rows count again; ids and other
columns are not looked at.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, documents, lean, lowered, texts, tokens

LEAST, LONGEST, COVERED, TOP = 30, 4, 80, 2000
#: Words that are broadcast at most: some 20 MB.
KNOWN = 1 << 20
#: Occurrences that a bucket is meant for.
SPLIT = 500_000
#: Fragments that a task gathers before it sends them.
HELD = 1_000_000
#: Bytes of text that are taken apart at a time, cut between pieces.
BLOCK = 8 << 20
#: Where words without a number begin.
OTHER = 1 << 31
#: Buckets that single words, and a language's phrases, are dealt to, as one may have a third of the rows.
SALTS = 16
CHARS = lowered(b" \t", b".,;:!?\n\x0b\x0c\r")


def _blocks(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > BLOCK:
        end = data.rfind(b"\n", at, at + BLOCK)
        end = end if end > at else data.find(b"\n", at + BLOCK)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def _words(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(language, words with a line feed between pieces) of slices of a batch (lang, text)."""
    for lang in pc.unique(batch["lang"]).to_pylist():
        own = batch.filter(pc.equal(batch["lang"], lang))
        for _, held in texts(own, "text"):
            for block in _blocks(b"\n".join(held).translate(CHARS)):
                yield lang, tokens(block)


def _source(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))


def count_words(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of ``rows`` (lang, text)."""

    def count(it):
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])

        for batch in it:
            for lang, words in _words(batch):
                if len(words):
                    coded = words.dictionary_encode()
                    n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                    table = pa.table({"lang": pa.array([lang] * len(n), pa.string()), "word": coded.dictionary.cast(pa.large_string()), "n": pa.array(n, pa.int64())})
                    held.append(table.filter(pc.not_equal(table["word"], "\n")))
            if sum(t.num_rows for t in held) > 500_000:
                held = [merged()]
                if held[0].num_rows > 250_000:
                    yield from _sent(held.pop())
        if held:
            yield from _sent(merged())

    def _sent(table: pa.Table):
        return table.cast(pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])).to_batches(8192)

    return rows.mapInArrow(lean(count), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words of each language, numbered from the most frequent on."""

    def __init__(self, table: pa.Table, whole: bool, buckets: int):
        self.whole, self.buckets = whole, buckets
        self.words: dict[str, pa.Array] = {}
        self.counts: dict[str, np.ndarray] = {}
        for lang in pc.unique(table["lang"]).to_pylist():
            own = table.filter(pc.equal(table["lang"], lang))
            self.words[lang], self.counts[lang] = own["word"].combine_chunks().cast(pa.large_binary()), own["n"].to_numpy()

    def number(self, lang: str, words: pa.Array) -> pa.Array:
        """The words' numbers, null for those without one."""
        return pc.index_in(words, value_set=self.words.get(lang, pa.array([], pa.large_binary())))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h = _mix(h + rows[:, c].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c + 1))
    return h


def fragments(ids: np.ndarray, order: np.ndarray, reach: int) -> np.ndarray:
    """A row (left words, pivot, right words) of ``ids`` + 1, 0 where there is none, for each place with a neighbour that is not rarer.

    ``order`` is larger for more frequent words, 0 where fragments end.
    """
    n = len(ids)
    wide = np.concatenate([np.zeros(reach, order.dtype), order, np.zeros(reach, order.dtype)])
    near = np.concatenate([np.zeros(reach, np.int64), ids + 1, np.zeros(reach, np.int64)])
    out = np.zeros((n, 2 * reach + 1), np.int64)
    out[:, reach] = ids + 1
    for side, beats in ((-1, np.greater), (1, np.greater_equal)):
        on = order > 0
        for k in range(1, reach + 1):
            at = slice(reach + side * k, reach + side * k + n)
            on = on & beats(wide[at], order)
            out[:, reach + side * k] = np.where(on, near[at], 0)
    return out[(order > 0) & ((out[:, reach - 1] > 0) | (out[:, reach + 1] > 0))]


class _Sender:
    """A task's fragments of one language until they are sent."""

    def __init__(self, lang: str, vocabulary: Vocabulary, reach: int):
        self.lang, self.vocabulary, self.reach = lang, vocabulary, reach
        self.rows: list[np.ndarray] = []
        self.others: dict[bytes, int] = {}
        self.n = 0

    def add(self, words: pa.Array) -> None:
        coded = words.dictionary_encode()
        own, v = coded.dictionary, self.vocabulary
        number = pc.fill_null(v.number(self.lang, own), -1).to_numpy().astype(np.int64)
        order = np.where(number >= 0, OTHER + len(v.counts.get(self.lang, ())) - number, 0)
        if not v.whole:
            free = [(w, i) for i, w in enumerate(own.to_pylist()) if number[i] < 0 and w != b"\n"]
            for rank, (w, i) in enumerate(sorted(free), 1):
                number[i], order[i] = OTHER + self.others.setdefault(w, len(self.others)), rank
        at = coded.indices.to_numpy()
        self.rows.append(fragments(number[at], order[at], self.reach).astype(np.uint32))
        self.n += len(self.rows[-1])

    def send(self) -> Iterator[dict]:
        """Rows (lang, bucket, part, fragments, counts, others), a row for each bucket and part."""
        rows = np.concatenate(self.rows) if self.rows else np.zeros((0, 2 * self.reach + 1), np.uint32)
        others = list(self.others)
        self.rows, self.others, self.n = [], {}, 0
        if not len(rows):
            return
        h, pivot = _hash(rows), rows[:, self.reach].astype(np.int64) - 1
        counts = np.append(self.vocabulary.counts.get(self.lang, np.zeros(0, np.int64)), 0)
        deals = np.maximum(1, -(-counts[np.where(pivot < OTHER, pivot, -1)] // SPLIT)).astype(np.uint64)
        name = np.array([_name(w) for w in others] or [0], np.uint64)
        name = np.where(pivot < OTHER, pivot.astype(np.uint64), name[np.where(pivot < OTHER, 0, pivot - OTHER)])
        bucket = (_mix(_mix(name + np.uint64(_name(self.lang.encode()))) + h % deals) % np.uint64(self.vocabulary.buckets)).astype(np.int64)
        to = bucket * 2 + (deals > 1)
        at = np.lexsort((h, pivot, to))
        rows, to = rows[at], to[at]
        new = np.append(True, (rows[1:] != rows[:-1]).any(1) | (to[1:] != to[:-1]))
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(rows))).astype(np.uint32)
        rows, to = rows[first], to[first]
        press = zstandard.ZstdCompressor(3).compress
        edges = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(to)), strict=True):
            own = rows[a:b]
            used = np.unique(own[own > OTHER])
            if len(used):
                own = np.where(own > OTHER, OTHER + 1 + np.searchsorted(used, own), own).astype(np.uint32)
            yield {"lang": self.lang, "bucket": int(to[a]) // 2, "part": bool(to[a] % 2), "fragments": press(np.ascontiguousarray(own.T).tobytes()), "counts": press(counts[a:b].tobytes()), "others": [others[i - OTHER - 1].decode() for i in used.tolist()]}


def _name(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


SENT = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("part", pa.bool_()), ("fragments", pa.binary()), ("counts", pa.binary()), ("others", pa.list_(pa.string()))])


def route(rows: DataFrame, vocabulary, longest: int = LONGEST) -> DataFrame:
    """The fragments of ``rows`` (lang, text), a row for each task, bucket and part; ``vocabulary`` is a broadcast."""

    def cut(it):
        senders: dict[str, _Sender] = {}
        for batch in it:
            for lang, words in _words(batch):
                if lang not in senders:
                    senders[lang] = _Sender(lang, vocabulary.value, longest - 1)
                senders[lang].add(words)
                if sum(s.n for s in senders.values()) > HELD:
                    yield from sent(senders)
        yield from sent(senders)

    def sent(senders):
        for s in senders.values():
            held, size = [], 0
            for r in s.send():
                held.append(r)
                size += len(r["fragments"])
                if len(held) == 1000 or size > 16 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=SENT)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=SENT)

    return rows.mapInArrow(lean(cut), "lang string, bucket bigint, part boolean, fragments binary, counts binary, others array<string>")


def ngrams(rows: np.ndarray, counts: np.ndarray, reach: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of ``size`` words that hold the pivot's place, and how often each occurs."""
    found, n = [], []
    for left in range(max(0, size - 1 - reach), min(reach, size - 1) + 1):
        a, b = reach - left, reach - left + size
        ok = (rows[:, a] > 0) & (rows[:, b - 1] > 0)
        found.append(rows[ok, a:b])
        n.append(counts[ok])
    rows, counts = np.concatenate(found), np.concatenate(n)
    if not len(rows):
        return rows, counts
    at = np.lexsort(rows.T)
    rows, counts = rows[at], counts[at]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(1)))
    return rows[first], np.add.reduceat(counts, first)


def mine(sent: DataFrame, vocabulary, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, size, a) of the n-grams of 2 to ``longest`` words that occur ``least`` times, from their pivots' fragments."""
    reach = longest - 1

    def count(table: pa.Table) -> pa.Table:
        v, open_ = vocabulary.value, zstandard.ZstdDecompressor().decompress
        held: dict[tuple[str, bool], tuple[list, list, dict]] = {}
        for r in table.to_pylist():
            rows, counts, others = held.setdefault((r["lang"], r["part"]), ([], [], {}))
            own = np.frombuffer(open_(r["fragments"]), np.uint32).reshape(2 * reach + 1, -1).T
            if r["others"]:
                to = np.array([OTHER + 1 + others.setdefault(w, len(others)) for w in r["others"]], np.uint32)
                own = np.where(own > OTHER, to[np.where(own > OTHER, own - OTHER - 1, 0)], own)
            rows.append(own)
            counts.append(np.frombuffer(open_(r["counts"]), np.uint32).astype(np.int64))
        out = {"lang": [], "phrase": [], "size": [], "a": [], "part": []}
        for (lang, part), (rows, counts, others) in held.items():
            whole, n, names = np.concatenate(rows), np.concatenate(counts), list(others)
            known = v.words.get(lang, [])
            for size in range(2, longest + 1):
                grams, a = ngrams(whole, n, reach, size)
                if not part:
                    grams, a = grams[a >= least], a[a >= least]
                word = {i: names[i - OTHER - 1] if i > OTHER else known[i - 1].as_py().decode() for i in np.unique(grams).tolist()}
                out["phrase"] += [" ".join([word[i] for i in g]) for g in grams.tolist()]
                out["a"] += a.tolist()
                for name, value in (("lang", lang), ("size", size), ("part", part)):
                    out[name] += [value] * len(grams)
        return pa.table(out, pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("a", pa.int64()), ("part", pa.bool_())]))

    found = sent.groupBy("bucket").applyInArrow(lean(count), "lang string, phrase string, size int, a bigint, part boolean")
    return found


def frequent_phrases(docs: DataFrame, work: Workspace, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, known: int = KNOWN) -> tuple[DataFrame, DataFrame]:
    """(phrases, words): lang, phrase, size, a of all n-grams of 2 to ``longest`` words with ``least`` occurrences; lang, word, n of all words."""
    rows = _source(docs, text_col, lang_col)
    words = work.save(count_words(rows), "words")
    often = words.filter(F.col("n") >= least)
    told = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") >= least).alias("often")).first()
    table = often.orderBy(F.desc("n"), "lang", "word").limit(known).toArrow()
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(table, told["often"] <= known, max(1, -(-told["n"] // SPLIT))))
    found = work.save(mine(route(rows, held, longest), held, least, longest), "mined")
    parts = found.filter("part").groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return work.save(found.filter("NOT part").drop("part").unionByName(parts), "phrases"), words


def _inside(words, size: str, low: int):
    """The contiguous parts of ``low`` and more words, shorter than the phrase."""
    part = lambda k: F.transform(F.sequence(F.lit(1), F.col(size) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.flatten(F.transform(F.sequence(F.lit(low), F.col(size) - 1), part))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, known: int = KNOWN) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    work = Workspace(docs.sparkSession, "phrases")
    phrases, words = frequent_phrases(docs, work, text_col, lang_col, least, longest, known)
    number = lambda c: c.cast("decimal(20,0)")
    own = F.split("phrase", " ")
    # Longer phrases by what they hold: the most frequent of them decides.
    longer = phrases.filter("size > 2").select("lang", F.explode(_inside(own, "size", 2)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * number(F.col("longer")) < covered * number(F.col("a")))).drop("longer")
    # Both sides of each cut look up their counts; a single word is a key of many phrases, so it is dealt to several.
    side = lambda k, name, words, size: F.struct(k.alias("k"), F.lit(name).alias("side"), F.array_join(words, " ").alias("part"), (size == 1).alias("single"))
    cut = lambda k: F.array(side(k, "l", F.slice(own, 1, k), k), side(k, "r", F.slice(own, k + 1, F.col("size") - k), F.col("size") - k))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut))).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.k", "c.side", "c.part", F.when(F.col("c.single"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt"))
    singles = words.filter(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    counts = singles.unionByName(phrases.filter(F.col("size") < longest).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"), F.lit(0).alias("salt")))
    sides = cuts.join(counts, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    sides = sides.select("lang", "phrase", F.struct(F.expr("(2000000BD * CAST(a AS DECIMAL(20,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))").alias("score"), "k", "a", "l", "r").alias("cut"))
    best = sides.groupBy("lang", "phrase").agg(F.min("cut").alias("cut")).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    # The first of each bucket, then of all: no task sees a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT rid, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, ws FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p) WHERE len(ws) > 0),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, range(1, {LONGEST + 1}) AS r(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= {LEAST}),
i AS (SELECT lang, unnest(list_transform(range(1, k - j + 2), lambda s: array_to_string(ws[s : s + j - 1], ' '))) AS phrase, a FROM c, range(2, {LONGEST}) AS r(j) WHERE j < k),
m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
x AS (SELECT c.lang, c.phrase, c.a, j, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score FROM c CROSS JOIN range(1, {LONGEST}) AS q(j) JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:j], ' ') JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[j + 1:], ' ') LEFT JOIN m ON m.lang = c.lang AND m.phrase = c.phrase WHERE j < c.k AND (m.longer IS NULL OR 100 * m.longer::HUGEINT < {COVERED} * c.a)),
b AS (SELECT lang, phrase, a, l, r, score FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t JOIN n USING (lang) WHERE rank <= {TOP}
"""
