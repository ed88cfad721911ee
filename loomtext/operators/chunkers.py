"""Expressions that make chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import ChunkExpr, Chunks, Corpus, Spans
from ..functions.arrays import let
from ..functions.regex import match_atoms, match_spans, match_width, native_pattern

CLOSED = ("left", "right", "both", "none")


def _need(corpus: Corpus, *columns: str) -> None:
    if missing := [c for c in columns if c not in corpus.atoms.columns]:
        raise KeyError(missing[0])


class FixedSizeChunk(ChunkExpr):
    """Windows of ``size`` ordinals inside each constraining chunk, one every ``size + offset``.

    Windows start at the smallest ordinal of the constraint.  Offset 0 tiles, a negative one
    overlaps, a positive one leaves gaps.  ``closed`` says which ends belong to a window.  Windows
    without atoms are not made; atoms without an ordinal are in none.  Chunks have the attributes
    ``id`` (a struct of the other two), ``constraint`` and ``start``.
    """

    def __init__(self, constrain_to: ChunkExpr | str, size: int, offset: int = 0, *, closed: str = "left"):
        if size <= 0 or size + offset <= 0:
            raise ValueError("size and size + offset must be positive")
        if closed not in CLOSED:
            raise ValueError(f"closed must be one of {CLOSED}")
        self.constrain_to, self.size, self.every, self.closed = constrain_to, size, size + offset, closed

    def _spans(self, within: Spans) -> Spans:
        """The windows as intervals: places are ordinals less a constant, so a window's atoms follow from its number."""
        first, last = 0 if self.closed in ("left", "both") else 1, self.size if self.closed in ("right", "both") else self.size - 1

        def windows(c):
            most = c["_b"] - c["_a"] - first
            numbers = F.when(most >= 0, F.sequence(F.lit(0), F.greatest(most, F.lit(0)), F.lit(self.every))) if first <= last else F.lit(None).cast("array<int>")

            def window(k):
                start = (c["_a"] + 1 + k).cast("long")
                return F.struct(F.struct(c["id"].alias("constraint"), start.alias("start")).alias("id"), c["id"].alias("constraint"), start.alias("start"), (c["_a"] + k + first).alias("_a"), F.least(c["_b"], c["_a"] + k + last).alias("_b"))

            return F.coalesce(F.transform(numbers, window), F.array())

        return Spans(within.frame, ["id", "constraint", "start"], F.flatten(F.transform(within.items(), windows)))

    def __call__(self, corpus: Corpus) -> Chunks:
        _need(corpus, "ordinal")
        within = corpus.chunk(self.constrain_to)
        if within.spans is not None and within.fresh and not within.filtered and within.spans.frame.consecutive:
            return Chunks(corpus, spans=self._spans(within.spans))
        rows = within.members().filter("ordinal IS NOT NULL").withColumnRenamed("_chunk", "_in")
        # A grouped minimum joined back, not a window: a huge constraint stays many tasks.
        least = rows.groupBy("_in").agg(F.min(F.col("ordinal").cast("long")).alias("_least"))
        rows = rows.join(least, "_in")
        d, e, size = F.col("ordinal").cast("long") - F.col("_least"), self.every, self.size
        floor = lambda x: F.floor(x / F.lit(e)).cast("long")
        ceil = lambda x: F.ceil(x / F.lit(e)).cast("long")
        low = ceil(d - size) if self.closed in ("right", "both") else floor(d - size) + 1
        high = floor(d) if self.closed in ("left", "both") else ceil(d) - 1
        rows = rows.withColumns({"_low": F.greatest(F.lit(0), low), "_high": high}).filter("_low <= _high")
        rows = rows.withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("_chunk", F.struct(F.col("_in").alias("constraint"), (F.col("_least") + F.col("_k") * e).alias("start")))
        joined = rows.drop("_in", "_least", "_low", "_high", "_k")
        chunks = joined.select(F.col("_chunk").alias("id")).distinct().select("id", "id.constraint", "id.start")
        return Chunks(corpus, chunks, joined=joined)


class RegexMatchChunk(ChunkExpr):
    """A chunk for each match of a Python pattern in the text of a constraining chunk.

    The text is the atoms' texts in the order of ordinals, joined by a space; null texts are
    absent.  A match holds the atoms whose first character lies from its start to its end, both
    included; one that reaches no atom's start makes no chunk.  Chunks have the attributes ``id``
    (a struct of the others), ``constraint``, ``start`` and ``end``.

    ``engine`` is "auto", "native" or "python".  Natively, on the JVM, matches are found in the rows of
    spans whose texts hold no blank, by a pattern that means the same there and never matches
    nothing; "native" is a ``ValueError`` where that is not so.
    """

    def __init__(self, constrain_to: ChunkExpr | str, pattern: str, engine: str = "auto"):
        if engine not in ("auto", "native", "python"):
            raise ValueError("engine must be auto, native or python")
        self.constrain_to, self.pattern, self.engine = constrain_to, pattern, engine

    def _spans(self, within: Spans, pattern: str) -> Spans:
        frame = within.frame
        text = lambda words, c: F.array_join(F.transform(F.slice(words, c["_a"] + 1, F.greatest(c["_b"] - c["_a"] + 1, F.lit(0))), lambda x: frame.fields["text"](x, F.lit(0))), " ")

        def matches(words, c):
            made = lambda m: F.struct(F.struct(c["id"].alias("constraint"), m["start"].alias("start"), m["end"].alias("end")).alias("id"), c["id"].alias("constraint"), m["start"].alias("start"), m["end"].alias("end"), (c["_a"] + m["first"]).alias("_a"), (c["_a"] + m["last"]).alias("_b"))
            return F.transform(match_spans(text(words, c), pattern), made)

        items = let(F.col(f"`{frame.atoms}`"), lambda words: F.flatten(F.transform(within.items(), lambda c: matches(words, c))))
        return Spans(frame, ["id", "constraint", "start", "end"], items)

    def __call__(self, corpus: Corpus) -> Chunks:
        _need(corpus, "ordinal", "text")
        within = corpus.chunk(self.constrain_to)
        pattern = None if self.engine == "python" else native_pattern(self.pattern)
        if pattern is not None and match_width(self.pattern) > 0 and within.spans is not None and within.fresh and not within.filtered and within.spans.frame.plain:
            return Chunks(corpus, spans=self._spans(within.spans, pattern))
        if self.engine == "native":
            raise ValueError("the pattern or the corpus does not allow the JVM's engine")
        names = corpus.atoms.columns
        row = F.struct(F.col("ordinal").alias("_o"), F.col("id").alias("_i"), F.struct(*names).alias("_a"))
        rows = within.members().filter("text IS NOT NULL AND ordinal IS NOT NULL").groupBy("_chunk").agg(F.sort_array(F.collect_list(row)).alias("_atoms"))
        # Each match takes its own atoms along before matches become rows, so no row holds the whole text.
        rows = rows.withColumn("_ms", match_atoms(F.transform("_atoms", lambda x: x["_a"]["text"]), self.pattern))
        own = F.transform("_ms", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.slice("_atoms", m["first"] + 1, m["last"] - m["first"] + 1).alias("atoms")))
        rows = rows.select("_chunk", F.explode(own).alias("_m"))
        found = rows.select(F.struct(F.col("_chunk").alias("constraint"), F.col("_m.start").alias("start"), F.col("_m.end").alias("end")).alias("_chunk"), F.explode("_m.atoms").alias("_x"))
        joined = found.select("_chunk", "_x._a.*")
        chunks = joined.select(F.col("_chunk").alias("id")).distinct().select("id", "id.constraint", "id.start", "id.end")
        return Chunks(corpus, chunks, joined=joined)
