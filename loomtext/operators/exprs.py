"""Expressions that compute attributes of chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import Across, AtomAggregate, Atoms, AttrExpr, ChunkExpr, Chunks
from ..functions.arrays import covered
from ..functions.regex import count_matches


def _ordered(chunks: Chunks, value: Column) -> Column:
    """The atoms' values in the order of ordinals (if there are any), then of ids; nulls stay."""
    names = ["ordinal", "id"] if "ordinal" in chunks.corpus.atoms.columns else ["id"]
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(n).alias(f"k{i}") for i, n in enumerate(names)], value.alias("v"))))
    return F.transform(rows, lambda x: x["v"])


def _need_text(chunks: Chunks) -> None:
    for name in ("text", "ordinal"):
        if name not in chunks.corpus.atoms.columns:
            raise ValueError(f"atoms have no {name}")


class AtomData(AtomAggregate):
    """One column's values of a chunk's atoms as a list, nulls included; null for a chunk without atoms."""

    def __init__(self, attr: str):
        self.attr = attr

    def aggregate(self, chunks: Chunks) -> Column:
        own = "id" if self.attr == "atom" and "atom" not in chunks.corpus.atoms.columns else self.attr
        if own not in chunks.corpus.atoms.columns:
            raise KeyError(self.attr)
        return _ordered(chunks, F.col(f"`{own}`"))

    def within(self, atoms: Atoms, chunks: Chunks) -> Column | None:
        own = "id" if self.attr == "atom" and "atom" not in atoms else self.attr
        return F.when(atoms.size > 0, atoms.values(own)) if own in atoms else None


class SimpleStringify(AtomAggregate):
    """The atoms' texts in order, joined by a delimiter; null texts are skipped, a chunk without atoms is null."""

    def __init__(self, delimiter: str = " "):
        self.delimiter = delimiter

    def aggregate(self, chunks: Chunks) -> Column:
        _need_text(chunks)
        return F.array_join(_ordered(chunks, F.col("text")), self.delimiter)

    def within(self, atoms: Atoms, chunks: Chunks) -> Column | None:
        _need_text(chunks)
        return F.when(atoms.size > 0, F.array_join(atoms.values("text"), self.delimiter))


class RegexCount(AttrExpr):
    """How often a Python pattern matches a chunk's string; null for a null string.

    ``flags`` are those of ``re``.  ``engine`` is "auto" (native where the dialects agree), "python" or "native".
    """

    def __new__(cls, stringifier: AttrExpr, pattern: str, flags: int = 0, engine: str = "auto"):
        own = _FusedRegexCount if isinstance(stringifier, AtomAggregate) else RegexCount
        return object.__new__(own)

    def __init__(self, stringifier: AttrExpr, pattern: str, flags: int = 0, engine: str = "auto"):
        self.stringifier, self.pattern, self.flags, self.engine = stringifier, pattern, int(flags), engine

    def count(self, text: Column) -> Column:
        return count_matches(text, self.pattern, self.flags, self.engine)

    def within(self, atoms: Atoms, chunks: Chunks) -> Column | None:
        text = self.stringifier.within(atoms, chunks)
        return None if text is None else self.count(text)

    def __call__(self, chunks: Chunks) -> DataFrame:
        return self.stringifier(chunks).select("id", self.count(F.col("value")).alias("value"))


class _FusedRegexCount(RegexCount, AtomAggregate):
    def aggregate(self, chunks: Chunks) -> Column:
        return self.stringifier.aggregate(chunks)

    def finish(self, value: Column) -> Column:
        return self.count(self.stringifier.finish(value))

    __call__ = AtomAggregate.__call__


class ChunkOverlap(AttrExpr):
    """How far each chunk overlaps with chunks of another kind.

    "bool": any atom is in one; "count": pairs of an atom and a chunk that holds it; "frac": the
    share of rows with such a chunk when atoms are paired with them.  ``distinct`` takes atoms
    instead of pairs.  Chunks without atoms get false, 0 and null.
    """

    AGGS = ("bool", "count", "frac")

    def __init__(self, chunk_b: ChunkExpr | str, agg: str, distinct: bool = False):
        if agg not in self.AGGS:
            raise ValueError(f"agg must be one of {self.AGGS}")
        self.chunk_b, self.agg, self.distinct = chunk_b, agg, distinct

    def across(self, chunks: Chunks) -> Across | None:
        """Counted in the frame's rows: a running count over the places of how many of the other chunks cover each."""
        other = chunks.corpus.chunk(self.chunk_b)
        if other.spans is None or not other.fresh or other.filtered or other.spans.frame is not chunks.spans.frame:
            return None
        return Across((chunks.spans.places(), other.spans.places(), F.size(f"`{chunks.spans.frame.atoms}`")), lambda own, others, size: covered(own, others, size, self.agg, self.distinct))

    def __call__(self, chunks: Chunks) -> DataFrame:
        if (own := chunks.inside(self)) is not None:
            return own
        other = chunks.corpus.chunk(self.chunk_b).bridge().select(F.col("atom").alias("_b"))
        # Counted by atom first: the join then never multiplies rows.
        other = other.groupBy("_b").agg((F.lit(1) if self.distinct else F.count(F.lit(1))).cast("long").alias("_n"))
        rows = chunks.bridge().join(other, F.col("atom") == F.col("_b"), "left").groupBy("chunk").agg(F.sum(F.coalesce("_n", F.lit(0))).alias("_hit"), F.sum(F.coalesce("_n", F.lit(1))).alias("_all"))
        value = {"bool": F.col("_hit") > 0, "count": F.col("_hit"), "frac": F.col("_hit") / F.col("_all")}[self.agg]
        empty = {"bool": F.lit(False), "count": F.lit(0).cast("long"), "frac": F.lit(None).cast("double")}[self.agg]
        own = chunks.chunks.select("id").join(rows.select(F.col("chunk").alias("_c"), value.alias("_v")), F.col("id") == F.col("_c"), "left")
        return own.select("id", F.coalesce("_v", empty).alias("value"))


class ChunkDelimitedStringify(AttrExpr):
    """The atoms' texts in order, with a delimiter that depends on which chunk's end is passed.

    After an atom comes the delimiter of the first pair whose chunk differs at the next atom, else
    ``atom_delimiter``, and nothing after the last.  Where either atom is in no such chunk there is
    no end.  A null text goes with its delimiter; a chunk without atoms is the empty string.
    """

    def __init__(self, chunk_delimiters: Sequence[tuple[ChunkExpr | str, str]], *, atom_delimiter: str = " "):
        self.chunk_delimiters, self.atom_delimiter = list(chunk_delimiters), atom_delimiter

    def within(self, atoms: Atoms, chunks: Chunks) -> Column | None:
        """By the atoms' own keys, where every kind of chunk has them."""
        _need_text(chunks)
        keys = chunks.spans.frame.keys or {}
        if not all(isinstance(kind, str) and chunks.corpus.native(kind, chunks.spans.frame) for kind, _ in self.chunk_delimiters):
            return None
        text = chunks.spans.frame.fields["text"]

        def piece(x: Column, y: Column) -> Column:
            follow = F.when(y.isNull(), F.lit(""))
            for kind, delimiter in self.chunk_delimiters:
                follow = follow.when(keys[kind](x) != keys[kind](y), F.lit(delimiter))
            return F.concat(text(x, F.lit(0)), follow.otherwise(F.lit(self.atom_delimiter)))

        following = F.slice(atoms.array, 2, F.greatest(atoms.size - 1, F.lit(0)))
        return F.array_join(F.zip_with(atoms.array, following, piece), "")

    def __call__(self, chunks: Chunks) -> DataFrame:
        if (own := chunks.inside(self)) is not None:
            return own
        _need_text(chunks)
        rows = chunks.members().select("_chunk", "id", "ordinal", "text")
        for i, (kind, _) in enumerate(self.chunk_delimiters):
            other = chunks.corpus.chunk(kind).bridge().select(F.col("atom").alias(f"_a{i}"), F.col("chunk").alias(f"_d{i}"))
            rows = rows.join(other, F.col("id") == F.col(f"_a{i}"), "left").drop(f"_a{i}")
        keys = ["ordinal", "id", *[f"_d{i}" for i in range(len(self.chunk_delimiters))]]
        order = Window.partitionBy("_chunk").orderBy(*keys)
        follow = F.when(F.lead(F.lit(1)).over(order).isNull(), F.lit(""))
        for i, (_, delimiter) in enumerate(self.chunk_delimiters):
            follow = follow.when(F.col(f"_d{i}") != F.lead(f"_d{i}").over(order), F.lit(delimiter))
        rows = rows.withColumn("_piece", F.concat("text", follow.otherwise(F.lit(self.atom_delimiter))))
        pieces = F.sort_array(F.collect_list(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("_piece").alias("v"))))
        joined = rows.groupBy("_chunk").agg(F.array_join(F.transform(pieces, lambda x: x["v"]), "").alias("_v"))
        return chunks.chunks.select("id").join(joined, F.col("id") == F.col("_chunk"), "left").select("id", F.coalesce("_v", F.lit("")).alias("value"))
