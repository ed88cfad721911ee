"""Corpora, chunks and the three kinds of operators.

A corpus is a table of atoms, the smallest parts of documents, with an ``id``.
Chunks are sets of atoms: a table with a row per chunk (``id`` and attributes)
and a bridge (``chunk``, ``atom``).  Everything is a lazy DataFrame; results are
matched by key, never by row position.

Chunks have two physical forms.  In general a row for each atom of a chunk is
joined and grouped.  Where a source has a document's atoms in one row (``Frame``),
chunks of consecutive atoms are intervals in that row (``Spans``), and expressions
are computed inside it: no atom becomes a row and nothing is shuffled.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.arrays import fenced, let


def _free(taken: Collection[str], name: str) -> str:
    """``name`` with as many underscores before it as make it a name that is not taken."""
    while name in taken:
        name = f"_{name}"
    return name


class ChunkExpr(ABC):
    """Makes chunks of a corpus."""

    @abstractmethod
    def __call__(self, corpus: Corpus) -> Chunks: ...


@dataclass(frozen=True)
class Across:
    """What gives an array with a value for each span of a frame's row, in their order: a function, a UDF perhaps, of columns of the frame."""

    columns: tuple[Column, ...]
    values: Callable[..., Column]


class AttrExpr(ABC):
    """Computes an attribute: a DataFrame (id, value), with at most a row per chunk."""

    @abstractmethod
    def __call__(self, chunks: Chunks) -> DataFrame: ...

    def within(self, atoms: Atoms, chunks: Chunks) -> Column | None:
        """The attribute out of the chunk's own row, where chunks are spans; None if that cannot be."""
        return None

    def across(self, chunks: Chunks) -> Across | None:
        """The attribute of all spans of a frame's row at once; None if that cannot be."""
        return None


class AtomAggregate(AttrExpr):
    """An attribute that is one aggregate over a chunk's atoms.

    All such expressions of one ``enrich`` or ``select`` share a single grouping.
    """

    @abstractmethod
    def aggregate(self, chunks: Chunks) -> Column:
        """An aggregate over the atoms' columns; ``F.col`` names are those of ``Corpus.atoms``."""

    def finish(self, value: Column) -> Column:
        """What becomes of the aggregate after the grouping; null where a chunk has no atoms."""
        return value

    def __call__(self, chunks: Chunks) -> DataFrame:
        if (own := chunks.inside(self)) is not None:
            return own
        rows = chunks.members().groupBy("_chunk").agg(self.aggregate(chunks).alias("_value"))
        return rows.select(F.col("_chunk").alias("id"), self.finish(F.col("_value")).alias("value"))


class TextScore(AttrExpr):
    """An attribute that is computed from all chunks' strings together.

    ``score`` takes a table (id, value) of strings, null where a chunk has none, and returns (id, value)
    with a row for each; an id may be any value that can be grouped by.
    """

    stringifier: AttrExpr

    @abstractmethod
    def score(self, texts: DataFrame) -> DataFrame: ...

    def __call__(self, chunks: Chunks) -> DataFrame:
        own = chunks.chunks.select(F.col("id").alias("_i"))
        texts = self.stringifier(chunks).select(F.col("id").alias("_j"), F.col("value"))
        return self.score(own.join(texts, F.col("_i") == F.col("_j"), "left").select(F.col("_i").alias("id"), "value"))


class ChunkFilter(ABC):
    """Keeps some chunks; the bridge stays whole."""

    @abstractmethod
    def __call__(self, chunks: Chunks) -> Chunks: ...


class Corpus:
    """A table of atoms and named chunks of them."""

    def __init__(self, atoms: DataFrame):
        if "_chunk" in atoms.columns:
            raise ValueError("atoms cannot have a column _chunk")
        self.atoms = atoms
        self.chunks: dict[str, Chunks] = {}

    def chunk(self, expr: ChunkExpr | str) -> Chunks:
        """Chunks stored under a name (``KeyError`` if there are none), or made by an expression."""
        return self.chunks[expr] if isinstance(expr, str) else expr(self)

    def native(self, kind: str, frame: Frame) -> bool:
        """Whether the chunks of that name are those by which ``frame`` tells its atoms apart."""
        own = self.chunk(kind)
        return kind in (frame.keys or {}) and own.spans is not None and own.spans.frame is frame and own.kind == kind and not own.filtered

    def set_chunk(self, name: str, chunks: Chunks, persist: bool = True) -> None:
        """Store chunks of this corpus by name; they are kept by Spark unless ``persist`` is false, and those that had the name no more.

        Kept are the chunks' rows and their bridge.  What is computed inside the rows of a frame needs neither.
        """
        if chunks.corpus is not self:
            raise ValueError("the chunks belong to another corpus")
        if name in self.chunks and self.chunks[name] is not chunks:
            self.unpersist(name)
        if persist:
            chunks.chunks.persist()
            chunks.chunk_atoms.persist()
        self.chunks[name] = chunks

    def sizes(self) -> DataFrame:
        """(kind, n): how many atoms there are (kind ``atoms``), and how many chunks of each name.

        Spans of a frame are counted in its rows, all of them in one scan.
        """
        spans = {n: c.spans for n, c in self.chunks.items() if c.spans is not None and c.fresh and not c.filtered}
        frames = list(dict.fromkeys(s.frame for s in spans.values()))
        told = lambda rows, kind: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = [told(c.chunks, n) for n, c in self.chunks.items() if n not in spans]
        if len(frames) != 1:
            out = [told(self.atoms, "atoms"), *(told(c.chunks, n) for n, c in self.chunks.items())]
        else:
            # A frame of another corpus would count other atoms; a corpus made of a frame has only its own.
            atoms = F.size(f"`{frames[0].atoms}`") if frames[0].count is None else frames[0].count
            own = {"atoms": atoms} | {n: s.count() for n, s in spans.items()}
            sums = frames[0].table.agg(*[F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint")).alias(f"n{j}") for j, c in enumerate(own.values())])
            out.append(sums.select(F.inline(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(f"n{j}").alias("n")) for j, n in enumerate(own)]))))
        rows = out[0]
        for more in out[1:]:
            rows = rows.unionByName(more)
        return rows

    def unpersist(self, name: str) -> None:
        self.chunks[name].chunks.unpersist()
        self.chunks[name].chunk_atoms.unpersist()

    @classmethod
    def merge(cls, corpora: Collection[Corpus]) -> Corpus:
        """All atoms, and for each chunk name all chunks, of corpora with the same names and schemas; nothing is deduplicated."""
        corpora = list(corpora)
        if not corpora:
            raise ValueError("no corpora to merge")
        out = cls(_stack([c.atoms for c in corpora]))
        for name in dict.fromkeys(n for c in corpora for n in c.chunks):
            parts = [c.chunks[name] for c in corpora]
            out.chunks[name] = Chunks(out, _stack([p.chunks for p in parts]), _stack([p.chunk_atoms for p in parts]))
        return out


def _stack(parts: list[DataFrame]) -> DataFrame:
    kinds = [[(f.name, f.dataType) for f in p.schema.fields] for p in parts]
    if any(k != kinds[0] for k in kinds):
        raise ValueError(f"schemas differ: {kinds}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _beside(names: list[str], name: str) -> Callable[[Column, Column], Column]:
    """For ``zip_with``: a struct's fields ``names``, and the other value as ``name``."""
    return lambda x, y: F.struct(*[x[n].alias(n) for n in names], y.alias(name))


@dataclass(frozen=True, eq=False)
class Frame:
    """A table with a row for each document and its atoms in one array, in the order of ordinals.

    ``fields`` gives an atom's columns from its element and its place in the array (from 0), and
    may refer to the columns in ``scalars``.  ``keys`` gives for kinds of chunks, of which each atom
    is in one at most, what tells them apart inside a document.  ``consecutive``: ordinals are places
    plus one.  ``plain``: texts are never null and hold no blank.
    """

    table: DataFrame
    atoms: str
    fields: dict[str, Callable[[Column, Column], Column]]
    scalars: tuple[str, ...] = ()
    keys: dict[str, Callable[[Column], Column]] | None = None
    consecutive: bool = False
    plain: bool = False
    #: What the rows of spans call the place where a span begins.
    place: str = "__place"
    #: How many atoms a row has, where that is known without the array.
    count: Column | None = None


class Atoms:
    """The atoms of a span, in its row."""

    def __init__(self, frame: Frame):
        self.frame, self.array, self.size = frame, F.col(f"`{frame.atoms}`"), F.size(f"`{frame.atoms}`")

    def __contains__(self, name: str) -> bool:
        return name in self.frame.fields

    def values(self, name: str) -> Column:
        """An array of a column of the atoms."""
        return F.transform(self.array, lambda x, i: self.frame.fields[name](x, F.col(f"`{self.frame.place}`") + i))


#: So many ids are broadcast at most.
FEW = 100_000
#: So many rows a filter keeps together with their atoms, and so many are put in order in one task.
HELD, SORTED = 100, 1_000
#: More than there can be of these, also where ids repeat.
ALL = 2_000_000_000


class Spans:
    """Chunks as intervals of places in the rows of a frame.

    ``items`` is an array in the frame's table of (``id``, further attributes, ``_a``, ``_b``): the
    first and the last place, the last smaller if there are no atoms.  Without ``items`` the rows
    themselves are the chunks, and ``attributes`` are columns of the table.  ``count`` may say how many
    items there are without the array.  ``stored``: ``items`` is a column of the table as it stands.
    """

    def __init__(self, frame: Frame, attributes: list[str], items: Column | None = None, count: Column | None = None, stored: bool = False):
        self.frame, self.attributes, self._items, self._count, self.stored = frame, attributes, items, count, stored

    @property
    def whole(self) -> bool:
        return self._items is None

    def items(self) -> Column:
        """The spans of a row of the frame."""
        if self._items is not None:
            return self._items
        return F.array(F.struct(F.col("id"), F.lit(0).alias("_a"), (F.size(f"`{self.frame.atoms}`") - 1).alias("_b")))

    def count(self) -> Column:
        """How many spans a row of the frame has."""
        return F.lit(1) if self.whole else F.size(self.items()) if self._count is None else self._count

    def places(self) -> Column:
        return F.transform(self.items(), lambda c: F.struct(c["_a"].cast("int").alias("a"), c["_b"].cast("int").alias("b")))

    def rows(self, atoms: bool = False, across: dict[str, Across] | None = None) -> DataFrame:
        """A row for each span: its attributes, one value of each array in ``across``, and with ``atoms`` what they need."""
        frame, across = self.frame, across or {}
        array, table = F.col(f"`{frame.atoms}`"), frame.table
        if across:
            table = table.withColumns({f"__a{j}_{i}": fenced(c) for j, a in enumerate(across.values()) for i, c in enumerate(a.columns)})
            table = table.withColumns({f"__v{j}": a.values(*[F.col(f"__a{j}_{i}") for i in range(len(a.columns))]) for j, a in enumerate(across.values())})
        scalars = [F.col(f"`{s}`") for s in frame.scalars] if atoms else []
        if self._items is None:
            own = [F.col(f"`{a}`") for a in self.attributes] + [F.col(f"__v{j}")[0].alias(n) for j, n in enumerate(across)]
            return table.select(*own, *scalars, *([array, F.lit(0).alias(frame.place)] if atoms else []))
        # Zipped, not indexed, and the atoms bound once: what stands in a lambda is computed for each element.
        zipped = F.transform(self.items(), lambda c: F.struct(c.alias("c")))
        for j in range(len(across)):
            zipped = F.zip_with(zipped, f"__v{j}", _beside(["c", *(f"y{i}" for i in range(j))], f"y{j}"))

        def one(z: Column, held: Column | None) -> Column:
            c = z["c"]
            parts = [c[a].alias(f"x{j}") for j, a in enumerate(self.attributes)] + [z[f"y{j}"].alias(f"y{j}") for j in range(len(across))]
            if held is not None:
                parts += [F.slice(held, c["_a"] + 1, F.greatest(c["_b"] - c["_a"] + 1, F.lit(0))).alias("atoms"), c["_a"].alias("place")]
            return F.struct(*parts)

        if self.stored and not across:  # nothing to compute first, so the atoms are not copied once more
            zipped = lambda held: F.transform(self.items(), lambda c: one({"c": c}, held))
        else:
            table = table.select(*scalars, *([array] if atoms else []), zipped.alias("__z"))
            zipped = lambda held: F.transform("__z", lambda z: one(z, held))
        whole = let(array, zipped) if atoms else zipped(None)
        table = table.select(*scalars, F.explode(whole).alias("__c"))
        own = [F.col(f"__c.x{j}").alias(a) for j, a in enumerate(self.attributes)] + [F.col(f"__c.y{j}").alias(n) for j, n in enumerate(across)]
        held = [*scalars, F.col("__c.atoms").alias(frame.atoms), F.col("__c.place").alias(frame.place)] if atoms else []
        return table.select(*own, *held)

    def unnest(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their atoms as a row for each atom of each span: the atoms' columns and ``_chunk``."""
        # The elements as they are, and columns made of them after: what nobody reads is then never made.
        frame = self.frame
        scalars = [F.col(f"`{s}`") for s in frame.scalars]
        each = rows.select(F.col("id").alias("_chunk"), *scalars, F.col(f"`{frame.place}`").alias("__at"), F.posexplode(F.col(f"`{frame.atoms}`")).alias("__i", "__x"))
        return each.select(*[f(F.col("__x"), F.col("__at") + F.col("__i")).alias(n) for n, f in frame.fields.items()], "_chunk")


class Chunks:
    """Chunks of a corpus with their bridge to its atoms.

    ``joined`` may give the bridge already joined with the atoms (their columns and
    ``_chunk``), which saves the join; ``bridge`` is then read off it.  ``spans`` gives chunks
    as intervals, which need neither; ``where`` are tests of theirs that hold.  ``held`` may give the
    rows along with their atoms, so that what is computed next needs no other pass over the frame.
    """

    def __init__(self, corpus: Corpus, chunks: DataFrame | None = None, chunk_atoms: DataFrame | None = None, joined: DataFrame | None = None, filtered: bool = False, spans: Spans | None = None, where: tuple[Column, ...] | None = None, held: DataFrame | None = None):
        if chunk_atoms is None and joined is None and spans is None:
            raise ValueError("chunk_atoms, joined or spans is needed")
        self.corpus, self.spans, self._where = corpus, spans, () if where is None and chunks is None else where
        self.chunks = self._narrow(spans.rows()) if chunks is None else chunks
        self._joined = joined if joined is not None or chunk_atoms is not None else spans.unnest(spans.rows(atoms=True))
        self.chunk_atoms = self._joined.select(F.col("_chunk").alias("chunk"), F.col("id").alias("atom")) if chunk_atoms is None else chunk_atoms
        self._filtered, self._held = filtered, held
        #: The kind that a source made the chunks as.
        self.kind: str | None = None
        #: What order a filter left the rows in, and whether they are few enough to be broadcast.
        self.order: tuple[Column, ...] = ()
        self.few = self.sorted = False

    def __len__(self) -> int:
        return self.chunks.count()

    @property
    def filtered(self) -> bool:
        return self._filtered

    @property
    def fresh(self) -> bool:
        """Whether the rows are those of the spans, all that ``where`` lets pass."""
        return self._where is not None

    def _narrow(self, rows: DataFrame) -> DataFrame:
        for test in self._where:
            rows = rows.filter(test)
        return rows

    def spread(self, atoms: bool = False, across: dict[str, Across] | None = None) -> DataFrame:
        """The rows of the spans that are still there, with their attributes and what ``Spans.rows`` adds."""
        if self.fresh:
            return self._narrow(self.spans.rows(atoms, across))
        if self._held is not None and not across:
            return self._held
        rows = self.spans.rows(atoms, across)
        rows = rows.select(F.col("id").alias("__id"), *[c for c in rows.columns if c not in self.spans.attributes])
        own = F.broadcast(self.chunks) if self.few else self.chunks
        return rows.join(own, F.col("__id").eqNullSafe(F.col("id"))).drop("__id")

    def inside(self, expr: AttrExpr) -> DataFrame | None:
        """(id, value) of an expression that can be computed in the rows of the spans, else None."""
        if self.spans is None:
            return None
        if (value := expr.within(Atoms(self.spans.frame), self)) is not None:
            return self.spread(atoms=True).select("id", value.alias("value"))
        if (values := expr.across(self)) is not None:
            return self.spread(across={"__value": values}).select("id", F.col("__value").alias("value"))
        return None

    def members(self) -> DataFrame:
        """The atoms' columns and ``_chunk``, a row per membership in a chunk that is still there."""
        if self.spans is not None and self._where:
            return self.spans.unnest(self.spread(atoms=True))
        rows = self._joined
        if rows is None:
            rows = self.corpus.atoms.join(self.chunk_atoms.select(F.col("chunk").alias("_chunk"), F.col("atom").alias("_atom")), F.col("id") == F.col("_atom")).drop("_atom")
        if self._filtered:
            rows = rows.join(self.chunks.select(F.col("id").alias("_kept")), F.col("_chunk") == F.col("_kept"), "left_semi")
        return rows

    def bridge(self) -> DataFrame:
        """The bridge, cut down to the chunks that are still there."""
        if not self._filtered:
            return self.chunk_atoms
        return self.chunk_atoms.join(self.chunks.select(F.col("id").alias("chunk")), "chunk", "left_semi")

    def replace(self, chunks: DataFrame, filtered: bool | None = None, held: DataFrame | None = None) -> Chunks:
        """The same bridge under other rows."""
        out = Chunks(self.corpus, chunks, self.chunk_atoms, self._joined, self._filtered if filtered is None else filtered, self.spans, held=held)
        out.order, out.few, out.sorted = self.order, self.few, self.sorted
        return out

    def keep(self, test: Column) -> Chunks:
        """Those chunks that pass a test of their attributes."""
        if self.fresh:
            return Chunks(self.corpus, None, self.chunk_atoms, self._joined, True, self.spans, (*self._where, test))
        return self.replace(self.chunks.filter(test), filtered=True, held=None if self._held is None else self._held.filter(test))

    def first(self, k: int, *order: Column) -> Chunks:
        """The first ``k`` chunks in an order, which the tables made of them keep."""
        # Whole documents are not held: a task would keep so many of the largest.
        held = self._held.orderBy(*order).limit(k) if self._held is not None and k <= HELD and not self.spans.whole else None
        out = self.replace(self.chunks.orderBy(*order).limit(k) if held is None else held.select(*[F.col(f"`{c}`") for c in self.chunks.columns]), filtered=True, held=held)
        out.order, out.few, out.sorted = order, k <= FEW, k <= SORTED
        return out

    def _with(self, exprs: dict[str, AttrExpr]) -> DataFrame:
        """``chunks`` plus a column for each expression: in the chunk's row, else by left joins on the id."""
        for name, e in exprs.items():
            if not callable(e) or isinstance(e, str):
                raise TypeError(f"{name} is not an attribute expression")
        out, names = self.chunks, {}
        for n in exprs:
            names[n] = _free([*self.chunks.columns, *exprs, *names.values()], f"_{n}")
        own = _free([*self.chunks.columns, *exprs, *names.values()], "_id")
        done: set[str] = set()
        if self.spans is not None:
            atoms = Atoms(self.spans.frame)
            within = {n: v for n, e in exprs.items() if (v := e.within(atoms, self)) is not None}
            across = {names[n]: v for n, e in exprs.items() if n not in within and (v := e.across(self)) is not None}
            scored = {n: v for n, e in exprs.items() if isinstance(e, TextScore) and (v := e.stringifier.within(atoms, self)) is not None}
            within |= scored
            if done := {*within, *(n for n in exprs if names[n] in across)}:
                out = self.spread(bool(within), across)
                kept = [F.col(f"`{c}`") for c in self.chunks.columns]
                out = out.select(*kept, *[(within[n] if n in within else F.col(f"`{names[n]}`")).alias(n) for n in exprs if n in done])
            for n in scored:
                # The whole row goes along as the id, so that nothing has to be joined back.
                rest = [c for c in out.columns if c != n]
                rows = exprs[n].score(out.select(F.struct(*[F.col(f"`{c}`").alias(f"x{j}") for j, c in enumerate(rest)]).alias("id"), F.col(f"`{n}`").alias("value")))
                out = rows.select(*[F.col(f"id.x{j}").alias(c) for j, c in enumerate(rest)], F.col("value").alias(n))
        fused = {n: e for n, e in exprs.items() if n not in done and isinstance(e, AtomAggregate)}
        if fused:
            rows = self.members().groupBy(F.col("_chunk").alias(own)).agg(*[e.aggregate(self).alias(names[n]) for n, e in fused.items()])
            out = out.join(rows, F.col("id") == F.col(f"`{own}`"), "left").drop(own)
            out = out.withColumns({n: e.finish(F.col(f"`{names[n]}`")) for n, e in fused.items()}).drop(*[names[n] for n in fused])
        for name, e in exprs.items():
            if name not in fused and name not in done:
                values = e(self).select(F.col("id").alias(own), F.col("value").alias(name))
                out = out.join(values, F.col("id") == F.col(f"`{own}`"), "left").drop(own)
        return out

    def enrich(self, **exprs: AttrExpr) -> Chunks:
        """Add attributes; expressions see the chunks as they are, not each other.  A name that exists is a ``ValueError``."""
        if taken := set(exprs) & set(self.chunks.columns):
            raise ValueError(f"attributes exist: {sorted(taken)}")
        if (held := self._holding(exprs)) is not None:
            return self.replace(held.select(*[F.col(f"`{c}`") for c in (*self.chunks.columns, *exprs)]), held=held)
        return self.replace(self._with(exprs).select(*self.chunks.columns, *exprs))

    def _holding(self, exprs: dict[str, AttrExpr]) -> DataFrame | None:
        """The rows with their atoms and new attributes, where all of these can be computed in the row; else None."""
        if self.spans is None or not exprs or not (self.fresh or self._held is not None) or not all(isinstance(e, AttrExpr) for e in exprs.values()):
            return None
        atoms, rows = Atoms(self.spans.frame), self.spread(atoms=True)
        within = {n: e.within(atoms, self) for n, e in exprs.items()}
        if any(v is None for v in within.values()) or set(exprs) & set(rows.columns):
            return None
        return rows.select(*[F.col(f"`{c}`") for c in rows.columns], *[v.alias(n) for n, v in within.items()])

    def filter(self, *filters: ChunkFilter) -> Chunks:
        """Apply filters one after the other."""
        out = self
        for f in filters:
            out = f(out)
        return out

    def select(self, *attrs: str, **exprs: AttrExpr | str) -> DataFrame:
        """A table of attributes by name, then of aliases and computed attributes by keyword."""
        if missing := [a for a in [*attrs, *(e for e in exprs.values() if isinstance(e, str))] if a not in self.chunks.columns]:
            raise KeyError(missing[0])
        new: dict[str, str] = {}
        for n, e in exprs.items():
            if not isinstance(e, str):
                new[n] = _free([*self.chunks.columns, *new.values()], f"_new_{n}")
        made = {new[n]: exprs[n] for n in new}
        rows = self._with(made) if made else self.chunks
        if self.order and made:
            # A range partitioning would compute the rows twice, to find its bounds; few are sorted where they lie and then merged.  The limit cuts none.
            rows = rows.orderBy(*self.order)
            rows = rows.limit(ALL) if self.sorted else rows
        return rows.select(*[F.col(f"`{a}`") for a in attrs], *[F.col(f"`{new.get(n, e)}`").alias(n) for n, e in exprs.items()])
