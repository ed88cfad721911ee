"""Corpora from tables of texts and from any table of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Chunks, Corpus, Frame, Spans, _free
from ..functions.arrays import running_sums

#: What is between words.  Java's own \s has the vertical tab, too, which SQL's does not.
BLANKS = r"[ \t\n\f\r]+"


def _lines(text: Column) -> Column:
    """For each line of a text, numbered from 0, the array of its words as (line, text)."""
    return F.transform(F.split(text, "\n"), lambda line, i: F.transform(F.filter(F.split(line, BLANKS), lambda w: w != ""), lambda w: F.struct(i.alias("line"), w.alias("text"))))


def corpus_from_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Corpus:
    """Words as atoms (id, document, line, text, ordinal from 1 in each document), documents and lines as chunks.

    A document's words stay in its row, so nothing is shuffled; ids should differ, and rows that share
    one are documents of their own.  Documents keep their other columns as attributes, one that is called id
    under the name id_ (or with more underscores).  A null text has no words, but its document is a chunk.
    """
    other = "id_"
    while other in docs.columns:
        other += "_"
    rest = {c: other if c == "id" else c for c in docs.columns if c not in (id_col, text_col)}
    words, firsts, own, place = (_free([*docs.columns, "__c"], n) for n in ("__words", "__lines", "__document", "__place"))
    table = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{id_col}`").alias(own), *[F.col(f"`{c}`").alias(n) for c, n in rest.items()], F.coalesce(_lines(F.col(f"`{text_col}`").cast("string")), F.array()).alias(firsts))
    # Beside the words, where each line's begin; lines without words are not there.
    sizes = running_sums(F.transform(firsts, lambda x: F.size(x).cast("bigint")))
    places = F.filter(F.zip_with(firsts, sizes, lambda x, end: F.struct(F.get(x, F.lit(0))["line"].alias("line"), (end - F.size(x)).cast("int").alias("_a"), (end - 1).cast("int").alias("_b"))), lambda c: c["_a"] <= c["_b"])
    table = table.select("id", own, *[F.col(f"`{n}`") for n in rest.values()], F.flatten(firsts).alias(words), places.alias(firsts))
    ordinal = lambda i: (i + 1).cast("long")
    fields = {
        "id": lambda x, i: F.struct(F.col(own).alias("document"), ordinal(i).alias("ordinal")),
        "document": lambda x, i: F.col(own),
        "line": lambda x, i: x["line"],
        "text": lambda x, i: x["text"],
        "ordinal": lambda x, i: ordinal(i),
    }
    frame = Frame(table, words, fields, (own,), {"line": lambda x: x["line"]}, consecutive=True, plain=True, place=place)
    return corpus_of_frame(frame, {"document": Spans(frame, ["id", *rest.values()]), "line": Spans(frame, ["id", "document", "ordinal"], F.transform(firsts, lambda c: F.struct(F.struct(F.col(own).alias("document"), c["line"].alias("line")).alias("id"), F.col(own).alias("document"), c["line"].alias("ordinal"), c["_a"], c["_b"])))})


def corpus_of_frame(frame: Frame, kinds: dict[str, Spans]) -> Corpus:
    """A corpus of a frame's atoms and named spans."""
    whole = Spans(frame, ["id"])
    corpus = Corpus(whole.unnest(whole.rows(atoms=True)).drop("_chunk"))
    for name, spans in kinds.items():
        chunks = Chunks(corpus, spans=spans)
        chunks.kind = name
        corpus.set_chunk(name, chunks, persist=False)
    return corpus


def corpus_from_rows(rows: DataFrame, id_cols: list[str], chunk_cols: dict[str, str]) -> Corpus:
    """Rows as atoms, with a struct of ``id_cols`` as id, and a kind of chunk for each named column; null keys are in no chunk."""
    atoms = rows.withColumn("id", F.struct(*id_cols))
    corpus = Corpus(atoms)
    for name, column in chunk_cols.items():
        joined = atoms.filter(F.col(column).isNotNull()).withColumn("_chunk", F.col(column))
        corpus.set_chunk(name, Chunks(corpus, joined.select(F.col("_chunk").alias("id")).distinct(), joined=joined), persist=False)
    return corpus
