"""A corpus from the table that Tesseract writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import Chunks, Corpus, Frame, Spans
from ..functions.arrays import fenced, let, running_counts
from .text import corpus_of_frame

#: Level numbers of the table, containers before what they contain.
LEVELS = ("page", "block", "paragraph", "line", "word")
NUMBERS = ("page_num", "block_num", "par_num", "line_num", "word_num")
BOX = ("left", "top", "width", "height")


def corpus_from_tesseract_table(table: DataFrame, document_id: str | None = None, document_col: str | None = None) -> Corpus:
    """Words as atoms, and documents, pages, blocks, paragraphs and lines as chunks.

    One document with the given id, or as many as ``document_col`` names.  Ordinals count a level
    over the whole document, in the table's order of numbers; ids are structs of a document, a level
    and an ordinal.  A level that does not occur gives no chunks.  Numbering runs over one document
    at a time, never over the table.
    """
    if (document_id is None) == (document_col is None):
        raise ValueError("give document_id or document_col")
    document = F.lit(document_id) if document_col is None else F.col(f"`{document_col}`")
    order = Window.partitionBy("document").orderBy(*NUMBERS).rowsBetween(Window.unboundedPreceding, 0)
    rows = table.withColumn("document", document).withColumn("coord", F.struct(*[F.col(n) for n in NUMBERS]))
    rows = rows.withColumns({f"n_{name}": F.when(F.col("level") >= i, F.sum(F.when(F.col("level") == i, 1).otherwise(0)).over(order)) for i, name in enumerate(LEVELS, 1)})
    key = lambda name: F.struct("document", F.lit(name).alias("level"), F.col(f"n_{name}").alias("ordinal"))
    box = ["left", "top", "width", "height"]
    words = rows.filter("level = 5")
    atoms = words.select(*box, "text", F.col("conf").alias("confidence"), F.col("n_word").alias("ordinal"), key("word").alias("id"), F.col("coord").alias("tesseract_coord"), "document", *[key(n).alias(f"_{n}") for n in LEVELS[:-1]])
    corpus = Corpus(atoms.drop(*[f"_{n}" for n in LEVELS[:-1]]))
    plain = [F.col(c) for c in corpus.atoms.columns]

    def attach(name: str, chunks: DataFrame, chunk) -> None:
        corpus.set_chunk(name, Chunks(corpus, chunks, joined=atoms.select(*plain, chunk.alias("_chunk"))), persist=False)

    attach("document", rows.select(F.col("document").alias("id")).distinct(), F.col("document"))
    for i, name in enumerate(LEVELS[:-1], 1):
        parent = F.col("document") if i == 1 else key(LEVELS[i - 2])
        shape = ["width", "height"] if i == 1 else box
        chunks = rows.filter(F.col("level") == i).select(parent.alias("document" if i == 1 else LEVELS[i - 2]), *shape, F.col(f"n_{name}").alias("ordinal"), key(name).alias("id"))
        attach(name, chunks, F.col(f"_{name}"))
    return corpus


def corpus_from_tesseract_documents(docs: DataFrame, document_col: str, rows_col: str) -> Corpus:
    """``corpus_from_tesseract_table`` of a table with a row for each document and its Tesseract rows in an array.

    Levels are counted and chunks are intervals inside the row: nothing is shuffled, and a document
    must fit a row.  An array may be null or empty and its rows in any order; null rows are skipped.
    """
    own, words, table, name = "__document", "__words", "__rows", (lambda level: f"__{level}")
    rows = F.coalesce(F.col(f"`{rows_col}`"), F.array())
    ordered = F.sort_array(F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.struct(*[r[n].alias(n) for n in NUMBERS], r["level"].alias("level"), *[r[n].alias(n) for n in (*BOX, "conf", "text")])))
    # Counted off the rows as they come: who asks for numbers of chunks only needs no order and no intervals.
    at_level = lambda i: lambda r: r["level"] == i
    tallies = [f"__count_{level}" for level in LEVELS]
    docs = docs.select(F.col(f"`{document_col}`").alias("id"), F.col(f"`{document_col}`").alias(own), ordered.alias(table), *[F.size(F.filter(rows, at_level(i))).alias(n) for i, n in enumerate(tallies, 1)])
    # Containers with the number of words before them: that is their place less the containers before.
    held = F.filter(F.transform(table, lambda r, i: F.when(r["level"] < len(LEVELS), F.struct(r.alias("row"), i.alias("at")))), lambda c: c.isNotNull())
    held = F.transform(held, lambda c, i: F.struct(c["row"].alias("row"), (c["at"] - i).alias("before")))
    docs = docs.select("id", own, F.filter(table, lambda r: r["level"] == len(LEVELS)).alias(words), fenced(held).alias("__held"), *tallies)
    key = lambda level, n: F.struct(F.col(own).alias("document"), F.lit(level).alias("level"), n.alias("ordinal"))
    spans, levels = (lambda i: f"__at_{i}"), range(1, len(LEVELS))

    def placed(i: int) -> Column:
        """The rows of a level with the places of the words up to the next of them; a row's number is its place here."""
        made = lambda c, end: F.struct(c["row"].alias("row"), c["before"].alias("_a"), (F.coalesce(end, F.size(words)) - 1).alias("_b"))
        return let(F.filter("__held", lambda c: c["row"]["level"] == i), lambda kept: F.zip_with(kept, F.slice(F.transform(kept, lambda c: c["before"]), 2, F.greatest(F.size(kept) - 1, F.lit(0))), made))

    def parents(i: int) -> Column:
        """For each row of a level the number of the level above."""
        each = F.zip_with("__held", f"__n.n{i - 1}", lambda c, n: F.struct((c["row"]["level"] == i).alias("own"), n.alias("n")))
        return F.transform(F.filter(each, lambda x: x["own"]), lambda x: x["n"])

    def items(i: int) -> Column:
        shape = BOX[2:] if i == 1 else BOX
        of = "document" if i == 1 else LEVELS[i - 2]
        made = lambda c, j, parent: F.struct(parent.alias(of), *[c["row"][n].alias(n) for n in shape], j.alias("ordinal"), key(LEVELS[i - 1], j).alias("id"), c["_a"].alias("_a"), c["_b"].alias("_b"))
        number = lambda j: (j + 1).cast("bigint")
        if i == 1:
            return F.transform(spans(i), lambda c, j: made(c, number(j), F.col(own)))
        both = F.zip_with(spans(i), f"__parent_{i}", lambda c, n: F.struct(c.alias("c"), n.alias("n")))
        return F.transform(both, lambda z, j: made(z["c"], number(j), key(LEVELS[i - 2], z["n"])))

    def numbers(i: int) -> Column:
        """For each word the number of the level's chunk that it is in; 0 before the first."""
        own_places = F.transform(spans(i), lambda c, j: F.array_repeat((j + 1).cast("bigint"), c["_b"] - c["_a"] + 1))
        before = F.coalesce(F.get(F.col(spans(i)), F.lit(0))["_a"], F.size(words))
        return F.flatten(F.concat(F.array(F.array_repeat(F.lit(0).cast("bigint"), before)), own_places))

    # Counted, in Python, is only what tells the containers' parents: who does not ask for them never runs it.
    docs = docs.select("id", own, words, "__held", *[fenced(placed(i)).alias(spans(i)) for i in levels], *tallies)
    docs = docs.withColumn("__n", running_counts(F.transform("__held", lambda c: c["row"]["level"].cast("int")), len(LEVELS) - 1))
    docs = docs.select("id", own, words, *map(spans, levels), *[fenced(parents(i)).alias(f"__parent_{i}") for i in levels[1:]], *tallies)
    numbered = F.arrays_zip(F.col(words).alias("row"), *[numbers(i).alias(f"n{i}") for i in levels])
    docs = docs.select("id", own, fenced(numbered).alias(words), *[fenced(items(i)).alias(name(level)) for i, level in enumerate(LEVELS[:-1], 1)], *tallies)
    fields = {n: (lambda x, i, n=n: x["row"][n]) for n in (*BOX, "text")}
    fields |= {
        "confidence": lambda x, i: x["row"]["conf"],
        "ordinal": lambda x, i: (i + 1).cast("bigint"),
        "id": lambda x, i: key("word", (i + 1).cast("bigint")),
        "tesseract_coord": lambda x, i: F.struct(*[x["row"][n].alias(n) for n in NUMBERS]),
        "document": lambda x, i: F.col(own),
    }
    keys = {level: (lambda x, i=i: x[f"n{i}"]) for i, level in enumerate(LEVELS[:-1], 1)}
    frame = Frame(docs, words, fields, (own,), keys, consecutive=True, count=F.col(tallies[-1]))
    shapes = {level: [("document" if i == 1 else LEVELS[i - 2]), *(BOX[2:] if i == 1 else BOX), "ordinal", "id"] for i, level in enumerate(LEVELS[:-1], 1)}
    return corpus_of_frame(frame, {"document": Spans(frame, ["id"]), **{level: Spans(frame, shapes[level], F.col(name(level)), F.col(n), stored=True) for level, n in zip(LEVELS[:-1], tallies, strict=False)}})
