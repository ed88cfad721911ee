"""Corpora that are stored and read back: equal to what was stored, without an exchange where buckets save it."""

import re

import pytest
from pyspark.sql import functions as F

from loomtext import AtomData, ChunkDelimitedStringify, ChunkOverlap, Chunks, Corpus, FixedSizeChunk, RegexMatchChunk, SimpleStringify, Threshold, corpus_from_documents, corpus_from_rows, open_corpus, save_corpus
from loomtext.sources.store import scratch

TEXTS = ["a  b\n\n c\t", None, "", " \n ", "the 😀 the\nand the é\n\nthe end of the", "x " * 300, "a b c d e f g h i j k"]


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().sparkPlan().toString())) + len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def documents(spark, texts=TEXTS):
    # Attributes with names that the store has for itself.
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id bigint, text string, __atoms string, `__spans` int")
    corpus = corpus_from_documents(docs)
    corpus.set_chunk("window", corpus.chunk(FixedSizeChunk("document", 4, -2)), persist=False)
    corpus.set_chunk("match", corpus.chunk(RegexMatchChunk("document", "the|[w-y] ")), persist=False)
    return corpus


def by_bridge(corpus):
    out = Corpus(corpus.atoms)
    for name, c in corpus.chunks.items():
        out.chunks[name] = Chunks(out, c.chunks, c.chunk_atoms)
    return out


def stored(spark, corpus, **options):
    path = scratch(spark, "test")
    save_corpus(corpus, path, **options)
    return open_corpus(spark, path)


FORMS = {"rows": (lambda c: c, {}), "bridges": (by_bridge, {"buckets": 3}), "even bridges": (by_bridge, {"buckets": 3, "gathered": False})}


@pytest.mark.parametrize("form", list(FORMS))
def test_a_stored_corpus_is_the_same(spark, form):
    make, options = FORMS[form]
    own = make(documents(spark))
    got = stored(spark, own, **options)
    assert list(got.chunks) == list(own.chunks) and (got.chunk("line").spans is None) == (form != "rows")
    assert got.atoms.columns == own.atoms.columns and rows(got.atoms) == rows(own.atoms)
    for kind in own.chunks:
        a, b = own.chunk(kind), got.chunk(kind)
        assert a.chunks.columns == b.chunks.columns and rows(a.chunks) == rows(b.chunks)
        assert rows(a.bridge()) == rows(b.bridge())
        exprs = {"s": SimpleStringify("~"), "o": AtomData("ordinal"), "d": ChunkDelimitedStringify([("line", "|")]), "n": ChunkOverlap("window", "count"), "f": ChunkOverlap("line", "frac")}
        assert rows(a.select("id", **exprs)) == rows(b.select("id", **exprs))


def test_new_chunks_of_a_stored_corpus(spark):
    own, got = documents(spark), stored(spark, documents(spark))
    run = lambda c: rows(c.chunk(FixedSizeChunk("line", 2)).select("id", s=SimpleStringify()))
    assert run(got) == run(own)


def test_filtered_chunks_and_replaced_names(spark):
    own = documents(spark)
    own.set_chunk("line", own.chunk("line").filter(Threshold("ordinal", ">=", 1)), persist=False)
    own.set_chunk("window", own.chunk("match"), persist=False)
    got = stored(spark, own, buckets=2)
    assert got.chunk("line").spans is None
    for kind in own.chunks:
        assert rows(got.chunk(kind).select("id", s=SimpleStringify(), n=ChunkOverlap("line", "count"))) == rows(own.chunk(kind).select("id", s=SimpleStringify(), n=ChunkOverlap("line", "count")))


@pytest.mark.parametrize("form", list(FORMS))
def test_empty_corpora(spark, form):
    make, options = FORMS[form]
    got = stored(spark, make(documents(spark, [])) if form != "rows" else corpus_from_documents(spark.createDataFrame([], "doc_id bigint, text string")), **options)
    assert rows(got.atoms) == [] and rows(got.chunk("line").select("id", s=SimpleStringify(), n=ChunkOverlap("document", "count"))) == []


def test_null_ids_and_a_hot_chunk(spark):
    table = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3 and 1, i % 7) for i in range(200)], "k bigint, hot bigint, o int")
    own = corpus_from_rows(table, ["k"], {"hot": "hot", "o": "o"})
    got = stored(spark, own, buckets=3)
    for kind in own.chunks:
        assert rows(got.chunk(kind).select("id", v=AtomData("k"), n=ChunkOverlap("hot", "count"))) == rows(own.chunk(kind).select("id", v=AtomData("k"), n=ChunkOverlap("hot", "count")))


def test_stored_bridges_are_joined_where_they_lie(spark):
    table = spark.createDataFrame([(i, i % 11, i % 7) for i in range(300)], "k bigint, a bigint, b int")
    got = stored(spark, corpus_from_rows(table, ["k"], {"a": "a", "b": "b"}), buckets=4)
    a, b = got.chunk("a"), got.chunk("b")
    assert exchanges(a.select("id", v=AtomData("k"))) == 0
    assert exchanges(a.bridge().join(b.bridge().withColumnRenamed("chunk", "other"), "atom")) == 0
    assert exchanges(got.atoms.join(a.bridge(), got.atoms.id == a.bridge().atom)) == 0
    # By its bridges an overlap shuffles only the sums of chunks.
    assert exchanges(a.select("id", n=ChunkOverlap("b", "count"))) == 1


def test_rows_are_read_once_and_nothing_is_split_again(spark):
    df = stored(spark, documents(spark)).chunk("window").select("id", s=SimpleStringify())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1 and "split(" not in plan


def test_an_unfinished_store_cannot_be_opened(spark):
    with pytest.raises(Exception, match="(?i)path"):
        open_corpus(spark, scratch(spark, "test"))
