"""Names of attributes that look like the library's own, and options of Tfidf."""

import pytest
from pyspark.sql import functions as F

from loomtext import AtomData, Corpus, RegexCount, SimpleStringify, Tfidf, corpus_from_documents


def corpus_of(spark, texts, **columns):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return corpus_from_documents(docs.withColumns({k: F.lit(v) for k, v in columns.items()}))


def test_attributes_with_names_of_the_library(spark):
    chunks = corpus_of(spark, ["a b", "c"], _id=7, _chunk=8, _n=9, _agg0=10, _new_s=11, id=12).chunk("document")
    assert chunks.chunks.columns == ["id", "_id", "_chunk", "_n", "_agg0", "_new_s", "id_"]
    got = chunks.enrich(n=RegexCount(SimpleStringify(), "[a-z]")).select("_id", "_chunk", "_n", "_agg0", "_new_s", "id_", "n", s=SimpleStringify(), w=AtomData("text"))
    assert sorted(map(tuple, got.collect())) == [(7, 8, 9, 10, 11, 12, 1, "c", ["c"]), (7, 8, 9, 10, 11, 12, 2, "a b", ["a", "b"])]


def test_atoms_cannot_have_the_bridge_column(spark):
    with pytest.raises(ValueError, match="_chunk"):
        Corpus(spark.createDataFrame([(1, 2)], "id int, _chunk int"))


def scores(chunks, query, **options):
    return {r["id"]: round(r["s"], 6) for r in chunks.select("id", s=Tfidf(SimpleStringify(), query, **options)).collect()}


def test_min_df_of_one_as_count_and_as_share(spark):
    chunks = corpus_of(spark, ["aa bb", "bb cc"]).chunk("document")
    assert scores(chunks, "aa", min_df=1.0) == {0: 0, 1: 0}
    assert scores(chunks, "aa", min_df=1)[0] == round((1.405465 / (1.405465**2 + 1) ** 0.5), 6)


def test_max_features_of_binary_counts(spark):
    chunks = corpus_of(spark, ["aa aa aa bb", "bb cc"]).chunk("document")
    assert scores(chunks, "aa bb", max_features=1, binary=True) == {0: 1, 1: 1}
    assert scores(chunks, "aa bb", max_features=1) == {0: 1, 1: 0}


def test_stored_chunks_are_replaced(spark):
    corpus = corpus_of(spark, ["a b"])
    first, second = corpus.chunk("document"), corpus.chunk("line")
    corpus.set_chunk("mine", first)
    assert corpus.chunk("mine").chunks.is_cached
    corpus.set_chunk("mine", second)
    assert not first.chunks.is_cached and corpus.chunk("mine") is second
    corpus.unpersist("mine")
