"""Relevance of chunks to a query by TF-IDF."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import TextScore
from .arrays import fenced, small_batches, term_counts

DEFAULT = r"(?u)\b\w\w+\b"


#: So many of the terms that most chunks have are broadcast at most, and of so many characters: some 15 MB.
FREQUENT, LONGEST = 1 << 18, 32
#: What has no term to look up is joined by; no term begins so.
NO_TERM = "\0"


class Tfidf(TextScore):
    """Dot product of a chunk's and the query's TF-IDF vectors, fitted on the chunks at hand.

    By default both have unit length and ``idf = ln((1 + n) / (1 + df)) + 1``, so the score is the
    cosine.  Query terms no chunk has count for nothing; chunks without terms score 0.

    Options: ``lowercase, token_pattern, stop_words`` (a list)``, ngram_range, binary, min_df, max_df,
    max_features, vocabulary, norm, use_idf, smooth_idf, sublinear_tf``, and, through an Arrow UDF,
    ``analyzer`` ("word", "char", "char_wb" or a callable)``, tokenizer, preprocessor, strip_accents``.
    """

    def __init__(self, stringifier: AttrExpr, query: str, *, lowercase: bool = True, token_pattern: str = DEFAULT, stop_words: list[str] | None = None, ngram_range: tuple[int, int] = (1, 1), binary: bool = False, min_df: float = 1, max_df: float = 1.0, max_features: int | None = None, vocabulary=None, norm: str | None = "l2", use_idf: bool = True, smooth_idf: bool = True, sublinear_tf: bool = False, analyzer: str | Callable = "word", tokenizer: Callable | None = None, preprocessor: Callable | None = None, strip_accents: str | Callable | None = None, **other):
        if other:
            raise TypeError(f"not supported: {sorted(other)}")
        if isinstance(stop_words, str):
            raise ValueError("stop_words must be a list of words; no list goes by a name")
        if norm not in ("l1", "l2", None):
            raise ValueError("norm must be l1, l2 or None")
        if not 1 <= ngram_range[0] <= ngram_range[1]:
            raise ValueError("ngram_range must be ascending from 1")
        self.stringifier, self.query = stringifier, query
        self.lowercase, self.token_pattern, self.stop_words, self.ngram_range = lowercase, token_pattern, frozenset(stop_words or ()), ngram_range
        self.binary, self.min_df, self.max_df, self.max_features, self.vocabulary = binary, min_df, max_df, max_features, None if vocabulary is None else list(vocabulary)
        self.norm, self.use_idf, self.smooth_idf, self.sublinear_tf = norm, use_idf, smooth_idf, sublinear_tf
        self.analyzer, self.tokenizer, self.preprocessor, self.strip_accents = analyzer, tokenizer, preprocessor, strip_accents

    def analyze(self, text: str) -> list[str]:
        """The terms of a text."""
        if callable(self.analyzer):
            return list(self.analyzer(text))
        if self.preprocessor is not None:
            text = self.preprocessor(text)
        else:
            text = text.lower() if self.lowercase else text
            if callable(self.strip_accents):
                text = self.strip_accents(text)
            elif self.strip_accents is not None:
                plain = unicodedata.normalize("NFKD", text)
                text = plain.encode("ascii", "ignore").decode() if self.strip_accents == "ascii" else "".join(c for c in plain if not unicodedata.combining(c))
        low, high = self.ngram_range
        if self.analyzer == "char":
            text = re.sub(r"\s\s+", " ", text)
            return [text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)]
        if self.analyzer == "char_wb":
            out = []
            for word in (f" {w} " for w in text.split()):
                for n in range(low, high + 1):
                    out += [word[i : i + n] for i in range(max(1, len(word) - n + 1))]
                    if n >= len(word):
                        break
            return out
        words = self.tokenizer(text) if self.tokenizer is not None else re.findall(self.token_pattern, text)
        words = [w for w in words if w not in self.stop_words]
        return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]

    def terms(self, text: Column) -> Column:
        """The terms of a string column, natively where the default analysis allows it."""
        plain = self.analyzer == "word" and self.tokenizer is None and self.preprocessor is None and self.strip_accents is None and self.token_pattern == DEFAULT
        if not plain:

            @F.pandas_udf("array<string>")
            def analyzed(values: pd.Series) -> pd.Series:
                return pd.Series([[] if v is None else self.analyze(v) for v in values])

            return analyzed(text)
        words = F.regexp_extract_all(F.lower(text) if self.lowercase else text, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
        if self.stop_words:
            words = F.filter(words, lambda w: ~w.isin(sorted(self.stop_words)))
        low, high = self.ngram_range
        if (low, high) == (1, 1):
            return words
        grams = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.array(*[grams(n) for n in range(low, high + 1)]))

    def _kept(self, df: Column) -> Column:
        """Whether a term of so many chunks is in the vocabulary, but for ``max_features``; ``_all`` is the number of chunks."""
        share = lambda x: F.lit(x) * F.col("_all") if isinstance(x, float) else F.lit(x)
        test = df > 0
        if self.vocabulary is None and (isinstance(self.min_df, float) or self.min_df > 1):
            test &= df >= share(self.min_df)
        if self.vocabulary is None and not (isinstance(self.max_df, float) and self.max_df == 1.0):
            test &= df <= share(self.max_df)
        return test

    def _idf(self, df: Column) -> Column:
        more = 1 if self.smooth_idf else 0
        return F.log((F.col("_all") + more) / (df + more)) + 1 if self.use_idf else F.lit(1.0)

    def _weight(self, tf: Column) -> Column:
        return F.lit(1.0) if self.binary and not self.sublinear_tf else (F.lit(1.0) if self.binary else F.log(tf.cast("double")) + 1) if self.sublinear_tf else tf.cast("double")

    def _length(self, weights: Column) -> Column:
        return {"l2": F.sqrt(F.sum(weights * weights)), "l1": F.sum(F.abs(weights)), None: F.lit(1.0)}[self.norm]

    def _terms_of_all(self, rows: DataFrame) -> DataFrame:
        """(term, every, df, sum) of all terms, and a row with ``every`` that counts the chunks; how often a term is there counts only where features are ranked by it.

        The term is fenced, so that no filter or join goes below the counts: all that reads them shares one pass over the chunks and one exchange.
        """
        one = lambda t, tf, every: F.struct(t.alias("term"), tf.cast("bigint").alias("tf"), F.lit(every).alias("every"))
        ranked = self.max_features is not None and not self.binary
        once = F.transform(term_counts("terms"), lambda x: one(x["term"], x["tf"], False)) if ranked else F.transform(F.array_distinct("terms"), lambda t: one(t, F.lit(1), False))
        found = rows.select(F.explode(F.concat(once, F.array(one(F.lit(""), F.lit(1), True)))).alias("x"))
        counts = found.groupBy(F.col("x.term").alias("term"), F.col("x.every").alias("every")).agg(F.count(F.lit(1)).alias("df"), F.sum("x.tf").alias("sum"))
        return counts.select(fenced(F.col("term")).alias("term"), fenced(F.col("every")).alias("every"), "df", "sum")

    def _all(self, df: DataFrame, *also: Column) -> DataFrame:
        """One row: ``_all``, the number of chunks, and other aggregates of ``_terms_of_all``."""
        return df.agg(F.coalesce(F.max(F.when(F.col("every"), F.col("df"))), F.lit(0).cast("bigint")).alias("_all"), *also)

    def _asked(self, df: DataFrame, asked: Counter) -> DataFrame:
        """One row: the number of chunks and the length of the query, out of how many chunks have each of its terms."""
        names = sorted(asked)
        told = lambda t: F.coalesce(F.max(F.when(~F.col("every") & (F.col("term") == t), F.col("df"))), F.lit(0).cast("bigint"))
        counts = self._all(df, *[told(t).alias(f"_{i}") for i, t in enumerate(names)])
        known = lambda i, t: self._kept(F.col(f"_{i}")) if self.vocabulary is None or t in self.vocabulary else F.lit(False)
        weights = [F.when(known(i, t), self._weight(F.lit(asked[t])) * self._idf(F.col(f"_{i}"))).otherwise(0.0) for i, t in enumerate(names)]
        size = {"l2": lambda: F.sqrt(sum(w * w for w in weights)), "l1": lambda: sum(F.abs(w) for w in weights), None: lambda: F.lit(1.0)}[self.norm]
        return counts.select("_all", (size() if weights else F.lit(0.0)).alias("_query"))

    def score(self, texts: DataFrame) -> DataFrame:
        small_batches(texts.sparkSession)
        rows = texts.select("id", self.terms(F.coalesce("value", F.lit(""))).alias("terms"))
        asked = Counter(self.analyze(self.query))
        df = self._terms_of_all(rows)
        df = df.filter("NOT every").crossJoin(F.broadcast(self._asked(df, asked)))
        df = df.filter(self._kept(F.col("df")) if self.vocabulary is None else F.col("term").isin(self.vocabulary))
        if self.max_features is not None and self.vocabulary is None:
            df = df.orderBy(F.desc("sum"), "term").limit(self.max_features)
        # The query's length goes along with each term: read apart, it would be another pass over the chunks.
        idf = df.select("term", "df", self._idf(F.col("df")).alias("idf"), "_query")
        pairs = [x for t, n in sorted(asked.items()) for x in (F.lit(t), self._weight(F.lit(n)))]
        qtf = F.coalesce(F.element_at(F.create_map(*pairs), F.col("term")), F.lit(0.0)) if pairs else F.lit(0.0)
        if self.max_features is not None and self.vocabulary is None:
            # Which of the query's terms are features is known by the ranking only.
            idf = idf.drop("_query").crossJoin(F.broadcast(idf.agg(F.coalesce(self._length(qtf * F.col("idf")), F.lit(0.0)).alias("_query"))))
        # Chunks without a term of the query score 0: they go along as one row each.
        hit = F.arrays_overlap("terms", F.array(*[F.lit(t) for t in sorted(asked)])) if asked else F.lit(False)
        counts = rows.select("id", F.explode_outer(term_counts(F.when(hit, F.col("terms")))).alias("x")).select("id", F.col("x.term").alias("term"), F.col("x.tf").alias("tf"))
        # Most of them are looked up in a table of frequent terms and summed up where they are; what is left is shuffled.
        often = idf.orderBy(F.length("term") > LONGEST, F.desc("df"), "term").limit(FREQUENT).select(F.when(F.length("term") <= LONGEST, F.col("term")).alias("_t"), "idf", "_query")
        here = counts.join(F.broadcast(often), F.col("term") == F.col("_t"), "left")
        w = self._weight(F.col("tf")) * F.col("idf")
        parts = {None: lambda x: F.lit(0.0), "l1": F.abs, "l2": lambda x: x * x}[self.norm]
        own = [F.sum(w * qtf * F.col("idf")).alias("dot"), F.sum(parts(w)).alias("own"), F.max("_query").alias("query")]
        here = here.groupBy("id", F.when(F.col("idf").isNull(), F.col("term")).alias("term"), F.when(F.col("idf").isNull(), F.col("tf")).alias("tf")).agg(*own)
        # Null keys would all meet in one task.
        there = here.withColumn("term", F.coalesce("term", F.concat(F.lit(NO_TERM), F.pmod(F.xxhash64("id"), F.lit(4096)).cast("string")))).join(idf, "term", "left")
        asked_for = F.max(F.coalesce("query", "_query")).alias("query")
        total = lambda name, rest: F.sum(F.coalesce(name, F.lit(0.0)) + F.coalesce(rest, F.lit(0.0)))
        scored = there.groupBy("id").agg(total("dot", w * qtf * F.col("idf")).alias("dot"), total("own", parts(w)).alias("own"), asked_for)
        scored = scored.withColumn("own", {"l2": F.sqrt("own"), "l1": F.col("own"), None: F.lit(1.0)}[self.norm])
        value = F.when(F.col("own") * F.col("query") > 0, F.col("dot") / (F.col("own") * F.col("query"))).otherwise(F.lit(0.0))
        return scored.select("id", F.coalesce(value, F.lit(0.0)).alias("value"))
