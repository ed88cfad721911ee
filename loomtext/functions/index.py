"""An inverted index of chunks' terms, written once and asked any number of queries in one pass.

Under its folder lie ``postings`` (part, term, id, weight), ``terms`` (part, term, df, idf) and ``lengths``
(id, length).  ``part`` is a hash of the term and the folder that it lies in, so queries read
their terms' parts only, and inside them, as files are sorted by term, few row groups.  A term that
very many chunks have is dealt to several files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .arrays import small_batches, term_counts
from .scoring import FREQUENT, LONGEST, Tfidf

#: Folders of terms, and postings of one term that go to a file.
PARTS, HOT = 64, 1_000_000
#: Terms of queries that the scan is told of, and of which the table is broadcast; with more the join alone finds them.
ASKED = 10_000


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


class TermIndex:
    """TF-IDF weights of all terms of some chunks, by term.

    ``expr`` says how texts are analysed and weighted (its own query is of no account; ``max_features`` is
    refused).  Chunks without a string have no terms.  Ids may be of any type that can be grouped by
    and should differ.
    """

    def __init__(self, spark: SparkSession, path: str, expr: Tfidf):
        self.spark, self.path, self.expr = spark, path, expr
        self._id: DataType | None = None

    @property
    def _norm(self):
        return {None: lambda x: F.lit(0.0), "l1": F.abs, "l2": lambda x: x * x}[self.expr.norm]

    def _length(self, total: Column) -> Column:
        return {"l2": F.sqrt(total), "l1": total, None: F.lit(1.0)}[self.expr.norm]

    def _counts(self, texts: DataFrame, *keys: str) -> DataFrame:
        terms = texts.select(*keys, self.expr.terms(F.coalesce("value", F.lit(""))).alias("terms"))
        return terms.select(*keys, F.explode(term_counts("terms")).alias("x")).select(*keys, F.col("x.term").alias("term"), F.col("x.tf").alias("tf"))

    @classmethod
    def build(cls, texts: DataFrame, path: str, expr: Tfidf) -> TermIndex:
        """Index a table (id, value) of strings under ``path``, a folder that is not there yet or empty."""
        if expr.max_features is not None:
            raise ValueError("an index keeps all terms: max_features cannot be set")
        spark = texts.sparkSession
        small_batches(spark)
        self = cls(spark, path, expr)
        self._id = texts.schema["id"].dataType
        # Texts are taken apart once, and their terms kept until the index is written.
        texts.select("id", term_counts(expr.terms(F.coalesce("value", F.lit("")))).alias("x")).write.parquet(f"{path}/counts")
        held = spark.read.schema(f"id {self._id.simpleString()}, x array<struct<term:string,tf:bigint>>").parquet(f"{path}/counts")
        df = expr._terms_of_all(held.select("id", F.col("x.term").alias("terms")))
        df = df.filter("NOT every").crossJoin(F.broadcast(expr._all(df)))  # one row
        df = df.filter(expr._kept(F.col("df")) if expr.vocabulary is None else F.col("term").isin(expr.vocabulary))
        df = df.select(_part(F.col("term")).alias("part"), "term", "df", expr._idf(F.col("df")).alias("idf"))
        df.repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/terms")
        terms = self.terms()
        # Most postings find their term in a table that is broadcast; those of rare terms are shuffled.
        often = terms.orderBy(F.length("term") > LONGEST, F.desc("df"), "term").limit(FREQUENT).filter(F.length("term") <= LONGEST)
        counts = held.select("id", F.explode("x").alias("x")).select("id", "x.term", "x.tf").join(F.broadcast(often.select(F.col("term").alias("_t"), F.col("df").alias("_df"), F.col("idf").alias("_idf"))), F.col("term") == F.col("_t"), "left")
        rare = terms.join(F.broadcast(often.select("term")), "term", "left_anti").select("term", "df", "idf")
        weight = expr._weight(F.col("tf")) * F.col("idf")
        found = counts.filter("_t IS NOT NULL").select("id", "term", "tf", F.col("_df").alias("df"), F.col("_idf").alias("idf"))
        found = found.unionByName(counts.filter("_t IS NULL").select("id", "term", "tf").join(rare, "term"))
        salt = F.when(F.col("df") > HOT, F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / HOT))).otherwise(F.lit(0))
        found = found.select(_part(F.col("term")).alias("part"), salt.alias("salt"), "term", "id", weight.alias("weight"))
        found.repartition("part", "salt").sortWithinPartitions("part", "term").drop("salt").write.partitionBy("part").parquet(f"{path}/postings")
        self.postings().groupBy("id").agg(self._length(F.sum(self._norm(F.col("weight")))).alias("length")).write.parquet(f"{path}/lengths")
        counted = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/counts")
        counted.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(counted, True)
        return self

    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df bigint, idf double, part int").parquet(f"{self.path}/terms")

    def postings(self) -> DataFrame:
        if self._id is None:  # folders of an empty index hold no file to read the type from
            self._id = self.lengths().schema["id"].dataType
        return self.spark.read.schema(f"term string, id {self._id.simpleString()}, weight double, part int").parquet(f"{self.path}/postings")

    def lengths(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lengths")

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, value) of a table (query_id, value) of queries: for each the chunks that share a term with it; others score 0.

        A null query has no terms.  The value is that of ``Tfidf`` with the query.
        """
        asked = self._counts(queries.select("query_id", "value"), "query_id").withColumn("part", _part(F.col("term")))
        names = [r[0] for r in asked.select("term").distinct().limit(ASKED + 1).collect()]
        parts = [r[0] for r in asked.select("part").distinct().collect()]
        few = len(names) <= ASKED
        near = (lambda df: df.filter(F.col("part").isin(parts) & F.col("term").isin(names))) if few else (lambda df: df)
        hint = F.broadcast if few and asked.count() <= ASKED else (lambda df: df)
        weighed = near(self.terms()).join(hint(asked), ["part", "term"]).select("query_id", "part", "term", (self.expr._weight(F.col("tf")) * F.col("idf")).alias("asked"))
        sizes = weighed.groupBy("query_id").agg(self._length(F.sum(self._norm(F.col("asked")))).alias("query_length"))
        dots = near(self.postings()).join(hint(weighed), ["part", "term"]).groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("asked")).alias("dot"))
        out = dots.join(hint(sizes), "query_id").join(self.lengths().withColumnRenamed("id", "_i"), F.col("id").eqNullSafe(F.col("_i")))
        return out.select("query_id", "id", F.when(F.col("length") * F.col("query_length") > 0, F.col("dot") / (F.col("length") * F.col("query_length"))).otherwise(0.0).alias("value"))
