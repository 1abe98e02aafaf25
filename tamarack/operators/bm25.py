"""BM25 over an inverted index: one row per document and term, from which all statistics are aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import of_request, tokens
from tamarack.runtime import cut

K1, B = 1.5, 0.75


def postings(df: DataFrame, key: str, text: str, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, tf): occurrences of every term in every document. Null keys are left out, null texts have no terms."""
    terms = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.explode(tokens(F.col(text))).alias("term"))
    if stopwords:
        terms = terms.where(~F.col("term").isin(*stopwords))
    return terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


@dataclass
class Bm25Index:
    """postings (id, term, tf, len), terms (term, df, idf) and the two numbers of the collection."""

    rows: DataFrame
    terms: DataFrame
    n_docs: int
    avgdl: float

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, stopwords: tuple[str, ...] = ()) -> Bm25Index:
        """Index of all documents. Documents without terms count in n_docs, not in the mean length."""
        n_docs = df.where(F.col(key).isNotNull()).select(key).distinct().count()
        p = cut(postings(df, key, text, stopwords))
        lengths = p.groupBy("id").agg(F.sum("tf").alias("len"))
        rows = cut(p.join(lengths, "id"))
        avgdl = lengths.agg(F.avg("len")).first()[0] or 1.0
        return cls(rows, cut(cls._terms(rows, n_docs)), n_docs, avgdl)

    @staticmethod
    def _terms(rows: DataFrame, n_docs: int) -> DataFrame:
        df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return df.withColumn("idf", F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))

    def save(self, path: str) -> None:
        """Write the index as parquet below `path`; ranges of terms lie together and in order, so that scans skip."""
        self.rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        meta = self.rows.sparkSession.createDataFrame([(self.n_docs, self.avgdl, K1, B)], "n_docs long, avgdl double, k1 double, b double")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bm25Index:
        meta = spark.read.parquet(f"{path}/meta").first()
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), meta["n_docs"], meta["avgdl"])

    def part(self, k1: float = K1, b: float = B) -> Column:
        """What one posting adds to its document's score."""
        return F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(self.avgdl)))

    def scores(self, query: str, k1: float = K1, b: float = B) -> DataFrame:
        """(id, score) of the documents with one of the distinct query terms at least."""
        asked = sorted(set(of_request(self.rows.sparkSession, terms=tokens(F.lit(query)))["terms"]))
        wanted = F.col("term").isin(*asked)  # pushed into the scan of a saved index
        # as many rows as one request string has words: broadcast
        hit = self.rows.where(wanted).join(F.broadcast(self.terms.where(wanted).select("term", "idf")), "term")
        return hit.groupBy("id").agg(F.sum(self.part(k1, b)).alias("score"))

    def batch(self, queries: DataFrame, key: str, text: str, k1: float = K1, b: float = B) -> DataFrame:
        """(query, id, score) for a table of queries; the planner picks the join by size."""
        asked = queries.select(F.col(key).alias("query"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
        return asked.join(self.terms, "term").join(self.rows, "term").groupBy("query", "id").agg(F.sum(self.part(k1, b)).alias("score"))


def tfidf(df: DataFrame, key: str, text: str, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, weight): tf times smoothed idf, ln((1 + n) / (1 + df)) + 1, each document at unit length."""
    n_docs = df.where(F.col(key).isNotNull()).select(key).distinct().count()
    p = cut(postings(df, key, text, stopwords))
    df_ = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = p.join(df_, "term").withColumn("w", F.col("tf") * (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))
