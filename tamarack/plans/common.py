"""Bindings of the operators' roles to the tables, and the SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import fold
from tamarack.operators.bm25 import Bm25Index
from tamarack.operators.catalogue import once
from tamarack.runtime import scope, scratch, table

QUERY = "a cantora protege o arquivo da estação durante o inverno"


def films(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with one row per film: of copies, the one with most votes."""
    m = table(spark, d, "movies").where("tmdb_id IS NOT NULL")
    return once(m, "tmdb_id", F.desc_nulls_last("vote_count"), F.desc_nulls_last("popularity"), F.asc_nulls_first("title"), F.asc_nulls_first("overview"))


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Films under the role names of the operators."""
    return films(spark, d).select(
        F.col("tmdb_id").alias("id"), "title", "overview", F.col("release_year").alias("year"), F.col("original_language").alias("language"),
        F.col("vote_count").alias("votes"), "vote_average", "popularity", F.col("runtime_minutes").alias("runtime"), "origin_countries", "release_date",
    )


FILMS = """films AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY tmdb_id ORDER BY vote_count DESC NULLS LAST, popularity DESC NULLS LAST, title NULLS FIRST, overview NULLS FIRST) AS rn
           FROM movies WHERE tmdb_id IS NOT NULL) WHERE rn = 1)"""

#: People: suppliers as persons, parts as films, the line status as role, the line number as credit order.
PEOPLE = """people AS (SELECT s_suppkey AS person, s_name AS name FROM supplier),
           credits AS (SELECT DISTINCT l_suppkey AS person, l_partkey AS id, CASE l_linestatus WHEN 'F' THEN 'director' ELSE 'actor' END AS role, min(l_linenumber) OVER (PARTITION BY l_suppkey, l_partkey, l_linestatus) AS credit_order FROM lineitem)"""


def people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("person"), F.col("s_name").alias("name"))


def credits(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    role = F.when(F.col("l_linestatus") == "F", "director").otherwise("actor")
    return li.groupBy(F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("id"), role.alias("role")).agg(F.min("l_linenumber").alias("credit_order"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as films that people are credited in."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("popularity"))


PARTS = "parts AS (SELECT p_partkey AS id, p_name AS title, p_retailprice AS popularity FROM part)"


def genre_bridge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "movie_genres").select(F.col("tmdb_id").alias("id"), "genre_id")


def keyword_bridge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "movie_keywords").select(F.col("tmdb_id").alias("id"), "keyword_id")


def genre_names(spark: SparkSession, d: str) -> DataFrame:
    """(id, name)"""
    g = table(spark, d, "genres")
    return genre_bridge(spark, d).dropna().distinct().join(F.broadcast(g), "genre_id").select("id", "name")


GENRES = "mg AS (SELECT DISTINCT tmdb_id AS id, name FROM movie_genres JOIN genres USING (genre_id) WHERE tmdb_id IS NOT NULL)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of documents: (id, vector)."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def keyword_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the themes: the next document's."""
    return vectors(spark, d).withColumn("id", F.col("id") - 1)


_indexes: dict[tuple[str, str, str], Bm25Index] = {}


def index_of(spark: SparkSession, d: str, name: str, rebuild: bool = False) -> Bm25Index:
    """The saved index of the documents' texts, or of the films' overviews or titles: built once in a session, read by every search."""
    key = (spark.sparkContext.applicationId, d, name)
    if rebuild or key not in _indexes:
        source, column, text = {"documents": (table(spark, d, "documents"), "doc_id", "text"), "overviews": (films(spark, d), "tmdb_id", "overview"), "titles": (films(spark, d), "tmdb_id", "title")}[name]
        path = scratch(spark, f"index-{name}", keep=True)
        with scope():
            Bm25Index.build(source, column, text).save(path)
        _indexes[key] = Bm25Index.load(spark, path)
    return _indexes[key]


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """(user, item, rating): the mean of the usable ratings of every user and film."""
    from tamarack.operators.collaborative import clean_ratings

    return clean_ratings(table(spark, d, "user_ratings"), "user_id", "movie_id", "rating")


RATINGS = "r AS (SELECT user_id AS u, movie_id AS i, avg(rating) AS rating FROM user_ratings WHERE user_id IS NOT NULL AND movie_id IS NOT NULL AND rating BETWEEN 0.5 AND 5.0 GROUP BY 1, 2)"



def fold_sql(column: str) -> str:
    return rf"regexp_replace(strip_accents(lower({column})), '\p{{M}}+', '', 'g')"


def plain_form(text):
    """Lower case, accents folded; every other character stays what it is."""
    return fold(F.lower(text))


def edits_sql(a: str, b: str) -> str:
    """Edit distance in characters: the engine's own counts bytes, so beyond ASCII each character of the two is given
    a sign of one byte first."""
    signs = lambda x: f"coalesce(list_aggregate([chr(33 + CAST(list_position(list_distinct(string_split({a} || {b}, '')), c) AS INTEGER)) FOR c IN string_split({x}, '')], 'string_agg', ''), '')"
    return f"(CASE WHEN strlen({a}) = length({a}) AND strlen({b}) = length({b}) THEN levenshtein({a}, {b}) ELSE levenshtein({signs(a)}, {signs(b)}) END)"


def alike_sql(a: str, b: str) -> str:
    """1 - edit distance / longer length."""
    return f"(1 - {edits_sql(a, b)}::DOUBLE / greatest(length({a}), length({b}), 1))"


def tokens_sql(column: str) -> str:
    return rf"regexp_extract_all({fold_sql(column)}, '[\p{{L}}\p{{N}}_]{{2,}}')"


def postings_sql(source: str, key: str, text: str) -> str:
    """CTEs p (id, term, tf, len), st (n, avgdl) and dfs (term, df)."""
    return f"""w AS (SELECT {key} AS id, unnest({tokens_sql(text)}) AS term FROM {source} WHERE {key} IS NOT NULL),
        tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY 1, 2), ln AS (SELECT id, CAST(sum(tf) AS BIGINT) AS len FROM tf GROUP BY 1),
        p AS (SELECT tf.id, term, tf, len FROM tf JOIN ln ON tf.id = ln.id),
        st AS (SELECT (SELECT count(DISTINCT {key}) FROM {source}) AS n, coalesce(avg(len), 1.0) AS avgdl FROM ln), dfs AS (SELECT term, count(*) AS df FROM p GROUP BY 1)"""


IDF = "ln(1 + (st.n - dfs.df + 0.5) / (dfs.df + 0.5))"
BM25 = f"sum({IDF} * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.len / st.avgdl)))"
