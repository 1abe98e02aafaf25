"""The pN_ queries over the tables of TESTDATA.md, with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.bpe import encode_corpus, token_counts
from tamarack.llm.cooccur import pairs_together
from tamarack.llm.match import match_entities
from tamarack.llm.mojibake import garbled
from tamarack.llm.packing import fill_containers
from tamarack.llm.reading import reading_levels
from tamarack.llm.setjoin import similar_links, similar_sets
from tamarack.llm.skeleton import look_alikes
from tamarack.llm.topn import top_n
from tamarack.runtime import table

#: Folder of the public tokenizers' files; never copied into the repository.
TOKENIZERS = os.environ.get("TAMARACK_TOKENIZERS", "/opt/tokenizers")
CAPACITY = 2048


def _facets(spark: SparkSession, d: str) -> DataFrame:
    """(tmdb_id, v): genres and keywords of films, of which equal numbers are two values."""
    genres = table(spark, d, "movie_genres").select("tmdb_id", (F.col("genre_id").cast("long") * 2).alias("v"))
    keywords = table(spark, d, "movie_keywords").select("tmdb_id", (F.col("keyword_id").cast("long") * 2 + 1).alias("v"))
    return genres.unionByName(keywords)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Films whose genres and keywords are nearly the same set."""
    pairs = similar_sets(_facets(spark, d), "tmdb_id", "v", threshold=0.6, min_size=6)
    return pairs.select(F.col("id_a").alias("tmdb_id_a"), F.col("id_b").alias("tmdb_id_b"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """The class of equal sets that each film is in, and the number of films whose set is nearly the same."""
    return similar_links(_facets(spark, d), "tmdb_id", "v", threshold=0.6, min_size=6).withColumnRenamed("id", "tmdb_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best rated films of every user."""
    rows = table(spark, d, "user_ratings").where("rating between 0.5 and 5.0")
    return top_n(rows, "user_id", "movie_id", "rating", 5).select("user_id", "movie_id")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Films rated by the same users, with counts, lift and conviction."""
    return pairs_together(table(spark, d, "user_ratings"), "user_id", "movie_id", min_together=8, min_lift=6.0)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pairs(spark, d).select(F.col("item_a").alias("movie_id_a"), F.col("item_b").alias("movie_id_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Films and rated entries whose titles look the same but are written with other characters."""
    return look_alikes(table(spark, d, "movies"), "tmdb_id", "title", table(spark, d, "ratings"), "row_id", "name")


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    """The film each rated entry speaks of, with a confidence. Garbled titles are searched in both forms."""
    year = F.coalesce("release_year", F.substring("release_date", 1, 4).try_cast("int"))
    movies = table(spark, d, "movies").select("tmdb_id", "title", year.alias("year"))
    restored = garbled(movies, "tmdb_id", ["title"]).where("chain <> ''").select("tmdb_id", F.col("text").alias("title"), "restored")
    both = movies.unionByName(movies.join(restored, ["tmdb_id", "title"]).select("tmdb_id", F.col("restored").alias("title"), "year"))
    return match_entities(table(spark, d, "ratings"), "row_id", "name", "year", both, "tmdb_id", "title", "year")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_matches(spark, d).select("row_id", "tmdb_id")


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled titles and overviews with the text as it was, as far as it can be regained."""
    return garbled(table(spark, d, "movies").where("tmdb_id IS NOT NULL"), "tmdb_id", ["title", "overview"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_restored(spark, d).select("tmdb_id", "field").distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of 2,048 tokens of every document, or of its pieces if it is longer."""
    sizes = token_counts(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")
    return fill_containers(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled: their number, the least number that could hold the tokens, the fullest, the share used; no row without tokens."""
    held = p9_containers(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    total = F.sum("n")
    return held.agg(F.count_if(F.col("n") > 0).alias("n_containers"), F.ceil(total / CAPACITY).alias("least"), F.max("n").alias("fullest"), F.round(total / (F.count_if(F.col("n") > 0) * CAPACITY), 4).alias("share_used")).where("n_containers > 0")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """The reading level of every document, calibrated by readers' judgements."""
    return reading_levels(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "doc_labels"), "doc_id", "reading_level").select("doc_id", "n_words", "level")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of at least 40 words on the scholarly level."""
    return p10_levels(spark, d).where("n_words >= 40 AND level = 4").select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_links": p1_links, "p2_found": p2_found, "p4_found": p4_found, "p4_pairs": p4_pairs, "p5_found": p5_found, "p6_found": p6_found, "p6_matches": p6_matches, "p7_found": p7_found, "p7_restored": p7_restored, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_levels": p10_levels, "p10_found": p10_found}

_BASKETS = "b AS (SELECT DISTINCT user_id, movie_id FROM user_ratings WHERE user_id IS NOT NULL AND movie_id IS NOT NULL), n AS (SELECT movie_id, count(*) AS n FROM b GROUP BY movie_id), t AS (SELECT count(DISTINCT user_id) AS n FROM b), c AS (SELECT x.movie_id AS a, y.movie_id AS b, count(*) AS n FROM b x JOIN b y ON x.user_id = y.user_id AND x.movie_id < y.movie_id GROUP BY 1, 2 HAVING count(*) >= 8)"

_SETS = """e AS (SELECT tmdb_id, 'g' || genre_id AS v FROM movie_genres WHERE tmdb_id IS NOT NULL AND genre_id IS NOT NULL
                   UNION SELECT tmdb_id, 'k' || keyword_id FROM movie_keywords WHERE tmdb_id IS NOT NULL AND keyword_id IS NOT NULL),
        z AS (SELECT tmdb_id, count(*) AS s FROM e GROUP BY tmdb_id HAVING count(*) >= 6),
        p AS (SELECT e.tmdb_id, e.v, z.s FROM e JOIN z ON e.tmdb_id = z.tmdb_id)"""
_SIMILAR = "SELECT x.tmdb_id AS a, y.tmdb_id AS b FROM p x JOIN p y ON x.v = y.v AND x.tmdb_id < y.tmdb_id GROUP BY x.tmdb_id, y.tmdb_id, x.s, y.s HAVING 10 * count(*) >= 6 * (x.s + y.s - count(*))"

ORACLE = {
    "p1_found": f"WITH {_SETS} SELECT a AS tmdb_id_a, b AS tmdb_id_b FROM ({_SIMILAR})",
    "p1_links": f"""WITH {_SETS}, l AS ({_SIMILAR}), u AS (SELECT a FROM l UNION ALL SELECT b FROM l), c AS (SELECT tmdb_id, list(v ORDER BY v) AS vs FROM p GROUP BY 1)
        SELECT tmdb_id, min(tmdb_id) OVER (PARTITION BY vs) AS class_id, (SELECT count(*) FROM u WHERE u.a = c.tmdb_id) AS n_links FROM c""",
    "p2_found": """
        WITH r AS (SELECT user_id, movie_id, max(rating) AS rating FROM user_ratings
                   WHERE user_id IS NOT NULL AND movie_id IS NOT NULL AND rating >= 0.5 AND rating <= 5.0 GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, movie_id) AS rn FROM r)
        SELECT user_id, movie_id FROM k WHERE rn <= 5""",
    "p4_found": f"""
        WITH {_BASKETS}
        SELECT c.a AS movie_id_a, c.b AS movie_id_b FROM c JOIN n x ON x.movie_id = c.a JOIN n y ON y.movie_id = c.b, t
        WHERE c.n * t.n >= 6 * x.n * y.n""",
    "p4_pairs": f"""
        WITH {_BASKETS}
        SELECT c.a AS item_a, c.b AS item_b, x.n AS n_a, y.n AS n_b, c.n AS n_together, t.n AS n_baskets,
               CAST(c.n AS DOUBLE) * t.n / (CAST(x.n AS DOUBLE) * y.n) AS lift,
               CASE WHEN c.n < x.n THEN (1 - CAST(y.n AS DOUBLE) / t.n) / (1 - CAST(c.n AS DOUBLE) / x.n) END AS conviction
        FROM c JOIN n x ON x.movie_id = c.a JOIN n y ON y.movie_id = c.b, t
        WHERE c.n * t.n >= 6 * x.n * y.n""",
}
