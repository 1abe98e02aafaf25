"""Batch commands: build the search index, train the factor model, evaluate titles as queries.

    python -m tamarack.cli build-index FOLDER INDEX
    python -m tamarack.cli train RATINGS MODEL [--factors 50] [--rounds 10]
    python -m tamarack.cli evaluate INDEX CASES

FOLDER holds movies, and genres, movie_genres, keywords, movie_keywords where there are any; RATINGS is a table (user_id,
movie_id, rating); CASES a table (case, query, hint, year). Vectors come from a model and are added by `SearchEngine`.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import collaborative as cf
from tamarack.operators import evaluate as ev
from tamarack.operators.bm25 import Bm25Index
from tamarack.operators.catalogue import once
from tamarack.operators.search import SearchEngine
from tamarack.runtime import cut, path_of, ship, table


def build_index(spark: SparkSession, folder: str, index: str) -> None:
    """Index of the catalogue in `folder`, saved at `index`."""

    def optional(name: str) -> DataFrame | None:
        fs, p = path_of(spark, f"{folder}/{name}.parquet")
        return table(spark, folder, name) if fs.exists(p) else None

    rows = once(table(spark, folder, "movies").where("tmdb_id IS NOT NULL"), "tmdb_id", F.desc_nulls_last("vote_count"), F.desc_nulls_last("popularity"), F.asc_nulls_first("title"))
    films = cut(rows.select(F.col("tmdb_id").alias("id"), "title", "overview", F.col("release_year").alias("year"), F.col("original_language").alias("language"), F.col("vote_count").alias("votes"), "vote_average", "popularity"))
    parts = {}
    genres, bridge = optional("genres"), optional("movie_genres")
    if genres is not None and bridge is not None:
        parts["genres"] = bridge.dropna().distinct().join(genres, "genre_id").select(F.col("tmdb_id").alias("id"), "name")
    keywords, bridge = optional("keywords"), optional("movie_keywords")
    if keywords is not None and bridge is not None:
        parts["keywords"] = keywords.where("name IS NOT NULL").select(F.col("keyword_id").alias("entity"), "name")
        parts["keyword_bridge"] = bridge.dropna().distinct().select(F.col("keyword_id").alias("entity"), F.col("tmdb_id").alias("id"))
    SearchEngine(films, Bm25Index.build(films, "id", "overview"), **parts).save(index)


def train(spark: SparkSession, ratings: str, model: str, factors: int = cf.FACTORS, rounds: int = cf.ROUNDS) -> DataFrame:
    """Evaluates on a held-out tenth, then trains on all and saves factors and neighbours; one row (n, rmse, mae)."""
    rows = cut(cf.clean_ratings(spark.read.parquet(ratings), "user_id", "movie_id", "rating"))
    told = cut(cf.evaluate(rows, factors=factors, iterations=rounds))
    mu, items, _ = cf.train(rows, factors, rounds)
    items = cut(items)
    cf.save(model, mu, items, cf.neighbours(items))
    return told


def evaluate(spark: SparkSession, index: str, cases: str) -> DataFrame:
    """Mean reciprocal rank and hits of the cases' queries, all answered at once by the lexical signal."""
    engine = SearchEngine.load(spark, index)
    asked = cut(spark.read.parquet(cases))
    scores = cut(engine.index.batch(asked, "case", "query").select(F.col("query").alias("case"), "id", F.round("score", 9).alias("score")))
    targets = ev.resolve_targets(asked.select("case", "hint", "year"), engine.catalogue.select("id", "title", "year"))
    return ev.ranking_metrics(asked, ev.positions(scores, targets))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tamarack")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in (("build-index", ("folder", "index")), ("train", ("ratings", "model")), ("evaluate", ("index", "cases"))):
        command = commands.add_parser(name)
        for place in places:
            command.add_argument(place)
        if name == "train":
            command.add_argument("--factors", type=int, default=cf.FACTORS)
            command.add_argument("--rounds", type=int, default=cf.ROUNDS)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"tamarack {a.command}").getOrCreate()
    ship(spark)
    if a.command == "build-index":
        build_index(spark, a.folder, a.index)
    else:
        told = train(spark, a.ratings, a.model, a.factors, a.rounds) if a.command == "train" else evaluate(spark, a.index, a.cases)
        print(told.first().asDict())


if __name__ == "__main__":
    main()
