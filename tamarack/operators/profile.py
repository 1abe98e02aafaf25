"""Taste profiles for all users at once: vectors, facets, content recommendations, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import vectors as vx
from tamarack.functions.text import decade, with_prefix
from tamarack.operators.dense import top_products
from tamarack.operators.fusion import reciprocal_ranks

# Fixed values.
LIKED, OFFSET, FALLBACK_WEIGHT, REVIEW_SHARE = 3.5, 3.0, 0.5, 0.25
CONTENT_SHARE, COLLABORATIVE_SHARE, RRF_K = 1.0, 0.5, 20
TOP_FACETS, TOP_DECADES, FIRST_ACTORS = 6, 4, 5


def rating_weight(rating: Column) -> Column:
    """What is above 3 stars; 0.5 where nothing is."""
    w = F.greatest(F.lit(0.0), rating - OFFSET)
    return F.when(w > 0, w).otherwise(FALLBACK_WEIGHT)


def liked(ratings: DataFrame) -> DataFrame:
    """(user, item, weight) of the ratings that count as liking."""
    return ratings.where(F.col("rating") >= LIKED).select("user", "item", rating_weight(F.col("rating")).alias("weight"))


def taste(likes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user, taste): the unit vector of the weighted sum of the liked items' vectors (item, vector).

    Summed per dimension, so that partial sums are combined before the shuffle and no user's vectors are gathered.
    """
    parts = likes.join(vectors, "item").select("user", "weight", F.posexplode(vx.as_double(F.col("vector"))).alias("pos", "x"))
    sums = parts.groupBy("user", "pos").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    rows = sums.groupBy("user").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return rows.select("user", vx.unit(F.col("v")).alias("taste"))


def with_reviews(tastes: DataFrame, reviews: DataFrame, share: float = REVIEW_SHARE) -> DataFrame:
    """Tastes mixed with the weighted mean of what users wrote: `reviews` is (user, weight, vector)."""
    said = _mean(reviews)
    return tastes.join(said, "user", "left").select("user", vx.mix(F.col("taste"), F.col("said"), share).alias("taste"))


def review_text(review: Column, family: str = "e5", characters: int = 512) -> Column:
    """What an encoder reads of a review: its first characters, under the prefix of queries."""
    return with_prefix(F.substring(review, 1, characters), family, "query")


def stacked(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Two vectors of each key as one, so that one product is the sum of both; where the second lacks, zeros stand for it."""
    second = b.select(key, F.col(vector).alias("__b"))
    zeros = F.transform(F.col(vector), lambda _: F.lit(0.0))
    return a.join(second, key, "left").select(key, F.concat(vx.as_double(F.col(vector)), F.coalesce(vx.as_double(F.col("__b")), zeros)).alias(vector))


def _mean(reviews: DataFrame) -> DataFrame:
    parts = reviews.select("user", "weight", F.posexplode(vx.as_double(F.col("vector"))).alias("pos", "x"))
    sums = parts.groupBy("user", "pos").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    return sums.groupBy("user").agg(vx.unit(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])).alias("said"))


def content_recommendations(tastes: DataFrame, vectors: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """(user, item, score, rank from 0): the n items (item, vector) nearest to each taste that the user has not seen."""
    left = tastes.select(F.col("user").alias("l"), F.col("taste").alias("v"))
    gone = seen.select(F.col("user").alias("l"), F.col("item").alias("r")).join(left.select("l"), "l", "left_semi")
    best = top_products(left, vectors.select(F.col("item").alias("r"), F.col("vector").alias("v"), F.lit(0.0).alias("bias")), n, gone)
    return best.select(F.col("l").alias("user"), F.col("r").alias("item"), "score", (F.col("rank") - 1).alias("rank"))


def facet_weights(likes: DataFrame, facets: dict[str, DataFrame]) -> DataFrame:
    """(user, facet, value, weight): liked weight by value of each facet (item, value); one long table for all facets."""
    out = None
    for name, bridge in facets.items():
        part = likes.join(bridge, "item").select("user", F.lit(name).alias("facet"), "value", "weight")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("user", "facet", "value").agg(F.sum("weight").alias("weight"))


def top_facets(weights: DataFrame, top: int = TOP_FACETS, decades: int = TOP_DECADES) -> DataFrame:
    """The heaviest values of every facet, decades fewer than others; equal weights by value."""
    w = Window.partitionBy("user", "facet").orderBy(F.desc("weight"), "value")
    limit = F.when(F.col("facet") == "decades", decades).otherwise(top)
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def decades_of(catalogue: DataFrame) -> DataFrame:
    """(item, value) with the decade as text, for items with a year."""
    return catalogue.where(F.coalesce("year", F.lit(0)) != 0).select("item", F.concat(decade(F.col("year")).cast("string"), F.lit("s")).alias("value"))


def first_actors(credits: DataFrame, first: int = FIRST_ACTORS) -> DataFrame:
    """(item, value): names of the first actors by credit order, unordered ones first; `credits` is (item, name, credit_order)."""
    w = Window.partitionBy("item").orderBy(F.asc_nulls_first("credit_order"), "name")
    return credits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first).select("item", F.col("name").alias("value"))


def scalars(ratings: DataFrame, places: int = 2) -> DataFrame:
    """(user, n_rated, n_liked, avg_rating to so many places)."""
    return ratings.groupBy("user").agg(F.count(F.lit(1)).alias("n_rated"), F.count_if(F.col("rating") >= LIKED).alias("n_liked"), F.round(F.avg("rating"), places).alias("avg_rating"))


def fuse(content: DataFrame, collaborative: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """(user, item, score, rank): reciprocal ranks of both lists, (user, item, rank from 0), without what was seen."""
    pair = lambda df: df.select(F.struct("user", "item").alias("k"), "rank")
    both = reciprocal_ranks([(pair(content), CONTENT_SHARE), (pair(collaborative), COLLABORATIVE_SHARE)], "k", k=RRF_K).select("k.user", "k.item", "score")
    w = Window.partitionBy("user").orderBy(F.desc(F.round("score", 12)), "item")
    return both.join(seen.select("user", "item"), ["user", "item"], "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def reasons(recommended: DataFrame, top: DataFrame, facets: dict[str, DataFrame]) -> DataFrame:
    """(user, item, directors, genres): the user's heaviest director of the item, and up to two of its genres."""

    def shared(facet: str, keep: int) -> DataFrame:
        mine = top.where(F.col("facet") == facet).select("user", "value", "rank")
        hits = recommended.select("user", "item").join(facets[facet], "item").join(mine, ["user", "value"])
        listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"])
        return hits.groupBy("user", "item").agg(F.slice(listed, 1, keep).alias(facet))

    out = recommended.select("user", "item")
    for facet, keep in (("directors", 1), ("genres", 2)):
        if facet in facets:
            out = out.join(shared(facet, keep), ["user", "item"], "left")
    return out
