"""The application surface: each request of the service as a method that gives a DataFrame (or a small dict around one)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import catalogue as co
from tamarack.operators import collaborative as cf
from tamarack.operators import linkage as lk
from tamarack.operators import profile as pr
from tamarack.operators.search import SearchEngine
from tamarack.runtime import cut
from tamarack.sources import tables as so


class BadRequest(ValueError):
    """A request that misses what it needs."""


@dataclass
class Service:
    """Search and recommendation over one catalogue.

    `engine` holds the catalogue; `genre_lists` is (id, names); `facets` the profile facets (item, value) by name; `posters`
    (id, poster_path); `items`, `near` and `mu` the factor model, without which recommendations are by content alone.

    What a request writes for its plans goes with `runtime.scope`: a service that runs for long takes each request, and
    reads its result, inside one.
    """

    spark: SparkSession
    engine: SearchEngine
    genre_lists: DataFrame
    facets: dict[str, DataFrame]
    posters: DataFrame
    items: DataFrame | None = None
    near: DataFrame | None = None
    mu: float = 0.0

    def health(self) -> dict:
        return {"status": "ok"}

    def genres(self) -> DataFrame:
        return self.genre_lists.select(F.explode("names").alias("name")).where("name <> ''").distinct().orderBy("name")

    def search(self, request: dict) -> DataFrame:
        """Keys: query, director, actor, n (1..50, else 12), year_min, year_max, genre, language."""
        text = {k: str(request.get(k) or "").strip() for k in ("query", "director", "actor")}
        if not any(text.values()):
            raise BadRequest("a query, a director or an actor is needed")
        filters = {}
        for k in ("year_min", "year_max"):
            try:
                filters[k] = int(request[k])
            except (KeyError, TypeError, ValueError):
                pass
        filters |= {k: request[k] for k in ("genre", "language") if request.get(k)}
        found = self.engine.combined(**text, n=co.clamp(request.get("n", 12), 1, 50, 12), filters=filters or None)
        return co.with_posters(found, self.posters)

    def people(self, q: str, role: str | None = None) -> DataFrame:
        return co.suggest_people(self.engine.people, self.engine.credits, q, role, 10)

    def get_movies(self) -> DataFrame:
        listed = self.engine.catalogue.select("id", F.coalesce("title", F.lit("")).alias("title")).join(self.genre_lists, "id", "left")
        return listed.select(F.col("id").alias("movie_id"), "title", F.coalesce("names", F.array().cast("array<string>")).alias("genres")).orderBy("title", "movie_id")

    def popular(self, n=48, offset=0) -> DataFrame:
        page = co.popular(self.engine.catalogue, co.clamp(n, 1, 120, 48), co.clamp(offset, 0, 1 << 31, 0))
        return co.with_posters(page.select("id", "title", F.col("year").alias("release_year")), self.posters)

    def submit_ratings(self, movie_ids: list, n: int = 15) -> dict:
        """Recommendations for chosen films, each as five stars."""
        raw = self.spark.createDataFrame([(None if x is None else str(x), k) for k, x in enumerate(movie_ids)], "v string, at long")
        rated = co.ordered_ids(raw, "v", "at").select(F.lit(0).cast("long").alias("user"), F.col("id").alias("item"), F.lit(5.0).alias("rating"))
        if rated.isEmpty():
            raise BadRequest("at least one film is needed")
        return self.from_profile(rated, n)

    def recommend(self, path: str, n=20, resolver: str = "auto") -> dict:
        """Recommendations from a ratings export."""
        parsed = so.parse_ratings(so.ratings_csv(self.spark, path)).withColumn("row", F.monotonically_increasing_id())
        resolved = cut(lk.import_ratings(cut(parsed), self.engine.catalogue, resolver))
        matched = resolved.where("id IS NOT NULL")
        rate = lk.match_rate(resolved).first()
        if not rate["matched"]:
            raise BadRequest("no film of the export is in the catalogue")
        rated = matched.groupBy(F.lit(0).cast("long").alias("user"), F.col("id").alias("item")).agg(F.avg("rating").alias("rating"))
        return {"total_rows": rate["total"], "matched": rate["matched"], "match_rate": round(rate["rate"], 3), **self.from_profile(rated, co.clamp(n, 1, 50, 20))}

    def from_profile(self, rated: DataFrame, n: int) -> dict:
        """{profile, facets, recommendations} of the users in `rated` (user, item, rating): content and collaborative ranks fused."""
        rated = cut(rated)
        likes = pr.liked(rated)
        vectors = self.engine.vectors.select(F.col("id").alias("item"), "vector")
        content = pr.content_recommendations(pr.taste(likes, vectors), vectors, rated, 3 * n)
        collaborative = content.limit(0)
        if self.items is not None and self.near is not None:
            popular = self.engine.catalogue.select(F.col("id").alias("item"), "popularity")
            collaborative = cf.recommend(rated, rated, self.items, self.near, popular, self.mu, 3 * n).withColumn("rank", F.col("rank") - 1)
        best = pr.fuse(content, collaborative, rated, n)
        top = pr.top_facets(pr.facet_weights(likes, self.facets))
        named = best.join(self.engine.catalogue.select(F.col("id").alias("item"), "title", F.col("year").alias("release_year"), "vote_average", F.substring(F.coalesce("overview", F.lit("")), 1, 240).alias("overview")), "item", "left")
        why = pr.reasons(best, top, {k: v for k, v in self.facets.items() if k in ("directors", "genres")})
        out = named.join(why, ["user", "item"], "left").withColumnRenamed("item", "id")
        return {"profile": pr.scalars(rated), "facets": top, "recommendations": co.with_posters(out, self.posters).orderBy("user", "rank")}
