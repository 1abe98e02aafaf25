"""Queries of collaborative filtering, taste profiles, linkage, evaluation, the older recommender and streams.

A film's vector is the one whose number is the film's id modulo the number of vectors. Only the searches that score users
against the whole catalogue ask for the users whose id is divisible by 20.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions import vectors as vx
from tamarack.functions.models import encode, hashed_encoder
from tamarack.functions.similarity import edit_similarity
from tamarack.operators import collaborative as cf
from tamarack.operators import evaluate as ev
from tamarack.operators import linkage as lk
from tamarack.operators import profile as pr
from tamarack.operators.bm25 import tfidf
from tamarack.operators.fusion import top
from tamarack.plans.common import BM25, FILMS, GENRES, PEOPLE, QUERY, RATINGS, alike_sql, catalogue, credits, films, fold_sql, genre_names, index_of, people, plain_form, postings_sql, ratings, tokens_sql, vectors
from tamarack.runtime import cut, table
from tamarack.streaming import popularity as sp

MU = 3.5


def _film_vectors(spark: SparkSession, d: str, step: int = 0) -> DataFrame:
    """(item, qi, bi): the film's vector, or one `step` further, and its rating's distance from 6 as bias."""
    v = vectors(spark, d)
    n = v.agg(F.count(F.lit(1)).alias("n"))
    numbered = films(spark, d).select(F.col("tmdb_id").alias("item"), ((F.coalesce("vote_average", F.lit(6.0)) - 6) / 4).alias("bi")).crossJoin(F.broadcast(n))
    return numbered.withColumn("id", F.pmod(F.col("item") + step, "n")).join(v, "id").select("item", F.col("vector").alias("qi"), "bi")


_VECTORS = "fv AS (SELECT tmdb_id AS i, embedding::DOUBLE[] AS v, (coalesce(vote_average, 6.0) - 6) / 4 AS bi FROM films JOIN embeddings ON vec_id = tmdb_id % (SELECT count(*) FROM embeddings))"


def _asked(df: DataFrame) -> DataFrame:
    return df.where(F.col("user") % 20 == 0)


# ---------------------------------------------------------------- collaborative


def rating_stats(spark: SparkSession, d: str) -> DataFrame:
    """Usable ratings, users, films and the mean."""
    r = ratings(spark, d)
    return r.agg(F.count(F.lit(1)).alias("n_ratings"), F.countDistinct("user").alias("n_users"), F.countDistinct("item").alias("n_items"), F.round(F.avg("rating"), 6).alias("mu"))


def damped_biases(spark: SparkSession, d: str) -> DataFrame:
    """Damped bias of every film."""
    _, bi, _ = cf.biases(ratings(spark, d))
    return bi.select(F.col("item").alias("movie_id"), F.round("bi", 6).alias("bias"))


def item_knn(spark: SparkSession, d: str) -> DataFrame:
    """The 50 nearest vectors by cosine of every 20th vector, itself excluded."""
    v = vectors(spark, d).select(F.col("id").alias("item"), F.col("vector").alias("qi"))
    near = cf.neighbours(v, 50, v.where("item % 20 = 0"))
    return near.select("src", "dst", F.round("sim", 6).alias("sim"))


def item_item_scores(spark: SparkSession, d: str) -> DataFrame:
    """The 10 best films of every user by the neighbours of what the user rated above the mean; neighbours are films of the same language and year."""
    s = cf.item_item(ratings(spark, d), _next_films(spark, d), MU).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("user", "item", "score", "rank")


def _next_films(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, sim): every film's up to 5 next films by id among those of the same language and year."""
    f = catalogue(spark, d).select("id", "language", "year").where("year IS NOT NULL")
    w = Window.partitionBy("language", "year").orderBy("id")
    steps = [f.withColumn("dst", F.lead("id", k).over(w)).select(F.col("id").alias("src"), "dst", F.lit(1.0 - k / 10).alias("sim")) for k in range(1, 6)]
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out.where("dst IS NOT NULL")


_NEAR = "near AS (" + " UNION ALL ".join(f"SELECT src, dst, {1.0 - k / 10!r}::DOUBLE AS sim FROM (SELECT tmdb_id AS src, lead(tmdb_id, {k}) OVER (PARTITION BY original_language, release_year ORDER BY tmdb_id) AS dst FROM films WHERE release_year IS NOT NULL) WHERE dst IS NOT NULL" for k in range(1, 6)) + ")"


def predicted_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Expected rating and list score of every rated film, with the users' tastes as their factors."""
    r, items = cut(ratings(spark, d)), cut(_film_vectors(spark, d))
    tastes = pr.taste(pr.liked(r), items.select("item", F.col("qi").alias("vector")))
    j = r.join(items, "item").join(tastes, "user")
    return j.select("user", "item", F.round(cf.predicted(MU, F.col("bi"), F.col("qi"), F.col("taste")), 5).alias("predicted"), F.round(cf.rank_score(MU, F.col("bi"), F.col("qi"), F.col("taste")), 5).alias("rank_score"))


def prediction_errors(spark: SparkSession, d: str) -> DataFrame:
    """RMSE and MAE of the film's mean as prediction."""
    r = ratings(spark, d)
    means = r.groupBy("item").agg(F.avg("rating").alias("predicted"))
    e = cf.errors(r.join(means, "item"), "rating", "predicted")
    return e.select("n", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


def strategy_cascade(spark: SparkSession, d: str) -> DataFrame:
    """How each user is served: by overlap with the films of the catalogue."""
    r = ratings(spark, d)
    items = films(spark, d).select(F.col("tmdb_id").alias("item"))
    return cf.strategies(r, r, items).select("user", "overlap", "method")


def popularity_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most popular films."""
    f = films(spark, d).withColumn("score", F.coalesce("popularity", F.lit(0.0)))
    return top(f.select("tmdb_id", "score"), 50, "tmdb_id")


def als_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """RMSE and MAE of the factor model on a held-out tenth."""
    return cf.evaluate(ratings(spark, d))


def trained_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Ten films for users from a model trained here: factors, their nearest neighbours, and each user's strategy."""
    r = cut(ratings(spark, d))
    mu, items, _ = cf.train(r)
    items = cut(items)
    near = cut(cf.neighbours(items, queries=cut(cf.sought(_asked(r), items, mu))))
    cat = films(spark, d).select(F.col("tmdb_id").alias("item"), "popularity")
    out = cf.recommend(_asked(r), _asked(r), items, near, cat, mu, 10)
    return out.select("user", "item", F.round("score", 4).alias("score"), F.round("predicted", 3).alias("predicted_rating"), "method", "rank")


def fold_in(spark: SparkSession, d: str) -> DataFrame:
    """Factors of users by ridge regression on given item factors."""
    return cf.fold_in(ratings(spark, d), _film_vectors(spark, d), MU).select("user", F.round(vx.length(F.col("p")), 5).alias("length"))


def fold_in_pair(spark: SparkSession, d: str) -> DataFrame:
    """The same on the first two factors only, which SQL can solve."""
    two = _film_vectors(spark, d).withColumn("qi", F.slice("qi", 1, 2))
    return cf.fold_in(ratings(spark, d), two, MU).select("user", *[F.round(F.get("p", F.lit(k)), 5).alias(f"p{k}") for k in range(2)])


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Ten films for users, each by the user's strategy."""
    r = ratings(spark, d)
    items = cut(_film_vectors(spark, d))
    cat = films(spark, d).select(F.col("tmdb_id").alias("item"), "popularity")
    out = cf.recommend(_asked(r), _asked(r), items, _next_films(spark, d), cat, MU, 10)
    return out.select("user", "item", F.round("score", 4).alias("score"), F.round("predicted", 3).alias("predicted_rating"), "method", "rank")


# ---------------------------------------------------------------- profile


def taste_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Unit taste vector of every user: its first three components."""
    t = pr.taste(pr.liked(ratings(spark, d)), _film_vectors(spark, d).select("item", F.col("qi").alias("vector")))
    return t.select("user", *[F.round(F.get("taste", F.lit(k)), 5).alias(f"x{k}") for k in range(3)])


def review_tastes(spark: SparkSession, d: str) -> DataFrame:
    """Tastes of users mixed with what they wrote about films that they liked, read by the test encoder: the first three components."""
    r = ratings(spark, d)
    v = _film_vectors(spark, d).select("item", F.col("qi").alias("vector"))
    wrote = table(spark, d, "ratings").where("rating >= 3.5 AND NOT isnan(rating) AND trim(review) <> ''")
    said = wrote.select(F.col("user_id").alias("user"), pr.rating_weight(F.col("rating")).alias("weight"), encode(pr.review_text(F.col("review")), hashed_encoder(64)).alias("vector"))
    t = pr.with_reviews(pr.taste(pr.liked(r), v), said)
    return t.select("user", *[F.round(F.get("taste", F.lit(k)), 5).alias(f"x{k}") for k in range(3)])


def content_recommend(spark: SparkSession, d: str) -> DataFrame:
    """The ten unseen films nearest to each user's taste, by synopsis and by theme."""
    v = _film_vectors(spark, d).select("item", F.col("qi").alias("vector"))
    themes = _film_vectors(spark, d, 1).select("item", F.col("qi").alias("vector"))
    r = cut(_asked(ratings(spark, d)))
    likes = cut(pr.liked(r))
    tastes, vectors_ = pr.stacked(pr.taste(likes, v), pr.taste(likes, themes), "user", "taste"), cut(pr.stacked(v, themes, "item", "vector"))
    out = pr.content_recommendations(tastes, vectors_, r, 10)
    return out.select("user", "item", F.round("score", 5).alias("score"), "rank")


def profile_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Ratings, liked ratings and mean of every user."""
    return pr.scalars(ratings(spark, d).withColumn("rating", F.round("rating", 3)), 6).select("user", "n_rated", "n_liked", "avg_rating")


def _facets(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    cat = catalogue(spark, d)
    k = table(spark, d, "keywords").where("name IS NOT NULL")
    kb = table(spark, d, "movie_keywords").dropna().distinct().join(k, "keyword_id").select(F.col("tmdb_id").alias("item"), F.col("name").alias("value")).distinct()
    return {"genres": genre_names(spark, d).select(F.col("id").alias("item"), F.col("name").alias("value")), "themes": kb, "decades": pr.decades_of(cat.withColumnRenamed("id", "item"))}


def profile_facets(spark: SparkSession, d: str) -> DataFrame:
    """The heaviest genres, themes and decades of every user."""
    w = pr.facet_weights(pr.liked(ratings(spark, d)), _facets(spark, d)).withColumn("weight", F.round("weight", 6))
    return pr.top_facets(w).select("user", "facet", "value", "weight", "rank")


def first_actors(spark: SparkSession, d: str) -> DataFrame:
    """The first five actors of every film."""
    c = credits(spark, d).where("role = 'actor'").join(people(spark, d), "person").select(F.col("id").alias("item"), "name", "credit_order")
    return pr.first_actors(c).select(F.col("item").alias("id"), F.col("value").alias("name"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two lists of films, by votes and by rating, fused by reciprocal ranks."""
    f = films(spark, d)
    lists = []
    for c in ("vote_count", "vote_average"):
        best = f.orderBy(F.desc_nulls_last(c), "tmdb_id").limit(60)
        lists.append(best.select("tmdb_id", (F.row_number().over(Window.orderBy(F.desc_nulls_last(c), "tmdb_id")) - 1).alias("rank")))
    from tamarack.operators.fusion import reciprocal_ranks

    return reciprocal_ranks([(lists[0], 1.0), (lists[1], 0.5)], "tmdb_id").select("tmdb_id", F.round("score", 9).alias("score"))


def _directors(spark: SparkSession, d: str) -> DataFrame:
    """(item, value): a film's director is the supplier whose number is the film's id modulo their count."""
    s = people(spark, d)
    n = s.agg(F.count(F.lit(1)).alias("n"))
    numbered = films(spark, d).select(F.col("tmdb_id").alias("item")).crossJoin(F.broadcast(n)).withColumn("person", F.pmod("item", "n") + 1)
    return numbered.join(s, "person").select("item", F.col("name").alias("value"))


def why_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why films fit users, for every film that a user rated: the user's heaviest director of it and up to two of the heaviest genres."""
    r = cut(ratings(spark, d))
    facets = {"genres": _facets(spark, d)["genres"], "directors": _directors(spark, d)}
    w = cut(pr.top_facets(pr.facet_weights(pr.liked(r), facets).withColumn("weight", F.round("weight", 6))))
    return pr.reasons(r.select("user", "item"), w, facets).where("genres IS NOT NULL OR directors IS NOT NULL").select("user", "item", "directors", "genres")


# ---------------------------------------------------------------- linkage


def _exports(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "ratings")
    return r.select(F.col("row_id").alias("row"), plain_form(F.col("name")).alias("name"), F.nullif("year", F.lit(0)).alias("year"), "rating", "review")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return catalogue(spark, d).select("id", plain_form(F.col("title")).alias("title"), "year", "popularity", "votes")


_LINK = f"""{FILMS}, ex AS (SELECT row_id AS "row", {fold_sql('name')} AS name, nullif(year, 0) AS year FROM ratings), ti AS (SELECT tmdb_id AS id, {fold_sql('title')} AS title, release_year AS ty, popularity, vote_count AS votes FROM films)"""
_SIM = f"100 * {alike_sql('name', 'title')}"
_SPACED = lambda c: rf"regexp_replace(lower(trim({c}, ' ')), '\s+', ' ', 'g')"


def _percent(a, b):
    return 100 * edit_similarity(a, b)


def year_band_match(spark: SparkSession, d: str) -> DataFrame:
    """How many films of the year, the one before or after each export row meets."""
    return lk.year_counts(_exports(spark, d), _titles(spark, d)).withColumnRenamed("row", "row_id")


def best_title_match(spark: SparkSession, d: str) -> DataFrame:
    """The most similar title of each export row in its year band, by edit likeness at 82 or more."""
    rows = _exports(spark, d).where("year IS NOT NULL")
    best = lk.best_of_names(cut(rows), _titles(spark, d), _percent, alike=True)
    return best.select(F.col("row").alias("row_id"), F.col("id").alias("tmdb_id"), F.round("score", 4).alias("score"))


def undated_title_match(spark: SparkSession, d: str) -> DataFrame:
    """The most similar title over all years of export rows without a year."""
    rows = _exports(spark, d).where("year IS NULL")
    best = lk.best_of_names(cut(rows), _titles(spark, d), _percent, alike=True)
    return best.select(F.col("row").alias("row_id"), F.col("id").alias("tmdb_id"), F.round("score", 4).alias("score"))


def wratio_match(spark: SparkSession, d: str) -> DataFrame:
    """The most similar title of each export row in its year band by the weighted ratio, over distinct names and years."""
    rows = _exports(spark, d).where("year IS NOT NULL").groupBy("name", "year").agg(F.min("row").alias("row"))
    best = lk.best_by_weight(rows, _titles(spark, d))
    return best.select(F.col("row").alias("row_id"), F.col("id").alias("tmdb_id"), F.round("score", 4).alias("score"))


def lexicographic_best(spark: SparkSession, d: str) -> DataFrame:
    """The best search result of each export row: equal title, then year, popularity, votes."""
    return lk.search_titles(_exports(spark, d), _titles(spark, d)).select(F.col("row").alias("row_id"), F.col("id").alias("tmdb_id"))


def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Every export row with the film it was resolved to, by search, else by fuzzy title, else not at all; one without a year may be a film of any."""
    out = lk.import_ratings(cut(_exports(spark, d)), cut(_titles(spark, d)), similarity=_percent, alike=True)
    return out.select(F.col("row").alias("row_id"), F.col("id").alias("tmdb_id"), "resolver")


def match_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of export rows that a title search resolves."""
    rows = _exports(spark, d)
    m = lk.match_rate(lk.import_ratings(rows, _titles(spark, d), resolver="search"))
    return m.select("total", "matched", F.round("rate", 6).alias("rate"))


# ---------------------------------------------------------------- evaluation


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases: the second word of every 20th film's title as hint, with its year."""
    f = films(spark, d).where("tmdb_id % 20 = 0 AND release_year IS NOT NULL AND title IS NOT NULL")
    return f.select(F.col("tmdb_id").alias("case"), F.coalesce(F.get(F.split("title", " "), F.lit(1)), F.lit("zzz")).alias("hint"), F.col("release_year").alias("year"), "title")


_CASES = "ca AS (SELECT tmdb_id AS \"case\", coalesce(string_split(title, ' ')[2], 'zzz') AS hint, release_year AS year, title FROM films WHERE tmdb_id % 20 = 0 AND release_year IS NOT NULL AND title IS NOT NULL)"
_TARGETS = f"""{_CASES}, tg AS (SELECT "case", id FROM (SELECT "case", f.tmdb_id AS id, row_number() OVER (PARTITION BY "case" ORDER BY length(lower(f.title)), f.tmdb_id) AS rn FROM ca JOIN films f ON f.release_year = ca.year WHERE contains(lower(coalesce(f.title, '')), lower(hint))) WHERE rn = 1)"""


def resolve_targets_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The same for mistyped titles as hints: where none holds the hint, the most similar title of the year, by edit likeness."""
    cases = _cases(spark, d).select("case", F.concat(F.substring("title", 2, 200), F.lit("x")).alias("hint"), "year")
    return ev.resolve_targets(cases, catalogue(spark, d).select("id", "title", "year"), fallback=_percent)


def resolve_targets(spark: SparkSession, d: str) -> DataFrame:
    """The film that each evaluation case means."""
    return ev.resolve_targets(_cases(spark, d).drop("title"), catalogue(spark, d).select("id", "title", "year"), fallback=None)


def _positions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cases = cut(_cases(spark, d))
    index = index_of(spark, d, "titles")
    targets = ev.resolve_targets(cases.drop("title"), catalogue(spark, d).select("id", "title", "year"), fallback=None)
    return cases, cut(ev.lexical_positions(index, cases, "case", "title", targets))


_POSITIONS = f"""{FILMS}, {_TARGETS}, {postings_sql('films', 'tmdb_id', 'title')}, qt AS (SELECT DISTINCT "case", unnest({tokens_sql('title')}) AS term FROM ca),
    sc AS (SELECT "case", p.id, round({BM25}, 6) AS score FROM p JOIN qt ON p.term = qt.term JOIN dfs ON dfs.term = p.term, st GROUP BY 1, 2),
    po AS (SELECT g."case", g.id, 1 + (SELECT count(*) FROM sc s WHERE s."case" = g."case" AND (s.score > g.score OR (s.score = g.score AND s.id < g.id))) AS position FROM (SELECT tg."case", tg.id, sc.score FROM tg JOIN sc ON sc."case" = tg."case" AND sc.id = tg.id) g)"""


def target_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where each case's target stands when the titles are searched with the case's title."""
    return _positions(spark, d)[1]


def mrr_hits(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank, hits and positions over all cases."""
    cases, found = _positions(spark, d)
    return ev.ranking_metrics(cases, found)


def worst_cases(spark: SparkSession, d: str) -> DataFrame:
    """The eight worst cases beyond position 1."""
    return ev.worst(_positions(spark, d)[1], 1, 8).select("case", "position")


def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of films that share a genre with the film they are recommended for, among the first 5 neighbours."""
    near = _next_films(spark, d).withColumn("rank", F.round(10 * (1 - F.col("sim"))).cast("int"))
    g = genre_names(spark, d).select("id", F.col("name").alias("genre"))
    out = ev.precision_at(near, g, 5)
    return out.select(F.col("k"), F.round("precision", 6).alias("precision"))


# ---------------------------------------------------------------- older recommender


def tfidf_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 20 films whose overviews are nearest to one film's by TF-IDF cosine."""
    w = cut(tfidf(films(spark, d), "tmdb_id", "overview"))
    one = w.join(F.broadcast(films(spark, d).where("overview <> ''").agg(F.min("tmdb_id").alias("id"))), "id", "left_semi")
    src = one.select("term", F.col("weight").alias("a"), F.col("id").alias("src"))
    s = w.join(F.broadcast(src), "term").where("id <> src").groupBy("id").agg(F.round(F.sum(F.col("a") * F.col("weight")), 6).alias("score"))
    return top(s, 20, "id").select(F.col("id").alias("tmdb_id"), "score", "position")


def hybrid_legacy(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest films by TF-IDF, the ten best of them by the films' mean ratings."""
    near = tfidf_neighbours(spark, d)
    means = ratings(spark, d).groupBy(F.col("item").alias("tmdb_id")).agg(F.round(F.avg("rating"), 2).alias("predicted_rating"))
    return near.join(means, "tmdb_id", "left").orderBy(F.desc_nulls_last("predicted_rating"), "position").limit(10).select("tmdb_id", "predicted_rating")


# ---------------------------------------------------------------- streams


def stream_popularity(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type from a stream, all windows."""
    events = sp.event_stream(spark, f"{d}/events.parquet")
    out = sp.run_once(sp.popularity(events, "ts", "event_type", "value", late=None), "popularity", "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.col("kind").alias("event_type"), "n", F.round("total", 2).alias("total"))


def stream_closed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Ratings by day from a stream, the windows that the watermark has closed."""
    r = sp.event_stream(spark, f"{d}/user_ratings.parquet", 8).withColumn("kind", F.when(F.col("rating") >= 3.5, "liked").otherwise("other"))
    out = sp.run_once(sp.popularity(r, "rated_at", "kind", "rating", "7 days", "400 days"), "ratings")
    return out.select("window_start", "kind", "n", "total")


QUERIES = {f.__name__: f for f in (
    rating_stats, damped_biases, item_knn, item_item_scores, predicted_ratings, prediction_errors, strategy_cascade, popularity_fallback, als_evaluation, trained_recommendations, fold_in, fold_in_pair, recommendations, taste_centroid, review_tastes,
    content_recommend, profile_scalars, profile_facets, first_actors, rrf_fusion, why_reasons, year_band_match, best_title_match, undated_title_match, wratio_match, lexicographic_best, resolve_cascade,
    match_rate, resolve_targets, resolve_targets_fuzzy, target_positions, mrr_hits, worst_cases, precision_at_k, tfidf_neighbours, hybrid_legacy, stream_popularity, stream_closed_windows,
)}

_LIKES = "lk AS (SELECT u, i, CASE WHEN rating > 3 THEN rating - 3 ELSE 0.5 END AS w FROM r WHERE rating >= 3.5)"


def _taste_sql(name: str, likes: str, vectors_: str) -> str:
    """CTE of (u, t): sums by component, from which the unit vector is put together."""
    return f"""{name}s AS (SELECT u, k, sum(x) AS x FROM (SELECT u, unnest(generate_series(1, 64)) AS k, unnest([w * y FOR y IN v]) AS x FROM {likes} l JOIN {vectors_} f ON f.i = l.i) GROUP BY 1, 2),
    {name}n AS (SELECT u, sqrt(sum(x * x)) AS n FROM {name}s GROUP BY 1), {name} AS (SELECT s.u, list(CASE WHEN n > 0 THEN x / n ELSE x END ORDER BY k) AS t FROM {name}s s JOIN {name}n n ON n.u = s.u GROUP BY 1)"""


_TASTE = f"{FILMS}, {RATINGS}, {_VECTORS}, {_LIKES}, {_taste_sql('ta', 'lk', 'fv')}"
_TWO_TASTES = f"""{FILMS}, {RATINGS}, {_VECTORS}, {_VECTORS.replace('fv AS', 'fw AS').replace('tmdb_id %', '(tmdb_id + 1) %')}, {_LIKES}, ls AS (SELECT * FROM lk WHERE u % 20 = 0), {_taste_sql('ta', 'ls', 'fv')}, {_taste_sql('tb', 'ls', 'fw')}"""
_FACETS = f"""{FILMS}, {RATINGS}, {_LIKES}, {GENRES}, kw AS (SELECT DISTINCT tmdb_id AS id, name FROM movie_keywords JOIN keywords USING (keyword_id) WHERE tmdb_id IS NOT NULL AND name IS NOT NULL),
    fa AS (SELECT id, 'genres' AS facet, name AS value FROM mg UNION ALL SELECT id, 'themes', name FROM kw UNION ALL SELECT tmdb_id, 'decades', CAST(release_year // 10 * 10 AS VARCHAR) || 's' FROM films WHERE coalesce(release_year, 0) <> 0)"""

#: CTE s (id, score): cosines of the films' overviews with the first film's.
_NEAREST = """w2 AS (SELECT p.id, p.term, tf * (ln((1.0 + st.n) / (1 + df)) + 1) AS w FROM p JOIN dfs ON dfs.term = p.term, st), nn AS (SELECT id, sqrt(sum(w * w)) AS n FROM w2 GROUP BY 1), z AS (SELECT w2.id, term, w / n AS w FROM w2 JOIN nn ON nn.id = w2.id), o AS (SELECT min(tmdb_id) AS id FROM films WHERE overview <> ''),
        s AS (SELECT b.id, round(sum(a.w * b.w), 6) AS score FROM z a JOIN o ON o.id = a.id JOIN z b ON b.term = a.term AND b.id <> a.id GROUP BY 1)"""

ORACLE = {
    "rating_stats": f"WITH {RATINGS} SELECT count(*) AS n_ratings, count(DISTINCT u) AS n_users, count(DISTINCT i) AS n_items, round(avg(rating), 6) AS mu FROM r",
    "damped_biases": f"WITH {RATINGS}, m AS (SELECT avg(rating) AS mu FROM r) SELECT i AS movie_id, round(sum(rating - mu) / (count(*) + 10.0), 6) AS bias FROM r, m GROUP BY 1",
    "item_knn": """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), s AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) / (a.n * b.n) AS sim FROM e a, e b WHERE a.id % 20 = 0 AND a.id <> b.id),
        k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS rn FROM s) SELECT src, dst, round(sim, 6) AS sim FROM k WHERE rn <= 50""",
    "item_item_scores": f"""WITH {FILMS}, {RATINGS}, {_NEAR}, s AS (SELECT u AS "user", dst AS item, round(sum((rating - 3.5) * sim), 6) AS score FROM r JOIN near ON src = i WHERE rating > 3.5 GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM s) SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM k WHERE rank <= 10""",
    "predicted_ratings": f"""WITH {_TASTE} SELECT r.u AS "user", r.i AS item, round(3.5 + bi + list_dot_product(v, t), 5) AS predicted, round(3.5 + 0.5 * bi + list_dot_product(v, t), 5) AS rank_score FROM r JOIN fv ON fv.i = r.i JOIN ta ON ta.u = r.u""",
    "prediction_errors": f"WITH {RATINGS}, m AS (SELECT i, avg(rating) AS p FROM r GROUP BY 1) SELECT count(*) AS n, round(sqrt(avg((p - rating) * (p - rating))), 6) AS rmse, round(avg(abs(p - rating)), 6) AS mae FROM r JOIN m ON m.i = r.i",
    "strategy_cascade": f"""WITH {FILMS}, {RATINGS}, o AS (SELECT u, count(DISTINCT i) FILTER (i IN (SELECT tmdb_id FROM films)) AS overlap FROM r GROUP BY 1) SELECT u AS "user", overlap, CASE WHEN overlap >= 2 THEN 'fold_in' WHEN overlap >= 1 THEN 'item_item' ELSE 'popularity' END AS method FROM o""",
    "popularity_fallback": f"WITH {FILMS} SELECT tmdb_id, coalesce(popularity, 0.0) AS score, CAST(row_number() OVER (ORDER BY coalesce(popularity, 0.0) DESC, tmdb_id) AS INTEGER) AS position FROM films ORDER BY position LIMIT 50",
    "taste_centroid": f"""WITH {_TASTE} SELECT u AS "user", round(t[1], 5) AS x0, round(t[2], 5) AS x1, round(t[3], 5) AS x2 FROM ta""",
    "content_recommend": f"""WITH {_TWO_TASTES}, s AS (SELECT ta.u, fv.i, list_dot_product(fv.v, ta.t) + list_dot_product(fw.v, tb.t) AS score FROM ta JOIN tb ON tb.u = ta.u, fv JOIN fw ON fw.i = fv.i WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.u = ta.u AND r.i = fv.i)),
        k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(score, 9) DESC, i) - 1 AS rank FROM s) SELECT u AS "user", i AS item, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank < 10""",
    "fold_in_pair": f"""WITH {FILMS}, {RATINGS}, {_VECTORS}, n AS (SELECT u, sum(v[1] * v[1]) + 0.1 AS a, sum(v[1] * v[2]) AS b, sum(v[2] * v[2]) + 0.1 AS c, sum(v[1] * (rating - 3.5 - bi)) AS y, sum(v[2] * (rating - 3.5 - bi)) AS z FROM r JOIN fv ON fv.i = r.i GROUP BY 1)
        SELECT u AS "user", round((c * y - b * z) / (a * c - b * b), 5) AS p0, round((a * z - b * y) / (a * c - b * b), 5) AS p1 FROM n""",
    "hybrid_legacy": f"""WITH {FILMS}, {RATINGS}, {postings_sql('films', 'tmdb_id', 'overview')}, {_NEAREST}, nr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS position FROM s ORDER BY position LIMIT 20), me AS (SELECT i, round(avg(rating), 2) AS predicted_rating FROM r GROUP BY 1)
        SELECT nr.id AS tmdb_id, predicted_rating FROM nr LEFT JOIN me ON me.i = nr.id ORDER BY predicted_rating DESC NULLS LAST, position LIMIT 10""",
    "resolve_targets_fuzzy": f"""WITH {FILMS}, ca AS (SELECT tmdb_id AS "case", substr(title, 2, 200) || 'x' AS hint, release_year AS year FROM films WHERE tmdb_id % 20 = 0 AND release_year IS NOT NULL AND title IS NOT NULL),
        pr AS (SELECT "case", f.tmdb_id AS id, lower(hint) AS h, lower(coalesce(f.title, '')) AS t FROM ca JOIN films f ON f.release_year = ca.year), a AS (SELECT "case", id FROM (SELECT "case", id, row_number() OVER (PARTITION BY "case" ORDER BY length(t), id) AS rn FROM pr WHERE contains(t, h)) WHERE rn = 1),
        b AS (SELECT "case", id, 100 * {alike_sql('h', 't')} AS s FROM pr WHERE "case" NOT IN (SELECT "case" FROM a)) SELECT * FROM a UNION ALL SELECT "case", id FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY s DESC, id) AS rn FROM b WHERE s >= 80) WHERE rn = 1""",
    "profile_scalars": f"""WITH {RATINGS}, x AS (SELECT u, round(rating, 3) AS rating FROM r) SELECT u AS "user", count(*) AS n_rated, count(*) FILTER (rating >= 3.5) AS n_liked, round(avg(rating), 6) AS avg_rating FROM x GROUP BY 1""",
    "profile_facets": f"""WITH {_FACETS}, w AS (SELECT u AS "user", facet, value, round(sum(w), 6) AS weight FROM lk JOIN fa ON fa.id = lk.i GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY "user", facet ORDER BY weight DESC, value) AS rank FROM w) SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM k WHERE rank <= CASE facet WHEN 'decades' THEN 4 ELSE 6 END""",
    "first_actors": f"WITH {PEOPLE}, n AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY credit_order NULLS FIRST, name) AS rn FROM credits JOIN people USING (person) WHERE role = 'actor') SELECT id, name FROM n WHERE rn <= 5",
    "rrf_fusion": f"""WITH {FILMS}, a AS (SELECT tmdb_id, row_number() OVER (ORDER BY vote_count DESC NULLS LAST, tmdb_id) - 1 AS k FROM films), b AS (SELECT tmdb_id, row_number() OVER (ORDER BY vote_average DESC NULLS LAST, tmdb_id) - 1 AS k FROM films),
        u AS (SELECT tmdb_id, 1.0::DOUBLE / (20 + k) AS s FROM a WHERE k < 60 UNION ALL SELECT tmdb_id, 0.5::DOUBLE / (20 + k) FROM b WHERE k < 60) SELECT tmdb_id, round(sum(s), 9) AS score FROM u GROUP BY 1""",
    "why_reasons": f"""WITH {FILMS}, {RATINGS}, {_LIKES}, {GENRES}, pd AS (SELECT tmdb_id AS id, s_name AS name FROM films JOIN supplier ON s_suppkey = tmdb_id % (SELECT count(*) FROM supplier) + 1), fa AS (SELECT 'genres' AS facet, * FROM mg UNION ALL SELECT 'directors', * FROM pd),
        w AS (SELECT u, facet, name, round(sum(w), 6) AS weight FROM lk JOIN fa ON fa.id = lk.i GROUP BY 1, 2, 3), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u, facet ORDER BY weight DESC, name) AS rank FROM w) WHERE rank <= 6),
        h AS (SELECT r.u, r.i, fa.facet, list(k.name ORDER BY rank) AS names FROM r JOIN fa ON fa.id = r.i JOIN k ON k.u = r.u AND k.facet = fa.facet AND k.name = fa.name GROUP BY 1, 2, 3)
        SELECT u AS "user", i AS item, max(names[1:1]) FILTER (facet = 'directors') AS directors, max(names[1:2]) FILTER (facet = 'genres') AS genres FROM h GROUP BY 1, 2""",
    "year_band_match": f"""WITH {_LINK} SELECT "row" AS row_id, count(*) AS candidates FROM ex JOIN ti ON ty BETWEEN year - 1 AND year + 1 GROUP BY 1""",
    "best_title_match": f"""WITH {_LINK}, s AS (SELECT "row", id, {_SIM} AS s FROM ex JOIN ti ON ty BETWEEN year - 1 AND year + 1), k AS (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY s DESC, id) AS rn FROM s WHERE s >= 82) SELECT "row" AS row_id, id AS tmdb_id, round(s, 4) AS score FROM k WHERE rn = 1""",
    "undated_title_match": f"""WITH {_LINK}, s AS (SELECT "row", id, {_SIM} AS s FROM ex, ti WHERE year IS NULL), k AS (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY s DESC, id) AS rn FROM s WHERE s >= 82) SELECT "row" AS row_id, id AS tmdb_id, round(s, 4) AS score FROM k WHERE rn = 1""",
    "lexicographic_best": rf"""WITH {_LINK}, s AS (SELECT "row", id, row_number() OVER (PARTITION BY "row" ORDER BY coalesce((year = ty)::INT, 0) DESC, coalesce(popularity, 0) DESC, coalesce(votes, 0) DESC, id) AS rn FROM ex JOIN ti ON {_SPACED('name')} = {_SPACED('title')}) SELECT "row" AS row_id, id AS tmdb_id FROM s WHERE rn = 1""",
    "resolve_cascade": rf"""WITH {_LINK}, e AS (SELECT * FROM ex), a AS (SELECT "row", id FROM (SELECT "row", id, row_number() OVER (PARTITION BY "row" ORDER BY coalesce((year = ty)::INT, 0) DESC, coalesce(popularity, 0) DESC, coalesce(votes, 0) DESC, id) AS rn FROM e JOIN ti ON {_SPACED('name')} = {_SPACED('title')}) WHERE rn = 1),
        s AS (SELECT "row", id, {_SIM} AS s FROM e JOIN ti ON ty BETWEEN year - 1 AND year + 1 WHERE "row" NOT IN (SELECT "row" FROM a) UNION ALL SELECT "row", id, {_SIM} AS s FROM e, ti WHERE year IS NULL AND "row" NOT IN (SELECT "row" FROM a)), b AS (SELECT "row", id FROM (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY s DESC, id) AS rn FROM s WHERE s >= 82) WHERE rn = 1)
        SELECT e."row" AS row_id, coalesce(a.id, b.id) AS tmdb_id, CASE WHEN a.id IS NOT NULL THEN 'search' WHEN b.id IS NOT NULL THEN 'fuzzy' END AS resolver FROM e LEFT JOIN a ON a."row" = e."row" LEFT JOIN b ON b."row" = e."row" """,
    "match_rate": rf"""WITH {_LINK} SELECT count(*) AS total, count(*) FILTER (hit) AS matched, round(avg(hit::INT), 6) AS rate FROM (SELECT coalesce({_SPACED('name')} IN (SELECT {_SPACED('title')} FROM ti WHERE title IS NOT NULL), false) AS hit FROM ex)""",
    "resolve_targets": f"""WITH {FILMS}, {_TARGETS} SELECT "case", id FROM tg""",
    "target_positions": f"""WITH {_POSITIONS} SELECT "case", id, position FROM po""",
    "mrr_hits": f"""WITH {_POSITIONS} SELECT count(*) AS n, count(position) AS resolved, round(coalesce(sum(1.0::DOUBLE / position), 0) / count(*), 4) AS mrr, count(*) FILTER (position <= 1) AS hits_1, count(*) FILTER (position <= 3) AS hits_3, count(*) FILTER (position <= 10) AS hits_10, CAST(floor(median(position)) AS INTEGER) AS median, round(avg(position), 1) AS mean FROM ca LEFT JOIN po ON po."case" = ca."case" """,
    "worst_cases": f"""WITH {_POSITIONS} SELECT "case", position FROM po WHERE position > 1 ORDER BY position DESC, "case" LIMIT 8""",
    "precision_at_k": f"""WITH {FILMS}, {_NEAR}, {GENRES}, h AS (SELECT DISTINCT src, dst FROM near JOIN mg a ON a.id = src JOIN mg b ON b.id = dst AND b.name = a.name) SELECT 5 AS k, round((SELECT count(*) FROM h)::DOUBLE / ((SELECT count(DISTINCT src) FROM near) * 5), 6) AS precision""",
    "tfidf_neighbours": f"""WITH {FILMS}, {postings_sql('films', 'tmdb_id', 'overview')}, {_NEAREST} SELECT id AS tmdb_id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS position FROM s ORDER BY score DESC, id LIMIT 20""",
    "stream_popularity": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
