"""Queries of sources, catalogue facets, filters and people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions import text as tx
from tamarack.functions.similarity import edit_similarity
from tamarack.operators import catalogue as co
from tamarack.operators import linkage as lk
from tamarack.operators.collaborative import sample
from tamarack.operators.search import by_entity, facet_filter
from tamarack.plans.common import FILMS, GENRES, PARTS, PEOPLE, alike_sql, catalogue, credits, films, fold_sql, genre_bridge, genre_names, keyword_bridge, parts, people, plain_form
from tamarack.runtime import scratch, table
from tamarack.sources import tables as so


def _strings():
    return F.array().cast("array<string>")


# ---------------------------------------------------------------- sources


def sql_scan(spark: SparkSession, d: str) -> DataFrame:
    """A parameterised SQL query: films of a year."""
    table(spark, d, "movies").createOrReplaceTempView("movies_scan")
    return so.sql(spark, "SELECT DISTINCT tmdb_id, title FROM movies_scan WHERE release_year = :year", year=2010)


def first_row(spark: SparkSession, d: str) -> DataFrame:
    """The film of the least id."""
    return films(spark, d).orderBy("tmdb_id").limit(1).select("tmdb_id", "title")


def scalar_exists(spark: SparkSession, d: str) -> DataFrame:
    """Films that have a keyword: EXISTS as a semi join."""
    return films(spark, d).join(table(spark, d, "movie_keywords"), "tmdb_id", "left_semi").select("tmdb_id")


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One film by id."""
    return table(spark, d, "movies").where(F.col("tmdb_id") == 1000).select("tmdb_id", "title", "release_year").distinct()


def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with its null rules: overview empty, countries as an array."""
    return so.catalogue(films(spark, d)).select("tmdb_id", "title", "overview", "origin_countries", "release_year")


def json_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue written as JSON, read with its schema and normalised."""
    lists = co.name_lists(genre_bridge(spark, d), table(spark, d, "genres"), "genre_id").select(F.col("id"), F.col("names").alias("genres"))
    rows = films(spark, d).select(F.col("tmdb_id").alias("id"), "title", F.col("title").alias("original_title"), "overview", "release_date", "vote_average", "vote_count").join(lists, "id", "left")
    path = scratch(spark, "json")
    rows.write.json(path)
    out = so.normalise_json(so.json_catalogue(spark, path))
    return out.select("tmdb_id", "title", "release_date", "release_year", "overview", "vote_average", "vote_count", F.size(F.coalesce("genres", _strings())).alias("n_genres"))


def genre_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Genre dictionary from arrays: distinct names numbered by first appearance."""
    lists = co.name_lists(genre_bridge(spark, d), table(spark, d, "genres"), "genre_id")
    return co.genre_dictionary(lists, "id", "names").select(F.col("genre_id").cast("long").alias("genre_id"), "name")


def ratings_csv(spark: SparkSession, d: str) -> DataFrame:
    """Exports written as CSV, with quotes and a byte order mark, read, parsed and validated."""
    r = table(spark, d, "ratings")
    rows = r.select(F.col("row_id").alias("﻿Row"), F.col("logged_on").alias("Date"), F.concat(F.lit(" "), F.col("name"), F.lit(" ")).alias("Name"), F.col("year").cast("string").alias("Year"), F.col("uri").alias("URI"), F.when(~F.isnan("rating"), F.col("rating").cast("string")).alias("Rating"), F.col("review").alias("Review"))
    path = scratch(spark, "csv")
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return so.parse_ratings(so.ratings_csv(spark, path)).select(F.col("Row").cast("long").alias("row_id"), "name", "year", "rating")


def ratings_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of exactly 500 ratings."""
    return sample(table(spark, d, "user_ratings").select("id", "user_id", "movie_id", "rating"), 500, 42, "id")


def crawl_filter(spark: SparkSession, d: str) -> DataFrame:
    """A crawl page: films of one genre with 50 votes and 6.0 or better, most popular first."""
    g = genre_names(spark, d).where("name = 'Drama'").select(F.col("id").alias("tmdb_id"))
    good = films(spark, d).join(g, "tmdb_id", "left_semi").where("vote_count >= 50 AND vote_average >= 6.0")
    return good.orderBy(F.desc_nulls_last("popularity"), "tmdb_id").limit(20).select("tmdb_id", "popularity")


def crawl_dedup(spark: SparkSession, d: str) -> DataFrame:
    """A crawl over genres: each film with the first genre under which it came, then its details."""
    hits = genre_bridge(spark, d).dropna().distinct().withColumnRenamed("id", "tmdb_id")
    first = co.once(hits, "tmdb_id", F.asc("genre_id"))
    details = films(spark, d).select("tmdb_id", F.coalesce("title", F.lit("Sem título")).alias("title"), F.coalesce("vote_count", F.lit(0)).alias("vote_count"))
    return first.join(details, "tmdb_id", "left").select("tmdb_id", "genre_id", "title", "vote_count")


def title_map(spark: SparkSession, d: str) -> DataFrame:
    """id to title."""
    return films(spark, d).select("tmdb_id", "title")


def _posters(spark: SparkSession, d: str) -> DataFrame:
    """Poster paths that are known for two of three films; some are empty."""
    t = F.col("tmdb_id")
    return films(spark, d).where(t % 3 != 0).select(t.alias("id"), F.when(t % 5 != 0, F.concat(F.lit("/p"), t.cast("string"), F.lit(".jpg"))).otherwise("").alias("poster_path"))


_POSTERS = "posters AS (SELECT tmdb_id AS id, CASE WHEN tmdb_id % 5 <> 0 THEN '/p' || tmdb_id || '.jpg' ELSE '' END AS poster_path FROM films WHERE tmdb_id % 3 <> 0)"


def poster_attach(spark: SparkSession, d: str) -> DataFrame:
    """Every film with a poster, or a placeholder that shows the title."""
    every = films(spark, d).select(F.col("tmdb_id").alias("id"), "title")
    return co.with_posters(every, _posters(spark, d)).select(F.col("id").alias("tmdb_id"), "poster")


def poster_by_title(spark: SparkSession, d: str) -> DataFrame:
    """For every title the poster of the first film that bears it."""
    first = co.once(films(spark, d).where("title IS NOT NULL").select("title", F.col("tmdb_id").alias("id")), "title", F.asc("id"))
    return first.join(_posters(spark, d), "id", "left").select("title", F.nullif(F.col("poster_path"), F.lit("")).alias("poster_path"))


def poster_prefetch(spark: SparkSession, d: str) -> DataFrame:
    """Rated films whose poster is not remembered: distinct, valid and missing."""
    wanted = table(spark, d, "user_ratings").where("movie_id > 0").select(F.col("movie_id").alias("id"))
    return lk.missing_keys(wanted, _posters(spark, d), "id").select(F.col("id").alias("tmdb_id"))


def search_prefetch(spark: SparkSession, d: str) -> DataFrame:
    """Search keys of exports that the films' own keys do not answer."""
    asked = table(spark, d, "ratings").select(lk.search_key(plain_form(F.col("name")), F.col("year")).alias("key"))
    known = films(spark, d).select(lk.search_key(plain_form(F.col("title")), F.col("release_year")).alias("key"))
    return lk.missing_keys(asked, known.where("key IS NOT NULL"), "key")


def remembered_lookups(spark: SparkSession, d: str) -> DataFrame:
    """A lookup table written, added to with old keys kept, and read again."""
    k = films(spark, d).select(F.col("tmdb_id").alias("key"), F.coalesce("vote_count", F.lit(0)).alias("value"))
    path = scratch(spark, "lookup")
    so.remember(spark, path, k.where("key % 2 = 0"), "key")
    return so.remember(spark, path, k.where("key % 2 = 1 OR key % 4 = 0").withColumn("value", F.col("value") + 1), "key").select("key", "value")


# ---------------------------------------------------------------- projections and filters


def result_projection(spark: SparkSession, d: str) -> DataFrame:
    """Result rows: overview cut to 240 characters, popularity as score to four places."""
    return films(spark, d).select("tmdb_id", "title", "release_year", "original_language", "vote_average", F.substring(F.coalesce("overview", F.lit("")), 1, 240).alias("overview"), F.round("popularity", 4).alias("score"))


def facet_filter_pre(spark: SparkSession, d: str) -> DataFrame:
    """Films of a genre, language and span of years; unknown years fail."""
    g = genre_names(spark, d)
    return facet_filter(catalogue(spark, d), {"year_min": 1990, "year_max": 2015, "language": "PT", "genre": "drama"}, g).select(F.col("id").alias("tmdb_id"))


def facet_filter_post(spark: SparkSession, d: str) -> DataFrame:
    """The same filter behind a cut of the 100 most voted films: fewer may remain."""
    best = catalogue(spark, d).orderBy(F.desc_nulls_last("votes"), "id").limit(100)
    return facet_filter(best, {"year_min": 1990, "language": "pt"}).select(F.col("id").alias("tmdb_id"))


def popular_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the most voted films rated 6.5 or better."""
    return co.popular(catalogue(spark, d), 48, 48).select(F.col("id").alias("tmdb_id"), "title", F.col("year").alias("release_year"))


def person_order(spark: SparkSession, d: str) -> DataFrame:
    """Films of one person by popularity."""
    mine = co.people_of_name(people(spark, d), credits(spark, d), "Supplier#000000007")
    return parts(spark, d).join(mine, "id", "left_semi").orderBy(F.desc(F.coalesce("popularity", F.lit(0.0))), "id").limit(50).select("id", "popularity")


def title_filter(spark: SparkSession, d: str) -> DataFrame:
    """The first eight titles, in title order, that hold a text."""
    return films(spark, d).where(F.contains(F.lower("title"), F.lit("noite"))).orderBy("title", "tmdb_id").limit(8).select("tmdb_id", "title")


def titles_sorted(spark: SparkSession, d: str) -> DataFrame:
    """All films by title with their genres: the list for choosing."""
    lists = co.name_lists(genre_bridge(spark, d), table(spark, d, "genres"), "genre_id").select(F.col("id").alias("tmdb_id"), F.col("names").alias("genres"))
    return films(spark, d).join(lists, "tmdb_id", "left").orderBy("title", "tmdb_id").select(F.col("tmdb_id").alias("movie_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("genres", _strings()).alias("genres"))


def with_genres(spark: SparkSession, d: str) -> DataFrame:
    """Films that have a genre."""
    lists = co.name_lists(genre_bridge(spark, d), table(spark, d, "genres"), "genre_id")
    return lists.where(F.size("names") > 0).select(F.col("id").alias("tmdb_id"), F.size("names").alias("n"))


def chosen_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids as they came in exports' years, as text: valid ones, each once, in order of appearance."""
    raw = table(spark, d, "ratings_raw").select(F.get(F.split("line", ","), F.lit(2)).alias("v"), "line_id")
    return co.ordered_ids(raw, "v", "line_id").select("id", F.col("at").alias("first_line"))


def genre_list(spark: SparkSession, d: str) -> DataFrame:
    """Distinct genre names in order."""
    return table(spark, d, "genres").select("name").where("name IS NOT NULL").distinct().orderBy("name")


# ---------------------------------------------------------------- joins and people


def film_genres(spark: SparkSession, d: str) -> DataFrame:
    """Genres of every film, repeated rows once."""
    return co.names_of(genre_bridge(spark, d), table(spark, d, "genres"), "genre_id").select(F.col("id").alias("tmdb_id"), "name")


def film_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of every film."""
    return co.names_of(keyword_bridge(spark, d), table(spark, d, "keywords"), "keyword_id").select(F.col("id").alias("tmdb_id"), "name")


def facet_lists(spark: SparkSession, d: str) -> DataFrame:
    """Keyword names of every film as one list, unknown names empty."""
    return co.name_lists(keyword_bridge(spark, d), table(spark, d, "keywords"), "keyword_id").select(F.col("id").alias("tmdb_id"), "names")


def film_people(spark: SparkSession, d: str) -> DataFrame:
    """People of every film with role and order."""
    return credits(spark, d).join(people(spark, d), "person").select("id", "name", "role", "credit_order")


def people_documents(spark: SparkSession, d: str) -> DataFrame:
    """Directors and cast of every film as text."""
    return co.people_documents(people(spark, d), credits(spark, d)).select("id", "text")


def person_films(spark: SparkSession, d: str) -> DataFrame:
    """Films of a person in one role."""
    return co.people_of_name(people(spark, d), credits(spark, d), "Supplier#000000005", "director")


def director_and_actor(spark: SparkSession, d: str) -> DataFrame:
    """Films that have one person as director and as actor: an intersection of semi joins."""
    a = co.people_of_name(people(spark, d), credits(spark, d), "Supplier#000000005", "director")
    return a.join(co.people_of_name(people(spark, d), credits(spark, d), "Supplier#000000005", "actor"), "id", "left_semi")


def role_exists(spark: SparkSession, d: str) -> DataFrame:
    """People who both direct and act somewhere."""
    c = credits(spark, d)
    acting = c.where("role = 'actor'").select("person")
    return people(spark, d).join(c.where("role = 'director'"), "person", "left_semi").join(acting, "person", "left_semi").select("person", "name")


def suggest_people(spark: SparkSession, d: str) -> DataFrame:
    """People whose name holds a text, the most credited first."""
    return co.suggest_people(people(spark, d), credits(spark, d), "0001", limit=10)


def fuzzy_person(spark: SparkSession, d: str) -> DataFrame:
    """Films of the people named most like a mistyped name: best name per film."""
    names = people(spark, d).select(F.col("person").alias("entity"), "name")
    bridge = credits(spark, d).select(F.col("person").alias("entity"), "id").distinct()
    found = by_entity(names, bridge, parts(spark, d), "Suplier#00000012", 10, 0.8, base=edit_similarity)
    return found.select("id", F.round("score", 6).alias("score"))


def fuzzy_keyword(spark: SparkSession, d: str) -> DataFrame:
    """Films of the keywords most like a mistyped one: scores add up."""
    names = table(spark, d, "keywords").where("name IS NOT NULL").select(F.col("keyword_id").alias("entity"), plain_form(F.trim("name")).alias("name"))
    bridge = keyword_bridge(spark, d).dropna().distinct().select(F.col("keyword_id").alias("entity"), "id")
    found = by_entity(names, bridge, catalogue(spark, d), "wintr journey", 10, 0.6, "sum", edit_similarity)
    return found.select(F.col("id").alias("tmdb_id"), F.round("score", 6).alias("score"))


def genre_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Films that share most genres with one film."""
    g = genre_names(spark, d).select("id", F.col("name").alias("genre"))
    return co.genre_overlap(g, 1000, 20).select(F.col("id").alias("tmdb_id"), "common", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- functions on the catalogue


def attribute_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases for era, acclaim and length of every film."""
    return films(spark, d).select("tmdb_id", tx.attribute_phrases(F.col("release_year"), F.col("vote_average"), F.col("vote_count"), F.col("runtime_minutes")).alias("phrases"))


def keyword_documents(spark: SparkSession, d: str) -> DataFrame:
    """The thematic text of every film: genres, keywords and phrases."""
    g = co.name_lists(genre_bridge(spark, d), table(spark, d, "genres"), "genre_id")
    k = co.name_lists(keyword_bridge(spark, d), table(spark, d, "keywords"), "keyword_id")
    return co.keyword_documents(catalogue(spark, d), g, k).select(F.col("id").alias("tmdb_id"), "text")


def countries_dates(spark: SparkSession, d: str) -> DataFrame:
    """Countries as an array, year of the date, decade."""
    return films(spark, d).select("tmdb_id", tx.countries(F.col("origin_countries")).alias("countries"), tx.year_of(F.col("release_date")).alias("date_year"), tx.decade_label(F.col("release_year")).alias("decade"))


def decade_counts(spark: SparkSession, d: str) -> DataFrame:
    """Films by decade."""
    return films(spark, d).where("release_year IS NOT NULL").groupBy(tx.decade(F.col("release_year")).alias("decade")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("vote_average"), 4).alias("avg_vote"))


def passages(spark: SparkSession, d: str) -> DataFrame:
    """What a reranker reads of every film: overview, else title and keywords."""
    k = co.name_lists(keyword_bridge(spark, d), table(spark, d, "keywords"), "keyword_id")
    return catalogue(spark, d).join(k, "id", "left").select(F.col("id").alias("tmdb_id"), tx.with_prefix(tx.passage(F.col("overview"), F.col("title"), F.col("names")), "e5-large", "passage").alias("passage"))


def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of every title: without leading article, and with collapsed blanks."""
    return films(spark, d).select("tmdb_id", tx.name_key(F.col("title")).alias("name_key"), tx.space_key(F.col("title")).alias("space_key"))


def clean_queries(spark: SparkSession, d: str) -> DataFrame:
    """The whole overview of every film as a query: the leading filler words gone; without an overview, what is left of them."""
    q = F.concat(F.lit("Aquele filme da "), F.coalesce("overview", F.lit("")))
    return films(spark, d).select("tmdb_id", tx.clean_query_column(q).alias("cleaned"))


def random_popular(spark: SparkSession, d: str) -> DataFrame:
    """A seeded random choice of 30 films; the rating stands for the score, 7.5 if unknown."""
    return sample(films(spark, d), 30, 7, "tmdb_id").select("tmdb_id", F.coalesce("vote_average", F.lit(7.5)).alias("score"))


def title_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first film of a title: equal without case first, else one that holds the text. Asked for the title of the film of most votes, in capitals."""
    f = films(spark, d).where("title IS NOT NULL")
    asked = f.orderBy(F.desc_nulls_last("vote_count"), "tmdb_id").limit(1).select(F.lower(F.upper("title")).alias("asked"))
    low = F.lower("title")
    tier = F.when(low == F.col("asked"), 0).when(F.contains(low, F.col("asked")), 1)
    return f.crossJoin(F.broadcast(asked)).withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", "tmdb_id").limit(1).select("tmdb_id", "title")


def keyword_facets(spark: SparkSession, d: str) -> DataFrame:
    """The most used keywords, names compared without case and blanks, with films and share of all keyworded films."""
    k = table(spark, d, "keywords").where("name IS NOT NULL").select("keyword_id", F.lower(F.trim("name")).alias("name"))
    b = keyword_bridge(spark, d).dropna().distinct().join(k, "keyword_id").select("id", "name").distinct()
    total = b.agg(F.countDistinct("id").alias("total"))
    n = b.groupBy("name").agg(F.count(F.lit(1)).alias("films")).crossJoin(F.broadcast(total))
    return n.orderBy(F.desc("films"), "name").limit(50).select("name", "films", F.round(F.col("films") / F.col("total"), 6).alias("share"))


def latest_ratings(spark: SparkSession, d: str) -> DataFrame:
    """The last rating of every user and film, by time, then by arrival."""
    r = table(spark, d, "user_ratings").where("user_id IS NOT NULL AND movie_id IS NOT NULL")
    w = Window.partitionBy("user_id", "movie_id").orderBy(F.desc_nulls_last("rated_at"), F.desc("id"))
    return r.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "movie_id", "id")


QUERIES = {f.__name__: f for f in (
    sql_scan, first_row, scalar_exists, point_lookup, catalog_scan, json_catalog, genre_arrays, ratings_csv, ratings_sample, crawl_filter, crawl_dedup, title_map, poster_attach, poster_by_title,
    poster_prefetch, search_prefetch, remembered_lookups, result_projection, facet_filter_pre, facet_filter_post, popular_page, person_order, title_filter, titles_sorted, with_genres, chosen_ids,
    genre_list, film_genres, film_keywords, facet_lists, film_people, people_documents, person_films, director_and_actor, role_exists, suggest_people, fuzzy_person, fuzzy_keyword, genre_overlap,
    attribute_phrases, keyword_documents, countries_dates, decade_counts, passages, name_keys, clean_queries, random_popular, title_lookup, keyword_facets, latest_ratings,
)}

_LISTS = """gl AS (SELECT b.id, list(coalesce(g.name, '') ORDER BY coalesce(g.name, '')) AS names FROM (SELECT DISTINCT tmdb_id AS id, genre_id FROM movie_genres WHERE tmdb_id IS NOT NULL) b LEFT JOIN genres g ON g.genre_id = b.genre_id GROUP BY 1),
    kl AS (SELECT b.id, list(coalesce(k.name, '') ORDER BY coalesce(k.name, '')) AS names FROM (SELECT DISTINCT tmdb_id AS id, keyword_id FROM movie_keywords WHERE tmdb_id IS NOT NULL) b LEFT JOIN keywords k ON k.keyword_id = b.keyword_id GROUP BY 1)"""
_PHRASES = """list_concat(CASE WHEN coalesce(y, 0) <> 0 THEN ['década de ' || (y // 10 * 10), 'filme dos anos ' || (y // 10 * 10), 'de ' || y] ELSE []::VARCHAR[] END,
    CASE WHEN coalesce(y, 0) = 0 THEN []::VARCHAR[] WHEN y <= 1929 THEN ['filme mudo', 'cinema mudo', 'preto e branco', 'filme muito antigo'] WHEN y <= 1935 THEN ['preto e branco', 'filme antigo clássico'] WHEN y <= 1969 THEN ['filme antigo clássico'] ELSE []::VARCHAR[] END,
    CASE WHEN y >= 2018 THEN ['filme recente atual'] ELSE []::VARCHAR[] END,
    CASE WHEN v >= 7.8 AND c >= 300 THEN ['filme aclamado muito bom premiado obra-prima'] WHEN v >= 7.0 THEN ['filme bem avaliado bom'] WHEN v <> 0 AND v <= 4.5 AND c >= 80 THEN ['filme ruim mal avaliado fraco'] ELSE []::VARCHAR[] END,
    CASE WHEN t <> 0 AND t < 45 THEN ['curta-metragem curta'] WHEN t >= 150 THEN ['filme longo épico'] ELSE []::VARCHAR[] END)"""
_SYN = "CASE lower(x) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.KEYWORD_SYNONYMS.items()) + " END"
_BY_PERSON = "SELECT DISTINCT id FROM credits JOIN people USING (person) WHERE name = 'Supplier#00000000{}'"
_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)

ORACLE = {
    "sql_scan": "SELECT DISTINCT tmdb_id, title FROM movies WHERE release_year = 2010",
    "first_row": f"WITH {FILMS} SELECT tmdb_id, title FROM films ORDER BY tmdb_id LIMIT 1",
    "scalar_exists": f"WITH {FILMS} SELECT tmdb_id FROM films WHERE EXISTS (SELECT 1 FROM movie_keywords k WHERE k.tmdb_id = films.tmdb_id)",
    "point_lookup": "SELECT DISTINCT tmdb_id, title, release_year FROM movies WHERE tmdb_id = 1000",
    "catalog_scan": f"WITH {FILMS} SELECT tmdb_id, title, coalesce(overview, '') AS overview, [x FOR x IN coalesce(string_split(origin_countries, '|'), []) IF x <> ''] AS origin_countries, release_year FROM films",
    "json_catalog": f"""WITH {FILMS}, {_LISTS} SELECT tmdb_id, title, coalesce(release_date, '') AS release_date, TRY_CAST(substr(release_date, 1, 4) AS INTEGER) AS release_year, coalesce(overview, '') AS overview, coalesce(vote_average, 0.0) AS vote_average, coalesce(vote_count, 0) AS vote_count, CAST(coalesce(len(gl.names), 0) AS INTEGER) AS n_genres FROM films LEFT JOIN gl ON gl.id = tmdb_id""",
    "genre_arrays": f"WITH {_LISTS}, x AS (SELECT id, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM gl), f AS (SELECT name, min((id, pos)) AS fst FROM x GROUP BY name) SELECT row_number() OVER (ORDER BY fst, name) AS genre_id, name FROM f",
    "ratings_csv": "SELECT row_id, trim(name) AS name, year, rating FROM ratings WHERE trim(name) <> '' AND rating IS NOT NULL AND NOT isnan(rating)",
    "crawl_filter": f"WITH {FILMS}, {GENRES} SELECT tmdb_id, popularity FROM films WHERE tmdb_id IN (SELECT id FROM mg WHERE name = 'Drama') AND vote_count >= 50 AND vote_average >= 6.0 ORDER BY popularity DESC NULLS LAST, tmdb_id LIMIT 20",
    "crawl_dedup": f"WITH {FILMS}, b AS (SELECT tmdb_id, min(genre_id) AS genre_id FROM movie_genres WHERE tmdb_id IS NOT NULL AND genre_id IS NOT NULL GROUP BY 1) SELECT b.tmdb_id, b.genre_id, CASE WHEN f.tmdb_id IS NULL THEN NULL ELSE coalesce(title, 'Sem título') END AS title, CASE WHEN f.tmdb_id IS NULL THEN NULL ELSE coalesce(vote_count, 0) END AS vote_count FROM b LEFT JOIN films f ON f.tmdb_id = b.tmdb_id",
    "title_map": f"WITH {FILMS} SELECT tmdb_id, title FROM films",
    "poster_attach": f"""WITH {FILMS}, {_POSTERS} SELECT tmdb_id, coalesce('https://image.tmdb.org/t/p/w342' || nullif(poster_path, ''), 'https://placehold.co/300x450?text=' || replace(url_encode(substr(coalesce(title, ''), 1, 40)), '%2F', '/')) AS poster FROM films LEFT JOIN posters ON posters.id = tmdb_id""",
    "poster_by_title": f"WITH {FILMS}, {_POSTERS}, t AS (SELECT title, min(tmdb_id) AS id FROM films WHERE title IS NOT NULL GROUP BY 1) SELECT title, nullif(poster_path, '') AS poster_path FROM t LEFT JOIN posters USING (id)",
    "poster_prefetch": f"WITH {FILMS}, {_POSTERS} SELECT DISTINCT movie_id AS tmdb_id FROM user_ratings WHERE movie_id > 0 AND movie_id NOT IN (SELECT id FROM posters)",
    "search_prefetch": f"""WITH {FILMS}, a AS (SELECT DISTINCT regexp_replace(trim({fold_sql('name')}, ' '), '\\s+', ' ', 'g') || '|' || coalesce(CAST(nullif(year, 0) AS VARCHAR), '') AS key FROM ratings), k AS (SELECT regexp_replace(trim({fold_sql('title')}, ' '), '\\s+', ' ', 'g') || '|' || coalesce(CAST(nullif(release_year, 0) AS VARCHAR), '') AS key FROM films)
        SELECT key FROM a WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.key = a.key)""",
    "remembered_lookups": f"WITH {FILMS} SELECT tmdb_id AS key, coalesce(vote_count, 0) + (tmdb_id % 2) AS value FROM films",
    "result_projection": f"WITH {FILMS} SELECT tmdb_id, title, release_year, original_language, vote_average, substr(coalesce(overview, ''), 1, 240) AS overview, round(popularity, 4) AS score FROM films",
    "facet_filter_pre": f"WITH {FILMS}, {GENRES} SELECT tmdb_id FROM films WHERE release_year BETWEEN 1990 AND 2015 AND lower(coalesce(original_language, '')) = 'pt' AND tmdb_id IN (SELECT id FROM mg WHERE lower(name) = 'drama')",
    "facet_filter_post": f"WITH {FILMS} SELECT tmdb_id FROM (SELECT * FROM films ORDER BY vote_count DESC NULLS LAST, tmdb_id LIMIT 100) WHERE release_year >= 1990 AND lower(coalesce(original_language, '')) = 'pt'",
    "popular_page": f"WITH {FILMS} SELECT tmdb_id, title, release_year FROM films WHERE coalesce(vote_average, 0) >= 6.5 ORDER BY coalesce(vote_count, 0) DESC, tmdb_id LIMIT 48 OFFSET 48",
    "person_order": f"WITH {PEOPLE}, {PARTS} SELECT id, popularity FROM parts WHERE id IN ({_BY_PERSON.format(7)}) ORDER BY coalesce(popularity, 0) DESC, id LIMIT 50",
    "title_filter": f"WITH {FILMS} SELECT tmdb_id, title FROM films WHERE contains(lower(title), 'noite') ORDER BY title, tmdb_id LIMIT 8",
    "titles_sorted": f"WITH {FILMS}, {_LISTS} SELECT tmdb_id AS movie_id, coalesce(title, '') AS title, coalesce(gl.names, []) AS genres FROM films LEFT JOIN gl ON gl.id = tmdb_id",
    "with_genres": f"WITH {_LISTS} SELECT id AS tmdb_id, CAST(len(names) AS INTEGER) AS n FROM gl",
    "chosen_ids": "WITH x AS (SELECT TRY_CAST(string_split(line, ',')[3] AS BIGINT) AS id, line_id FROM ratings_raw WHERE regexp_matches(string_split(line, ',')[3], '^\\s*[+-]?[0-9]+\\s*$')) SELECT id, min(line_id) AS first_line FROM x WHERE id > 0 GROUP BY 1",
    "genre_list": "SELECT DISTINCT name FROM genres WHERE name IS NOT NULL",
    "film_genres": "SELECT b.tmdb_id, name FROM (SELECT DISTINCT tmdb_id, genre_id FROM movie_genres WHERE tmdb_id IS NOT NULL) b JOIN genres USING (genre_id)",
    "film_keywords": "SELECT b.tmdb_id, name FROM (SELECT DISTINCT tmdb_id, keyword_id FROM movie_keywords WHERE tmdb_id IS NOT NULL) b JOIN keywords USING (keyword_id)",
    "facet_lists": f"WITH {_LISTS} SELECT id AS tmdb_id, names FROM kl",
    "film_people": f"WITH {PEOPLE} SELECT id, name, role, credit_order FROM credits JOIN people USING (person)",
    "people_documents": f"""WITH {PEOPLE}, n AS (SELECT id, name, role, row_number() OVER (PARTITION BY id, role ORDER BY coalesce(credit_order, 999), name) AS rn FROM credits JOIN people USING (person)),
        d AS (SELECT id, 'dirigido por ' || string_agg(name, ', ' ORDER BY rn) AS t FROM n WHERE role = 'director' AND rn <= 2 GROUP BY 1), a AS (SELECT id, 'com ' || string_agg(name, ', ' ORDER BY rn) AS t FROM n WHERE role = 'actor' AND rn <= 6 GROUP BY 1)
        SELECT coalesce(d.id, a.id) AS id, concat_ws(' ', d.t, a.t) AS text FROM d FULL JOIN a ON a.id = d.id""",
    "person_films": f"WITH {PEOPLE} {_BY_PERSON.format(5)} AND role = 'director'",
    "director_and_actor": f"WITH {PEOPLE} {_BY_PERSON.format(5)} AND role = 'director' INTERSECT {_BY_PERSON.format(5)} AND role = 'actor'",
    "role_exists": f"WITH {PEOPLE} SELECT person, name FROM people WHERE EXISTS (SELECT 1 FROM credits c WHERE c.person = people.person AND role = 'director') AND EXISTS (SELECT 1 FROM credits c WHERE c.person = people.person AND role = 'actor')",
    "suggest_people": f"WITH {PEOPLE} SELECT name, count(*) AS credits, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM credits JOIN people USING (person) WHERE contains(lower(name), '0001') GROUP BY person, name ORDER BY count(*) DESC, person LIMIT 10",
    "fuzzy_person": f"""WITH {PEOPLE}, {PARTS}, f AS (SELECT person, 1 - levenshtein('Suplier#00000012', name)::DOUBLE / greatest(length(name), 16) AS s FROM people), e AS (SELECT * FROM f WHERE s >= 0.8 ORDER BY s DESC, person LIMIT 15),
        m AS (SELECT id, max(s) AS score FROM e JOIN credits USING (person) GROUP BY 1) SELECT m.id, round(score, 6) AS score FROM m LEFT JOIN parts ON parts.id = m.id ORDER BY score DESC, coalesce(popularity, 0) DESC, m.id LIMIT 40""",
    "fuzzy_keyword": f"""WITH {FILMS}, f AS (SELECT keyword_id, {fold_sql("trim(name, ' ')")} AS n FROM keywords WHERE name IS NOT NULL), g AS (SELECT keyword_id, {alike_sql("'wintr journey'", 'n')} AS s FROM f), e AS (SELECT * FROM g WHERE s >= 0.6 ORDER BY s DESC, keyword_id LIMIT 15),
        b AS (SELECT DISTINCT tmdb_id AS id, keyword_id FROM movie_keywords WHERE tmdb_id IS NOT NULL), m AS (SELECT id, sum(s) AS score FROM e JOIN b USING (keyword_id) GROUP BY 1)
        SELECT m.id AS tmdb_id, round(score, 6) AS score FROM m LEFT JOIN films ON films.tmdb_id = m.id ORDER BY m.score DESC, coalesce(popularity, 0) DESC, m.id LIMIT 40""",
    "genre_overlap": f"WITH {GENRES}, o AS (SELECT id, count(DISTINCT name) AS common FROM mg WHERE id <> 1000 AND name IN (SELECT name FROM mg WHERE id = 1000) GROUP BY 1) SELECT id AS tmdb_id, common, round(7.0 + common / 10.0::DOUBLE, 6) AS score FROM o ORDER BY common DESC, id LIMIT 20",
    "attribute_phrases": f"WITH {FILMS}, x AS (SELECT tmdb_id, release_year AS y, coalesce(vote_average, 0) AS v, coalesce(vote_count, 0) AS c, runtime_minutes AS t FROM films) SELECT tmdb_id, {_PHRASES} AS phrases FROM x",
    "keyword_documents": f"""WITH {FILMS}, {_LISTS}, x AS (SELECT tmdb_id, release_year AS y, coalesce(vote_average, 0) AS v, coalesce(vote_count, 0) AS c, runtime_minutes AS t, coalesce(gl.names, []) AS g, coalesce(kl.names, []) AS k FROM films LEFT JOIN gl ON gl.id = tmdb_id LEFT JOIN kl ON kl.id = tmdb_id)
        SELECT tmdb_id, array_to_string(list_concat(g, k, [s FOR s IN [{_SYN} FOR x IN k] IF s IS NOT NULL], {_PHRASES}), ' ') AS text FROM x""",
    "countries_dates": f"WITH {FILMS} SELECT tmdb_id, [x FOR x IN coalesce(string_split(origin_countries, '|'), []) IF x <> ''] AS countries, TRY_CAST(substr(release_date, 1, 4) AS INTEGER) AS date_year, CAST(release_year // 10 * 10 AS VARCHAR) || 's' AS decade FROM films",
    "decade_counts": f"WITH {FILMS} SELECT CAST(release_year // 10 * 10 AS INTEGER) AS decade, count(*) AS n, round(avg(vote_average), 4) AS avg_vote FROM films WHERE release_year IS NOT NULL GROUP BY 1",
    "passages": f"WITH {FILMS}, {_LISTS} SELECT tmdb_id, 'passage: ' || coalesce(nullif(trim(overview), ''), trim(coalesce(title, '') || ' ' || array_to_string(coalesce(kl.names, [])[1:10], ' '))) AS passage FROM films LEFT JOIN kl ON kl.id = tmdb_id",
    "name_keys": rf"WITH {FILMS} SELECT tmdb_id, regexp_replace(regexp_replace(trim(lower(coalesce(title, '')), ' '), '\s+', ' ', 'g'), '^(?:o|a|os|as|um|uma|uns|umas)(?: |$)', '') AS name_key, regexp_replace(lower(trim(title, ' ')), '\s+', ' ', 'g') AS space_key FROM films",
    "clean_queries": rf"""WITH {FILMS}, x AS (SELECT tmdb_id, trim('Aquele filme da ' || coalesce(overview, ''), ' ') AS t FROM films), z AS (SELECT tmdb_id, t, regexp_split_to_array(t, '\s+') AS w FROM x),
        y AS (SELECT tmdb_id, t, w, list_position([{fold_sql("regexp_replace(t, '^[?¿!.,;:]+|[?¿!.,;:]+$', '', 'g')")} NOT IN ({_STOP}) FOR t IN w], true) AS f FROM z),
        c AS (SELECT tmdb_id, t, regexp_replace(array_to_string(w[coalesce(nullif(f, 0), len(w)):], ' '), '^[ ?¿!.,;:]+|[ ?¿!.,;:]+$', '', 'g') AS cleaned FROM y) SELECT tmdb_id, CASE WHEN cleaned <> '' THEN cleaned ELSE t END AS cleaned FROM c""",
    "title_lookup": f"WITH {FILMS}, q AS (SELECT lower(upper(title)) AS asked FROM films WHERE title IS NOT NULL ORDER BY vote_count DESC NULLS LAST, tmdb_id LIMIT 1) SELECT tmdb_id, title FROM films, q WHERE contains(lower(title), asked) ORDER BY (lower(title) <> asked), tmdb_id LIMIT 1",
    "ratings_sample": "SELECT id, user_id, movie_id, rating FROM user_ratings ORDER BY md5(concat_ws('|', id, 42)), id LIMIT 500",
    "random_popular": f"WITH {FILMS} SELECT tmdb_id, coalesce(vote_average, 7.5) AS score FROM films ORDER BY md5(concat_ws('|', tmdb_id, 7)), tmdb_id LIMIT 30",
    "keyword_facets": "WITH k AS (SELECT keyword_id, lower(trim(name)) AS name FROM keywords WHERE name IS NOT NULL), b AS (SELECT DISTINCT tmdb_id AS id, name FROM movie_keywords JOIN k USING (keyword_id) WHERE tmdb_id IS NOT NULL) SELECT name, count(*) AS films, round(count(*)::DOUBLE / (SELECT count(DISTINCT id) FROM b), 6) AS share FROM b GROUP BY 1 ORDER BY films DESC, name LIMIT 50",
    "latest_ratings": "SELECT user_id, movie_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, movie_id ORDER BY rated_at DESC NULLS LAST, id DESC) AS rn FROM user_ratings WHERE user_id IS NOT NULL AND movie_id IS NOT NULL) WHERE rn = 1",
}
