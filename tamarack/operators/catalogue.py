"""Catalogue operators: facets of items, people, pages, documents about items, deduplication, genre neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions import text as tx


def names_of(bridge: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(id, name) of an item's facets: the bridge's repeated rows count once, unknown names are left out."""
    return bridge.where(F.col("id").isNotNull()).distinct().join(names, key).select("id", "name")


def name_lists(bridge: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(id, names): all facet names of every item in alphabetical order; an unknown name is empty."""
    joined = bridge.where(F.col("id").isNotNull()).distinct().join(names, key, "left").select("id", F.coalesce("name", F.lit("")).alias("name"))
    return joined.groupBy("id").agg(F.sort_array(F.collect_list("name")).alias("names"))


def once(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def people_of_name(people: DataFrame, credits: DataFrame, name: str, role: str | None = None, roles: tuple[str, ...] = ("actor", "director")) -> DataFrame:
    """(id): items of the people with exactly this name; a role outside `roles` is ignored."""
    mine = credits.where(F.col("role") == role) if role in roles else credits
    return mine.join(people.where(F.col("name") == name), "person", "left_semi").select("id").distinct()


def suggest_people(people: DataFrame, credits: DataFrame, prefix: str, role: str | None = None, limit: int = 10, roles: tuple[str, ...] = ("actor", "director")) -> DataFrame:
    """(name, credits, roles): people whose name holds the text (two characters at least), the most credited first.

    % and _ in the text are plain characters.
    """
    prefix = (prefix or "").strip()
    mine = credits.where(F.col("role") == role) if role in roles else credits
    found = people.where(F.contains(F.lower("name"), F.lit(prefix.lower())) & F.lit(len(prefix) >= 2))
    counted = mine.join(found, "person").groupBy("person", "name").agg(F.count(F.lit(1)).alias("credits"), F.concat_ws(",", F.sort_array(F.collect_set("role"))).alias("roles"))
    return counted.orderBy(F.desc("credits"), "person").limit(limit).select("name", "credits", "roles")


def popular(catalogue: DataFrame, n: int = 48, offset: int = 0, least: float = 6.5) -> DataFrame:
    """A page of the most voted items that are rated `least` or better."""
    good = catalogue.where(F.coalesce("vote_average", F.lit(0.0)) >= least)
    return good.orderBy(F.desc(F.coalesce("votes", F.lit(0))), "id").offset(offset).limit(n)


def genre_dictionary(df: DataFrame, key: str, genres: str) -> DataFrame:
    """(genre_id, name): distinct names of array columns, numbered from 1 by first appearance in the order of keys."""
    seen = df.select(F.col(key).alias("k"), F.posexplode(genres).alias("pos", "name")).groupBy("name").agg(F.min(F.struct("k", "pos")).alias("at"))
    # as many rows as there are genres
    return seen.select(F.row_number().over(Window.orderBy("at", "name")).alias("genre_id"), "name")


def people_documents(people: DataFrame, credits: DataFrame, directors: int = 2, cast: int = 6) -> DataFrame:
    """(id, text): "dirigido por A, B com C, D": the first directors and the first actors by credit order."""
    named = credits.join(people, "person")
    order = F.coalesce("credit_order", F.lit(999))

    def first(role: str, k: int, lead: str, *by: Column) -> DataFrame:
        w = Window.partitionBy("id").orderBy(*by)
        few = named.where(F.col("role") == role).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
        listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "name"))), lambda s: s["name"]), ", ")
        return few.groupBy("id").agg(F.concat(F.lit(lead + " "), listed).alias(role))

    d = first("director", directors, "dirigido por", order.asc(), F.asc("name"))
    a = first("actor", cast, "com", order.asc(), F.asc("name"))
    return d.join(a, "id", "full").select("id", F.concat_ws(" ", "director", "actor").alias("text"))


def keyword_documents(catalogue: DataFrame, genres: DataFrame, keywords: DataFrame, people_docs: DataFrame | None = None) -> DataFrame:
    """(id, text): genres, keywords, their synonyms, attribute phrases and people, joined by blanks.

    `genres` and `keywords` are (id, names). `catalogue` has id, year, vote_average, votes, runtime.
    """
    empty = F.array().cast("array<string>")
    df = catalogue.join(genres.select("id", F.col("names").alias("g")), "id", "left").join(keywords.select("id", F.col("names").alias("k")), "id", "left")
    people = F.lit(None).cast("string")
    if people_docs is not None:
        df = df.join(people_docs.select("id", F.col("text").alias("p")), "id", "left")
        people = F.nullif(F.col("p"), F.lit(""))
    g, k = F.coalesce("g", empty), F.coalesce("k", empty)
    phrases = tx.attribute_phrases(F.col("year"), F.col("vote_average"), F.col("votes"), F.col("runtime"))
    return df.select("id", F.concat_ws(" ", F.concat(g, k, tx.keyword_synonyms(k), phrases), people).alias("text"))


def genre_overlap(genres: DataFrame, source: int, n: int = 10) -> DataFrame:
    """(id, common, score): items that share genres with one item; 7 plus a tenth of their number; more first, then id."""
    own = genres.where(F.col("id") == source).select("genre").distinct()
    hits = genres.where(F.col("id") != source).join(F.broadcast(own), "genre").groupBy("id").agg(F.countDistinct("genre").alias("common"))
    return hits.withColumn("score", 7.0 + F.col("common") / 10).orderBy(F.desc("common"), "id").limit(n)


def with_posters(items: DataFrame, posters: DataFrame, base: str = "https://image.tmdb.org/t/p/w342") -> DataFrame:
    """Items (id, title, ...) with poster: base + path where one is known and not empty, else a placeholder."""
    path = F.nullif(F.col("poster_path"), F.lit(""))
    joined = items.join(posters.select("id", "poster_path"), "id", "left")
    return joined.withColumn("poster", F.coalesce(F.concat(F.lit(base), path), tx.placeholder_url(F.coalesce("title", F.lit(""))))).drop("poster_path")


def ordered_ids(raw: DataFrame, value: str, position: str) -> DataFrame:
    """(id): values that are whole numbers above 0, each once, in the order of first appearance."""
    ids = raw.select(F.col(value).try_cast("long").alias("id"), F.col(position).alias("at")).where("id > 0")
    return ids.groupBy("id").agg(F.min("at").alias("at")).orderBy("at")


def clamp(value, low: int, high: int, default: int) -> int:
    """A request number within bounds; what is not a number gives the default."""
    try:
        return max(low, min(int(value), high))
    except (TypeError, ValueError):
        return default
