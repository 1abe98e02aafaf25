"""Sources and sinks: catalogue tables, JSON catalogue, ratings CSV, remembered lookups, database tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import countries, year_of
from tamarack.runtime import path_of

CATALOGUE_JSON = (
    "id LONG, title STRING, original_title STRING, overview STRING, release_date STRING, vote_average DOUBLE, vote_count LONG, genres ARRAY<STRING>, poster_path STRING, backdrop_path STRING"
)


def sql(spark: SparkSession, statement: str, **args) -> DataFrame:
    """A query with named parameters."""
    return spark.sql(statement, args=args or None)


def first_row(df: DataFrame):
    """The first row, or None."""
    return df.limit(1).first()


def scalar(df: DataFrame):
    """The first column of the first row, or None."""
    row = first_row(df)
    return row[0] if row is not None else None


def rows(df: DataFrame):
    """Rows one after another, a partition at a time: for what must leave the cluster in order."""
    return df.toLocalIterator()


def database(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    """A table of a relational database; give partitionColumn, lowerBound, upperBound and numPartitions for a parallel read."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def json_catalogue(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The JSON form of a catalogue with its fixed schema; multi_line for one array in one file."""
    return spark.read.schema(CATALOGUE_JSON).option("multiLine", multi_line).json(path)


def normalise_json(df: DataFrame) -> DataFrame:
    """JSON rows as catalogue rows: year from the date, no runtime, no countries; missing texts empty, numbers 0."""
    return df.select(
        F.col("id").alias("tmdb_id"), "title", F.coalesce("release_date", F.lit("")).alias("release_date"), year_of(F.col("release_date")).alias("release_year"),
        F.lit(None).cast("int").alias("runtime_minutes"), F.array().cast("array<string>").alias("origin_countries"), F.coalesce("overview", F.lit("")).alias("overview"),
        F.coalesce("vote_average", F.lit(0.0)).alias("vote_average"), F.coalesce("vote_count", F.lit(0)).alias("vote_count"), "genres",
    )


def catalogue(df: DataFrame) -> DataFrame:
    """Catalogue rows with the null rules applied: overview empty, countries as an array."""
    return df.withColumns({"overview": F.coalesce("overview", F.lit("")), "origin_countries": countries(F.col("origin_countries"))})


def any_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue rows from what lies in `folder`: the table movies.parquet if there is one, else movies.json."""
    fs, p = path_of(spark, f"{folder}/movies.parquet")
    if fs.exists(p):
        return catalogue(spark.read.parquet(f"{folder}/movies.parquet"))
    return normalise_json(json_catalogue(spark, f"{folder}/movies.json"))


def append_ratings(df: DataFrame, path: str) -> None:
    """Adds rows (user, item, rating) to the ratings at `path`, each with the time of writing; ratings outside 0.5 to 5 are refused."""
    checked = F.when(F.col("rating").between(0.5, 5.0), F.col("rating").cast("double")).otherwise(F.raise_error(F.lit("a rating must lie between 0.5 and 5")))
    df.select("user", "item", checked.alias("rating"), F.current_timestamp().alias("rated_at")).write.mode("append").parquet(path)


def ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """A ratings export with header and optional byte order mark; quoted fields may hold commas, quotes and line ends."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def parse_ratings(df: DataFrame) -> DataFrame:
    """Rows of an export with usable values: name trimmed and not empty, numeric rating, whole year or null, review trimmed."""
    number = F.trim("Rating").try_cast("double")
    review = F.trim("Review") if "Review" in df.columns else F.lit("")
    out = df.select(F.trim("Name").alias("name"), F.trim("Year").try_cast("int").alias("year"), number.alias("rating"), F.coalesce(review, F.lit("")).alias("review"), *[c for c in df.columns if c not in ("Name", "Year", "Rating", "Review")])
    return out.where((F.col("name") != "") & F.col("rating").isNotNull())


def remember(spark: SparkSession, path: str, new: DataFrame, key: str) -> DataFrame:
    """A remembered lookup table at `path` with `new` rows added; rows of a key that is known stay as they are.

    The rows go as new files beside the old ones, which are never rewritten. Only a path that does not exist counts as
    nothing remembered; a table that cannot be read is an error.
    """
    fs, p = path_of(spark, path)
    fresh = new.dropDuplicates([key])
    if fs.exists(p):
        old = spark.read.parquet(path)
        fresh = fresh.join(old.select(key), key, "left_anti").select(*old.columns)
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)
