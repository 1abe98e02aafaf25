"""Queries on reading exports: rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.runtime import table
from tamarack.sources.malformed import Check, Layout, read_lines

RATINGS_EXPORT = Layout(
    columns=("Date", "Name", "Year", "URI", "Rating", "Review"),
    checks=(
        Check("rating", 4, r"[0-9]+(?:\.[0-9]+)?", low=0.5, high=5.0, step=0.5),
        Check("year", 2, r"[0-9]{4}", low=1874, high=2030, empty=True),
        Check("name", 1, visible=True),
    ),
)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read_lines(table(spark, d, "ratings_raw"), "line_id", "line", RATINGS_EXPORT)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of exports that fail to parse, with the reason."""
    return _lines(spark, d).where("reason IS NOT NULL").select("line_id", "reason")


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines of exports as rows."""
    f = lambda k: F.get("fields", F.lit(k))
    return _lines(spark, d).where("reason IS NULL").select(
        "line_id", f(0).alias("logged_on"), f(1).alias("name"), F.trim(f(2)).try_cast("int").alias("year"), f(3).alias("uri"), F.trim(f(4)).try_cast("double").alias("rating"), f(5).alias("review")
    )


def p3_repairs(spark: SparkSession, d: str) -> DataFrame:
    """The failed lines with the cheapest edits that would give six fields."""
    return _lines(spark, d).where("reason IS NOT NULL").select("line_id", "reason", "cost", "edits", "fields")


QUERIES = {"p3_found": p3_found, "p3_rows": p3_rows, "p3_repairs": p3_repairs}

_JUDGED = r"""
    l AS (SELECT line_id, regexp_replace(line, '^\x{FEFF}', '') AS line FROM ratings_raw),
    q AS (SELECT line_id, regexp_full_match(line, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') AS legal,
                 regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1) AS raw FROM l),
    f AS (SELECT line_id, legal, [CASE WHEN x[1] = '"' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END FOR x IN raw] AS f FROM q),
    j AS (SELECT line_id, f, CASE
            WHEN NOT legal THEN 'quoting'
            WHEN len(f) <> 6 THEN 'columns'
            WHEN NOT regexp_full_match(trim(f[5], ' '), '[0-9]+(\.[0-9]+)?') THEN 'rating'
            WHEN CAST(trim(f[5], ' ') AS DOUBLE) NOT BETWEEN 0.5 AND 5 OR CAST(trim(f[5], ' ') AS DOUBLE) * 2 <> floor(CAST(trim(f[5], ' ') AS DOUBLE) * 2) THEN 'rating'
            WHEN trim(f[3], ' ') <> '' AND NOT regexp_full_match(trim(f[3], ' '), '[0-9]{4}') THEN 'year'
            WHEN trim(f[3], ' ') <> '' AND CAST(trim(f[3], ' ') AS INTEGER) NOT BETWEEN 1874 AND 2030 THEN 'year'
            WHEN NOT regexp_matches(f[2], '[^\p{Z}\p{C}\x{034F}\x{115F}\x{1160}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]') THEN 'name'
          END AS reason FROM f)"""

ORACLE = {
    "p3_found": f"WITH {_JUDGED} SELECT line_id, reason FROM j WHERE reason IS NOT NULL",
    "p3_rows": f"""WITH {_JUDGED} SELECT line_id, f[1] AS logged_on, f[2] AS name, TRY_CAST(trim(f[3], ' ') AS INTEGER) AS year, f[4] AS uri,
                   CAST(trim(f[5], ' ') AS DOUBLE) AS rating, f[6] AS review FROM j WHERE reason IS NULL""",
}
