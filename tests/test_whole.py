"""Queries over every row: what their narrower forms leave out is there, and the rest is the same."""

import os
import random
import sys
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from twins import DATA, plain  # noqa: E402

from tamarack.functions.similarity import weighted_ratio  # noqa: E402
from tamarack.functions.text import clean_query  # noqa: E402
from tamarack.operators.linkage import letters, may_reach  # noqa: E402
from tamarack.plans.common import ratings  # noqa: E402
from tamarack.plans.queries import QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(spark, name, where="true"):
    df = QUERIES[name](spark, DATA)
    return sorted(str(tuple(map(plain, r))) for r in df.where(where).select(sorted(df.columns)).collect())


@pytest.mark.parametrize("name", ["item_item_scores", "predicted_ratings", "taste_centroid", "why_reasons"])
def test_every_user(spark, name):
    assert QUERIES[name](spark, DATA).where("user = 777").count() > 0


def test_every_user_folded_in(spark):
    films = spark.read.parquet(f"{DATA}/movies.parquet").selectExpr("tmdb_id AS item").distinct()
    rated = ratings(spark, DATA).join(films, "item", "left_semi").select("user").distinct()
    got = QUERIES["fold_in"](spark, DATA).select("user")
    assert rated.exceptAll(got).count() == 0 and got.where("user = 777").count() == 1


@pytest.mark.parametrize("name", ["poster_attach", "name_keys", "clean_queries"])
def test_every_title(spark, name):
    films = spark.read.parquet(f"{DATA}/movies.parquet").where("tmdb_id IS NOT NULL")
    assert len(rows(spark, name)) == films.select("tmdb_id").distinct().count()


def test_titles_and_whole_overviews(spark, tmp_path):
    text = "não " + " ".join(f"palavra{k}" for k in range(30)) + " Ünïted 海"
    cells = [(1, "Ação: Ž", text), (3, "海の夜", None)]
    empty = spark.read.parquet(f"{DATA}/movies.parquet").limit(0)
    df = empty.unionByName(spark.createDataFrame(cells, "tmdb_id long, title string, overview string"), allowMissingColumns=True)
    df.write.parquet(f"{tmp_path}/movies.parquet")
    one = lambda q: {r["tmdb_id"]: r for r in QUERIES[q](spark, str(tmp_path)).collect()}
    for r in (1, 3):
        assert one("clean_queries")[r]["cleaned"] == clean_query("Aquele filme da " + (cells[r // 2][2] or "")), r
    assert one("name_keys")[1]["name_key"] == "ação: ž" and one("name_keys")[3]["space_key"] == "海の夜"
    assert one("poster_attach")[3]["poster"].endswith("text=" + quote("海の夜"))


def test_filter_keeps_every_match(spark):
    rng = random.Random(2)
    words = ["segepisao:", "segepisao", "silencio", "el", "azul", "farol", "de", "noite", "lua"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(90)] + ["segepisao", "segepisao: el silencio", "a", "a  a b"]
    texts += [t[:k] + rng.choice(["", "x"]) + t[k + 1 :] for t in texts for k in [rng.randrange(len(t))]]
    one = spark.createDataFrame([(t,) for t in sorted(set(texts))], "name string")
    of = lambda c: F.struct(letters(F.col(c)).alias("letters"), F.split(F.trim(c), r"\s+").alias("words"))
    pairs = one.crossJoin(one.toDF("title")).withColumn("kept", may_reach(F.col("name"), F.col("title"), of("name"), of("title"))).collect()
    lost = [r for r in pairs if not r["kept"] and weighted_ratio(r["name"], r["title"]) >= 82]
    assert not lost and any(not r["kept"] for r in pairs)


def test_every_export_row(spark):
    every = QUERIES["resolve_cascade"](spark, DATA)
    exports = spark.read.parquet(f"{DATA}/ratings.parquet")
    assert every.count() == exports.count()
    undated = every.join(exports.where("year IS NULL OR year = 0"), "row_id").where("resolver IS NOT NULL")
    assert undated.count() > 0


def test_no_two_texts_of_other_scripts_are_one(spark, tmp_path):
    """Names beyond ASCII link by what they say, not by how long they are."""
    films = spark.createDataFrame([(1, "海の夜", 2000), (2, "Зимний вечер", 2000), (3, "Ação", 2001)], "tmdb_id long, title string, release_year int")
    movies = spark.read.parquet(f"{DATA}/movies.parquet").limit(0).unionByName(films, allowMissingColumns=True)
    movies.write.parquet(f"{tmp_path}/movies.parquet")
    names = [(1, "山と朝", 2000), (2, "Летний день?", 2000), (3, "海の夜", 2000), (4, "зимний вечер", 2001), (5, "acao", None), (6, "Тёмный город", 2000), (7, "Зимний вечр", 2000)]
    exports = spark.createDataFrame(names, "row_id long, name string, year int")
    spark.read.parquet(f"{DATA}/ratings.parquet").limit(0).unionByName(exports, allowMissingColumns=True).write.parquet(f"{tmp_path}/ratings.parquet")
    got = {r["row_id"]: r["tmdb_id"] for r in QUERIES["resolve_cascade"](spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: None, 3: 1, 4: 2, 5: 3, 6: None, 7: 2}
