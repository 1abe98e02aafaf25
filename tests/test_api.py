"""The service's requests on a small catalogue."""

import pytest
from pyspark.sql import functions as F

from tamarack import cli
from tamarack.api import BadRequest, Service
from tamarack.config import settings
from tamarack.functions.models import encode, hashed_encoder, keyword_vectors, score_pairs
from tamarack.operators import collaborative as cf
from tamarack.operators.bm25 import Bm25Index
from tamarack.operators.search import SearchEngine
from tamarack.sources import remote
from tamarack.sources import tables as so


@pytest.fixture(scope="module")
def service(spark):
    rows = [(k, f"Filme {k}", f"um trem numero {k} cruza o mar", 1990 + k, "pt", 10 * k, 5.0 + k / 4, float(k)) for k in range(1, 13)]
    cat = spark.createDataFrame(rows, "id long, title string, overview string, year int, language string, votes long, vote_average double, popularity double")
    v = cat.select("id", encode(F.col("overview"), hashed_encoder(8)).alias("vector"))
    people = spark.createDataFrame([(1, "Ana"), (2, "Bia")], "person long, name string")
    credits = spark.createDataFrame([(1, 3, "director", 1), (2, 3, "actor", 1), (1, 5, "director", 1)], "person long, id long, role string, credit_order int")
    lists = spark.createDataFrame([(k, ["Drama"] if k % 2 else ["Terror", "Drama"]) for k in range(1, 13)], "id long, names array<string>")
    genres = lists.select(F.col("id").alias("item"), F.explode("names").alias("value"))
    engine = SearchEngine(cat, Bm25Index.build(cat, "id", "overview"), vectors=v, genres=genres.select(F.col("item").alias("id"), F.col("value").alias("name")), people=people, credits=credits, encode=lambda t: hashed_encoder(8)()([t])[0])
    posters = spark.createDataFrame([(3, "/a.jpg"), (5, "")], "id long, poster_path string")
    items = v.select(F.col("id").alias("item"), F.col("vector").alias("qi"), F.lit(0.1).alias("bi"))
    near = spark.createDataFrame([(3, 4, 0.9), (3, 6, 0.5)], "src long, dst long, sim double")
    return Service(spark, engine, lists, {"genres": genres}, posters, items, near, 3.5)


def test_lists(service):
    assert service.health() == {"status": "ok"}
    assert [r["name"] for r in service.genres().collect()] == ["Drama", "Terror"]
    assert [r["movie_id"] for r in service.get_movies().collect()][:3] == [1, 10, 11]
    assert [r["id"] for r in service.popular(2, 1).orderBy(F.desc("release_year")).collect()] == [11, 10]
    assert [tuple(r) for r in service.people("an").collect()] == [("Ana", 2, "director")]


def test_search(service):
    with pytest.raises(BadRequest):
        service.search({"query": "  "})
    got = service.search({"director": "Ana", "n": "x"}).orderBy("position").collect()
    assert [r["id"] for r in got] == [5, 3] and got[0]["poster"].endswith("text=Filme%205") and got[1]["poster"].endswith("/a.jpg")
    assert {r["id"] for r in service.search({"query": "trem mar", "year_min": 2000, "genre": "terror", "n": 50}).collect()} <= {10, 12}


def test_recommendations(service, tmp_path):
    with pytest.raises(BadRequest):
        service.submit_ratings(["x", -1, None])
    out = service.submit_ratings(["3", 5, 3], 4)
    recs = out["recommendations"].collect()
    assert len(recs) == 4 and not {3, 5} & {r["id"] for r in recs} and out["profile"].first()["n_liked"] == 2
    (tmp_path / "r.csv").write_text("Date,Name,Year,URI,Rating\n2020,Filme 3,1993,u,5\n2020,Filme 5,1994,u,4\n2020,Nada mesmo,1950,u,4\n", encoding="utf-8")
    got = service.recommend(str(tmp_path / "r.csv"), 3)
    assert (got["total_rows"], got["matched"]) == (3, 2) and len(got["recommendations"].collect()) == 3
    (tmp_path / "n.csv").write_text("Date,Name,Year,URI,Rating\n2020,Nada mesmo,1950,u,4\n", encoding="utf-8")
    with pytest.raises(BadRequest):
        service.recommend(str(tmp_path / "n.csv"))


def test_models(spark):
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    got = [r[0] for r in df.select(encode(F.col("t"), hashed_encoder(4))).collect()]
    assert sum(x * x for x in got[0]) == pytest.approx(1) and got[1] == [0.0] * 4
    assert [r[0] for r in df.select(score_pairs(F.col("t"), F.lit("xy"), lambda: lambda pairs: [float(len(a) + len(b)) for a, b in pairs])).collect()] == [5.0, 2.0]
    names = spark.createDataFrame([("Sea ",), ("sea",), (None,)], "name string")
    assert keyword_vectors(names, hashed_encoder(4)).count() == 1


def test_commands(spark, tmp_path, capsys):
    films = spark.createDataFrame([(k, f"Filme {w}", f"um {w} cruza o mar", 1990 + k, "pt", 10 * k, 6.0, float(k)) for k, w in enumerate(("trem", "barco", "farol", "navio"), 1)], "tmdb_id long, title string, overview string, release_year int, original_language string, vote_count long, vote_average double, popularity double")
    films.write.parquet(f"{tmp_path}/films/movies.parquet")
    cli.main(["build-index", f"{tmp_path}/films", f"{tmp_path}/index"])
    engine = SearchEngine.load(spark, f"{tmp_path}/index")
    assert engine.vectors is None and engine.genres is None
    assert [r["id"] for r in engine.search("barco no mar", "synopsis", 1).collect()] == [2]
    spark.createDataFrame([(1, "o farol", "farol", 1993), (2, "mar", "navio", 1994), (3, "xyz", "trem", 1991)], "case int, query string, hint string, year int").write.parquet(f"{tmp_path}/cases")
    cli.main(["evaluate", f"{tmp_path}/index", f"{tmp_path}/cases"])
    assert "'n': 3, 'resolved': 2, 'mrr': 0.4167" in capsys.readouterr().out
    rated = [(u, i, float(1 + (u + i) % 5)) for u in range(30) for i in range(12) if (u * i) % 3]
    spark.createDataFrame(rated, "user_id long, movie_id long, rating double").write.parquet(f"{tmp_path}/ratings")
    cli.main(["train", f"{tmp_path}/ratings", f"{tmp_path}/model", "--factors", "2", "--rounds", "2"])
    assert "'rmse'" in capsys.readouterr().out
    mu, items, near = cf.load(spark, f"{tmp_path}/model")
    assert 1 < mu < 5 and items.count() == 8 and near.where("src = dst").count() == 0


def test_sources_and_settings(spark, tmp_path):
    (tmp_path / "movies.json").write_text('{"id": 1, "title": "T", "release_date": "1999-02-01"}')
    assert [r["release_year"] for r in so.any_catalogue(spark, str(tmp_path)).collect()] == [1999]
    spark.createDataFrame([(5, "U", None, "BR|PT", 2001)], "tmdb_id long, title string, overview string, origin_countries string, release_year int").write.parquet(f"{tmp_path}/movies.parquet")
    assert [(r["tmdb_id"], r["origin_countries"]) for r in so.any_catalogue(spark, str(tmp_path)).collect()] == [(5, ["BR", "PT"])]
    one = spark.createDataFrame([(1, 2, 4.5)], "user long, item long, rating double")
    so.append_ratings(one, f"{tmp_path}/rated")
    so.append_ratings(one, f"{tmp_path}/rated")
    assert spark.read.parquet(f"{tmp_path}/rated").where("rated_at IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="between"):
        so.append_ratings(one.withColumn("rating", F.lit(9.0)), f"{tmp_path}/rated")
    (tmp_path / ".env").write_text("# a note\nA=1\nexport B='two words'\nC = x=y\nnothing\nA2=\n")
    assert settings(f"{tmp_path}/.env", {"A": "9"}) == {"A": "9", "B": "two words", "C": "x=y", "A2": ""} and settings(f"{tmp_path}/none", {}) == {}


def test_explanations(service):
    got = service.search({"query": "trem mar filme", "director": "Ana"}).orderBy("position").collect()
    assert got and all(r["explanation"]["constraints"] == {"director": "Ana"} for r in got)
    assert got[0]["explanation"]["matched_title_terms"] == ["filme"] and got[0]["explanation"]["matched_keywords"] == []


def test_lookups_by_a_service(spark):
    def factory():
        known = {"a": {"id": 1, "title": "A"}, "b": [{"id": 2}, {"id": 3, "title": "B3"}], "c": [], "d": None}
        return known.__getitem__

    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",), ("x",), (None,)], "k string")
    got = sorted((tuple(r) for r in remote.lookup(keys, "k", factory, "id long, title string").collect()), key=str)
    assert got == [("a", True, 1, 1, "A"), ("b", True, 1, 2, None), ("b", True, 2, 3, "B3"), ("c", True, None, None, None), ("d", True, None, None, None), ("x", False, None, None, None)]
    assert remote.lookup(keys.limit(0), "k", factory, "id long").count() == 0
