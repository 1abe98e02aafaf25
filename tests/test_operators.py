"""Sources, BM25, facets, linkage, collaborative filtering, profiles, evaluation, search and streams."""

import os
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack import runtime
from tamarack.functions.similarity import edit_similarity, weighted_ratio
from tamarack.operators import catalogue as co
from tamarack.operators import collaborative as cf
from tamarack.operators import evaluate as ev
from tamarack.operators import linkage as lk
from tamarack.operators import profile as pr
from tamarack.operators.bm25 import Bm25Index, tfidf
from tamarack.operators.dense import top_products
from tamarack.operators.search import SearchEngine, facet_filter
from tamarack.plans import recommend
from tamarack.plans.imports import RATINGS_EXPORT
from tamarack.sources import tables as so
from tamarack.sources.malformed import marks, parse_line, read_lines, settle_delimiters, settle_quotes
from tamarack.streaming import popularity as sp

DOCS = [(1, "trem azul trem"), (2, "mar azul"), (3, ""), (4, None), (5, "avó AVÓ avo")]


def test_bm25_by_hand(spark, tmp_path):
    index = Bm25Index.build(spark.createDataFrame(DOCS, "id long, text string"), "id", "text")
    assert index.n_docs == 5 and index.avgdl == pytest.approx(8 / 3)
    got = {r["id"]: r["score"] for r in index.scores("azul azul AVÓ").collect()}
    idf = lambda df: np.log(1 + (5 - df + 0.5) / (df + 0.5))
    part = lambda df, tf, n: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / (8 / 3)))
    assert got == pytest.approx({1: part(2, 1, 3), 2: part(2, 1, 2), 5: part(1, 3, 3)})
    index.save(str(tmp_path / "index"))
    again = Bm25Index.load(spark, str(tmp_path / "index"))
    assert {r["id"]: r["score"] for r in again.scores("azul azul AVÓ").collect()} == pytest.approx(got)
    batch = index.batch(spark.createDataFrame([(9, "azul"), (8, "zzz")], "q long, t string"), "q", "t").collect()
    assert {(r["query"], r["id"]) for r in batch} == {(9, 1), (9, 2)}
    assert Bm25Index.build(spark.createDataFrame([], "id long, text string"), "id", "text").scores("x").count() == 0


def test_tfidf_unit_length(spark):
    w = tfidf(spark.createDataFrame(DOCS, "id long, text string"), "id", "text")
    assert all(r[0] == pytest.approx(1) for r in w.groupBy("id").agg(F.sum(F.col("weight") ** 2)).select("sum(POWER(weight, 2))").collect())


def test_facets(spark):
    df = spark.createDataFrame([(1, 1990, "PT"), (2, None, "pt"), (3, 2000, None)], "id long, year int, language string")
    genres = spark.createDataFrame([(1, "Drama"), (1, "Drama"), (3, "Terror")], "id long, name string")
    ids = lambda f: sorted(r["id"] for r in facet_filter(df, f, genres).collect())
    assert ids({"year_min": 1980}) == [1, 3] and ids({"language": "PT"}) == [1, 2] and ids({"genre": "DRAMA"}) == [1] and ids(None) == [1, 2, 3] and ids({"year": None}) == [1, 2, 3]


def test_people(spark):
    people = spark.createDataFrame([(1, "Ana_%"), (2, "Bia"), (3, "Ana Lu")], "person long, name string")
    credits = spark.createDataFrame([(1, 10, "director", None), (2, 10, "director", 2), (2, 10, "actor", 1), (3, 11, "actor", None), (3, 10, "actor", 0)], "person long, id long, role string, credit_order int")
    assert [tuple(r) for r in co.suggest_people(people, credits, "ana").collect()] == [("Ana Lu", 2, "actor"), ("Ana_%", 1, "director")]
    assert co.suggest_people(people, credits, "_%").count() == 1 and co.suggest_people(people, credits, "a").count() == 0
    docs = {r["id"]: r["text"] for r in co.people_documents(people, credits).collect()}
    assert docs == {10: "dirigido por Bia, Ana_% com Ana Lu, Bia", 11: "com Ana Lu"}
    assert sorted(r["id"] for r in co.people_of_name(people, credits, "Bia", "other").collect()) == [10]


def test_requests():
    assert [co.clamp(x, 1, 50, 12) for x in ("7", 0, 99, None, "x")] == [7, 1, 50, 12, 12]


def test_ordered_ids(spark):
    raw = spark.createDataFrame([("5", 1), ("x", 2), ("-3", 3), ("5", 4), ("2", 5), (None, 6)], "v string, p int")
    assert [r["id"] for r in co.ordered_ids(raw, "v", "p").collect()] == [5, 2]


def test_ratings_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿Date,Name,Year,URI,Rating,Review\n2020,"Um, dois",1999,u,3.5,"diz ""oi"""\n2020, ,1999,u,3,\n2020,B,x,u,,\n2020,C,12a,u,4,ok\n', encoding="utf-8")
    got = so.parse_ratings(so.ratings_csv(spark, str(tmp_path / "r.csv"))).select("name", "year", "rating", "review").collect()
    assert [tuple(r) for r in got] == [("Um, dois", 1999, 3.5, 'diz "oi"'), ("C", None, 4.0, "ok")]


def test_json_catalogue(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"id": 1, "title": "T", "release_date": "1999-02-01", "genres": ["A"]}, {"id": 2, "release_date": "?"}]')
    got = so.normalise_json(so.json_catalogue(spark, str(tmp_path / "m.json"), multi_line=True)).orderBy("tmdb_id").collect()
    assert [(r["tmdb_id"], r["release_year"], r["overview"], r["vote_count"]) for r in got] == [(1, 1999, "", 0), (2, None, "", 0)]
    assert so.scalar(spark.range(0)) is None and so.scalar(spark.range(1)) == 0 and so.first_row(spark.range(0)) is None
    assert so.sql(spark, "SELECT :a + 1 AS b", a=2).first()["b"] == 3 and [r["id"] for r in so.rows(spark.range(3))] == [0, 1, 2]


def test_remembered(spark, tmp_path):
    path = str(tmp_path / "kv")
    so.remember(spark, path, spark.createDataFrame([(1, "a")], "k int, v string"), "k")
    got = so.remember(spark, path, spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), "k")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a"), (2, "c")]


@pytest.mark.parametrize(("line", "reason"), [
    ('d,n,2000,u,3,"a ""b"" c"', None), ('d,"n, m",2000,u,0.5,', None), ("d,n,,u, 5.0 ,", None), ('d,n" x,2000,u,3,', "quoting"), ('d,"n" x,2000,u,3,', "quoting"), ('d,"n,2000,u,3,', "quoting"),
    ('d,n,2000,u,3,"a""', "quoting"), ("d,n,2000,u,3", "columns"), ("d,n,2000,u,3,,", "columns"), ("", "columns"), ("d,n,2000,u,5.25,", "rating"), ("d,n,2000,u,4.,", "rating"), ("d,n,2000,u,,", "rating"),
    ("d,n,1873,u,3,", "year"), ("d,n,20o0,u,3,", "year"), ("d,​ ,2000,u,3,", "name"), ('d,"",2000,u,3,', "name"), ('d,n,x,u,9,"', "quoting"),
])
def test_reasons(spark, line, reason):
    assert parse_line(line, RATINGS_EXPORT)[0] == reason
    df = spark.createDataFrame([(1, "﻿" + line, 0)], "key long, text string, line int")
    assert read_lines(df, "key", "text", RATINGS_EXPORT).first()["reason"] == reason


def test_repairs_and_long_lines(spark):
    reason, fields, cost, edits = parse_line('d,n, m,2000,u,3,ok', RATINGS_EXPORT)
    assert (reason, fields, cost) == ("columns", ["d", "n, m", "2000", "u", "3", "ok"], 1) and edits == ["delete delimiter at 1"]
    long = 'd,n,2000,u,3,"' + 'x""' * 50_000 + '"'
    df = spark.createDataFrame([(1, long), (2, "d,n,2000,u,3," + "y" * 200_000), (None, None)], "id long, line string")
    assert {r["id"]: r["reason"] for r in read_lines(df, "id", "line", RATINGS_EXPORT).collect()} == {1: None, 2: None, None: "columns"}
    assert read_lines(df.limit(0), "id", "line", RATINGS_EXPORT).count() == 0


def test_linkage(spark):
    cat = spark.createDataFrame([(1, "Trem Azul", 1999, 5.0, 10), (2, "Trem Azul", 1980, 9.0, 10), (3, "Outro Mar", 2000, 1.0, 1)], "id long, title string, year int, popularity double, votes long")
    rows = spark.createDataFrame([(10, "Trem Azul", 1999, 4.0, ""), (11, "Outro Mra", 2001, 3.0, ""), (12, "Nada", 1999, 3.0, ""), (13, "Trem Azul", None, 2.0, ""), (14, "Outro Marr", None, 2.0, "")], "row long, name string, year int, rating double, review string")
    sim = lambda a, b: 100 * edit_similarity(a, b)
    got = {r["row"]: (r["id"], r["resolver"]) for r in lk.import_ratings(rows, cat, cutoff=70.0, similarity=sim).collect()}
    assert got == {10: (1, "search"), 11: (3, "fuzzy"), 12: (None, None), 13: (2, "search"), 14: (3, "fuzzy")}
    rate = lk.match_rate(lk.import_ratings(rows, cat, "search")).first()
    assert (rate["total"], rate["matched"], rate["rate"]) == (5, 2, 0.4) and lk.match_rate(lk.import_ratings(rows.limit(0), cat, "search")).first()["rate"] == 0
    assert {r["row"]: r["id"] for r in lk.best_title(lk.year_candidates(rows, cat), cutoff=80.0).collect()}[11] == 3


def test_near_titles_are_few_and_whole(spark):
    """Every pair that reaches the cutoff comes once, and hardly any beside them, though all share a triple of letters."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéдж海", k=7))
    texts = [f"the {word()} {word()}" for _ in range(80)] + ["", "a", "ab", "海", "海の", "x" * 300]
    texts += [t[:k] + rng.choice(["", "é", "zz"]) + t[k + 1 :] for t in texts if t for k in [rng.randrange(len(t))]]
    texts = sorted(set(texts))
    rows = [(k, t, rng.choice([1999, 2000, 2003, None])) for k, t in enumerate(texts)] + [(900, None, 2000)]
    films = [(k, t, rng.choice([1999, 2001, 2002, None])) for k, t in enumerate(texts)] + [(901, None, 2000)]
    left, right = spark.createDataFrame(rows, "row long, name string, year int"), spark.createDataFrame(films, "id long, title string, year int")
    got = [(r["row"], r["id"]) for r in lk.year_candidates(left, right, alike=True).collect()]
    fits = F.col("year").isNull() | (F.abs(F.col("year") - F.col("ty")) <= 1)
    meet = left.crossJoin(right.withColumnRenamed("year", "ty")).where(fits)
    want = {(r["row"], r["id"]) for r in meet.where(100 * edit_similarity(F.col("name"), F.col("title")) >= 82).select("row", "id").collect()}
    assert len(got) == len(set(got)) and want <= set(got)
    assert len(got) < meet.count() / 4


def test_best_of_names_for_every_row(spark):
    rows = spark.createDataFrame([(1, "mar azul", 2000), (2, "mar azul", 2000), (3, "mar azul", None), (4, "mar azul", None), (5, None, 2000)], "row long, name string, year int")
    films = spark.createDataFrame([(9, "mar azuk", 2001), (7, "mar azul", 1999), (8, "mar azul", 1999), (6, "mar azul", 1950)], "id long, title string, year int")
    got = {r["row"]: (r["id"], r["score"]) for r in lk.best_of_names(rows, films, lambda a, b: 100 * edit_similarity(a, b), alike=True).collect()}
    assert got == {1: (7, 100.0), 2: (7, 100.0), 3: (6, 100.0), 4: (6, 100.0)}


def test_best_by_weight_finds_what_every_pair_gives(spark):
    """Blanks beyond ASCII part words too; no bound is below the measure, and few pairs need be measured."""
    rng = random.Random(6)
    word = lambda: rng.choice(["o", "a", "de", "the", "noite", "azul", "farol"]) if rng.random() < 0.5 else "".join(rng.choice("abdeinotx") for _ in range(rng.randint(3, 9)))
    text = lambda: rng.choice(["\u2007", "  ", "\t", *" " * 9]).join(word() for _ in range(rng.randint(1, 5)))
    films = [(k, text(), rng.choice([None, 1990, 1991, 1993])) for k in range(150)] + [(900, " ", 1990), (901, "", 1990), (902, None, 1990)]
    names = [(k, rng.choice([text(), films[k][1], films[k][1][1:]]), rng.choice([None, 1990, 1992])) for k in range(150)] + [(900, "", 1990), (901, None, 1990), (902, "el\u2007faro", 1990), (903, "\t ", 1990)]
    films.append((5, "el corazon olvidado de xepazasa", 1990))
    films = list({k: (k, t, y) for k, t, y in films}.values())
    rows, titles = spark.createDataFrame(names, "row long, name string, year int"), spark.createDataFrame(films, "id long, title string, year int")
    want = {}
    for row, name, year in names:
        if name and year:
            near = [(-weighted_ratio(name, t), k) for k, t, y in films if t and y and abs(y - year) <= 1]
            if near and -min(near)[0] >= 82:
                want[row] = (min(near)[1], -min(near)[0])
    assert {r["row"]: (r["id"], r["score"]) for r in lk.best_by_weight(rows, titles).collect()} == want and len(want) > 60 and 902 in want
    a, b = lk._Shapes([n for _, n, _ in names if n]), lk._Shapes([t for _, t, _ in films if t])
    most = np.array([a.most(k, b, 0, len(b.size)) for k in range(len(a.size))])
    assert (most >= np.array([[weighted_ratio(n, t) for _, t, _ in films if t] for _, n, _ in names if n])).all()


def test_wratio_match_takes_any_blank_between_words(spark, tmp_path):
    both = [("movies", "SELECT 7L AS tmdb_id, 'El Corazón Olvidado de Xepazasa II' AS title, 2017 AS release_year, 1L AS vote_count, 1D AS popularity, '' AS overview, 'es' AS original_language, 5D AS vote_average, 90 AS runtime_minutes, '' AS origin_countries, '' AS release_date"), ("ratings", "SELECT 1L AS row_id, 'El\u2007Faro' AS name, 2017 AS year, 4D AS rating, '' AS review")]
    for name, sql in both:
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [tuple(r) for r in recommend.wratio_match(spark, str(tmp_path)).collect()] == [(1, 7, 85.5)]


def test_top_products_and_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "item long, qi array<double>")
    near = cf.neighbours(df, 4).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for i in range(60):
        assert [r["dst"] for r in sorted((r for r in near if r["src"] == i), key=lambda r: r["rank"])] == np.argsort(-s[i])[:4].tolist()
    gone = spark.createDataFrame([(0, int(k)) for k in np.argsort(-(v @ v[0]))[:10]], "l long, r long")
    blocks = top_products(df.where("item = 0").selectExpr("item AS l", "qi AS v"), df.selectExpr("item AS r", "qi AS v", "0D AS bias"), 5, gone, block=7).orderBy("rank").collect()
    assert [r["r"] for r in blocks] == np.argsort(-(v @ v[0]))[10:15].tolist()


def test_fold_in_and_cascade(spark):
    rng = np.random.default_rng(4)
    q, b = rng.normal(size=(12, 3)), rng.normal(size=12)
    items = spark.createDataFrame([(i, q[i].tolist(), float(b[i])) for i in range(12)], "item long, qi array<double>, bi double")
    known = [(1, i, float(r)) for i, r in ((0, 4), (3, 2), (5, 5))] + [(2, 7, 5.0), (3, 99, 4.0)]
    df = spark.createDataFrame(known, "user long, item long, rating double").repartition(5)
    p = {r["user"]: np.array(r["p"]) for r in cf.fold_in(df, items, 3.5).collect()}
    m = q[[0, 3, 5]]
    want = np.linalg.solve(m.T @ m + 0.1 * np.eye(3), m.T @ (np.array([4, 2, 5]) - 3.5 - b[[0, 3, 5]]))
    assert p[1] == pytest.approx(want)
    assert {r["user"]: r["method"] for r in cf.strategies(df, df, items).collect()} == {1: "fold_in", 2: "item_item", 3: "popularity"}
    near = cf.neighbours(items, 3)
    cat = spark.createDataFrame([(i, float(i)) for i in range(12)], "item long, popularity double")
    got = cf.recommend(df, df, items, near, cat, 3.5, 4).collect()
    mine = [r["item"] for r in sorted((r for r in got if r["user"] == 1), key=lambda r: r["rank"])]
    score = 3.5 + 0.5 * b + q @ want
    assert mine == [i for i in np.argsort(-score) if i not in (0, 3, 5)][:4]
    assert [r["item"] for r in sorted((r for r in got if r["user"] == 3), key=lambda r: r["rank"])] == [11, 10, 9, 8]
    assert 7 not in {r["item"] for r in got if r["user"] == 2}


def test_neighbours_of_sought_items_are_enough(spark, monkeypatch):
    """Recommendations are those that neighbours of all items give, and the trained query looks up no others."""
    rng = np.random.default_rng(8)
    items = spark.createDataFrame([(i, rng.normal(size=3).tolist(), float(rng.normal())) for i in range(30)], "item long, qi array<double>, bi double")
    known = spark.createDataFrame([(1, 0, 4.0), (1, 3, 2.0), (2, 7, 5.0), (3, 99, 4.0), (4, 9, 1.0), (5, 7, 4.0), (5, 99, 5.0)], "user long, item long, rating double")
    cat = spark.createDataFrame([(i, float(i)) for i in range(30)], "item long, popularity double")
    sought = cf.sought(known, items, 3.5)
    assert [r["item"] for r in sought.collect()] == [7]
    rows = lambda near: sorted((r["user"], r["item"], round(r["score"], 9), r["method"], r["rank"]) for r in cf.recommend(known, known, items, near, cat, 3.5, 4).collect())
    assert rows(cf.neighbours(items, 5)) == rows(cf.neighbours(items, 5, sought))
    asked, near = [], cf.neighbours
    monkeypatch.setattr(cf, "neighbours", lambda items, k=50, queries=None: asked.append((items.count(), queries if queries is None else queries.count())) or near(items, k, queries))
    assert recommend.trained_recommendations(spark, "/root/testdata/sf0.001").count() > 0
    assert asked[0][1] is not None and asked[0][1] < asked[0][0] / 2


def test_factors_of_past_rounds_do_not_stay(spark, monkeypatch):
    from pyspark.ml.recommendation import ALS

    told, fit = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, df: told.append((self.getCheckpointInterval(), spark.sparkContext.getCheckpointDir())) or fit(self, df))
    cf.train(spark.createDataFrame([(a, b, 1.0 + (a + b) % 5) for a in range(8) for b in range(6)], "user long, item long, rating double"), factors=2, iterations=2)
    assert told[0][0] == 1 and told[0][1]


def test_factor_model_learns(spark, tmp_path):
    rng = np.random.default_rng(5)
    u, i = rng.normal(size=(60, 2)), rng.normal(size=(40, 2))
    rows = [(a, b, float(np.clip(3 + u[a] @ i[b], 0.5, 5))) for a in range(60) for b in range(40) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "user long, item long, rating double")
    e = cf.evaluate(df, factors=4, iterations=8, regularisation=0.02).first()
    base = np.std([r[2] for r in rows])
    assert e["n"] > 50 and e["rmse"] < 0.6 * base
    mu, items, _ = cf.train(df, factors=4, iterations=3)
    cf.save(str(tmp_path / "f"), mu, items, cf.neighbours(items, 2))
    assert cf.load(spark, str(tmp_path / "f"))[1].count() == 40


def test_profile(spark):
    r = spark.createDataFrame([(1, 10, 5.0), (1, 11, 3.5), (1, 12, 2.0), (2, 12, 1.0)], "user long, item long, rating double")
    likes = pr.liked(r)
    assert sorted((x["item"], x["weight"]) for x in likes.collect()) == [(10, 2.0), (11, 0.5)]
    v = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1.0, 1.0]), (13, [1.0, 0.1])], "item long, vector array<double>")
    t = pr.taste(likes, v)
    assert t.first()["taste"] == pytest.approx([2 / 17**0.5 * 2, 2 / 17**0.5 * 0.5])
    assert [x["item"] for x in pr.content_recommendations(t, v, r, 3).collect()] == [13]
    said = pr.with_reviews(t, spark.createDataFrame([(1, 1.0, [0.0, 2.0])], "user long, weight double, vector array<double>")).first()["taste"]
    assert said[1] > t.first()["taste"][1] and sum(x * x for x in said) == pytest.approx(1)
    genres = spark.createDataFrame([(10, "B"), (10, "A"), (11, "A"), (13, "A"), (13, "B")], "item long, value string")
    top = pr.top_facets(pr.facet_weights(likes, {"genres": genres}))
    assert [(x["value"], x["weight"]) for x in top.orderBy("rank").collect()] == [("A", 2.5), ("B", 2.0)]
    why = pr.reasons(spark.createDataFrame([(1, 13)], "user long, item long"), top, {"genres": genres}).first()
    assert why["genres"] == ["A", "B"]
    fused = pr.fuse(spark.createDataFrame([(1, 13, 0), (1, 12, 1)], "user long, item long, rank int"), spark.createDataFrame([(1, 14, 0)], "user long, item long, rank int"), r, 5)
    assert [x["item"] for x in fused.orderBy("rank").collect()] == [13, 14]


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, "trem", 1999), (2, "mar", 2000), (3, "zzz", 2000)], "case long, hint string, year int")
    cat = spark.createDataFrame([(10, "O Trem Azul", 1999), (11, "Trem", 1999), (12, "Mar", 2000)], "id long, title string, year int")
    targets = ev.resolve_targets(cases, cat)
    assert {r["case"]: r["id"] for r in targets.collect()} == {1: 11, 2: 12}
    scores = spark.createDataFrame([(1, 10, 2.0), (1, 11, 2.0), (2, 12, 1.0)], "case long, id long, score double")
    found = ev.positions(scores, targets)
    assert {r["case"]: r["position"] for r in found.collect()} == {1: 2, 2: 1}
    m = ev.ranking_metrics(cases, found).first()
    assert (m["n"], m["resolved"], m["mrr"], m["hits_1"], m["hits_3"], m["median"], m["mean"]) == (3, 2, 0.5, 1, 2, 1, 1.5)
    assert ev.ranking_metrics(cases, found.limit(0)).first()["mrr"] == 0


def test_lexical_positions_without_scores(spark, monkeypatch):
    """The same as by counting in all scores, which the operator never makes; equal titles and equal scores included."""
    rng = random.Random(12)
    words = ["de", "la", "trem", "mar", "azul", "noite", "casa", "rio"]
    texts = [" ".join(rng.choices(words, [9, 6, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 5))) for _ in range(150)]
    cat = spark.createDataFrame([(rng.randint(0, 1 << 40), t) for t in texts], "id long, title string")
    cat = spark.createDataFrame(cat.collect(), cat.schema)
    index = Bm25Index.build(cat, "id", "title")
    ids = sorted(r["id"] for r in cat.collect())
    cases = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:60])], "case long, title string")
    targets = spark.createDataFrame([(k, rng.choice(ids)) for k in range(60)], "case long, id long")
    scores = index.batch(cases, "case", "title").select(F.col("query").alias("case"), "id", F.round("score", 6).alias("score"))
    want = {tuple(r) for r in ev.positions(scores, targets).select("case", "id", "position").collect()}
    monkeypatch.setattr(Bm25Index, "batch", None)
    for block in (1000, 40):
        monkeypatch.setattr(ev, "BLOCK", block)
        assert {tuple(r) for r in ev.lexical_positions(index, cases, "case", "title", targets).collect()} == want
    assert len(want) > 20


def test_search_modes(spark):
    cat = spark.createDataFrame(
        [(1, "Trem Azul", "um trem azul cruza o mar", 1999, "pt", 100, 7.0, 5.0), (2, "Mar", "o mar e a casa", 2005, "pt", 5, 6.0, 2.0), (3, "Casa Velha", None, None, "en", None, None, None), (4, "Outro", "o trem do mar azul", 1990, "es", 50, 8.0, 9.0)],
        "id long, title string, overview string, year int, language string, votes long, vote_average double, popularity double",
    )
    people = spark.createDataFrame([(1, "Ana"), (2, "Bia")], "person long, name string")
    credits = spark.createDataFrame([(1, 1, "director", 1), (1, 4, "director", 1), (2, 4, "actor", 1)], "person long, id long, role string, credit_order int")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    e = SearchEngine(cat, Bm25Index.build(cat, "id", "overview"), vectors=v, people=people, credits=credits, encode=lambda t: [1.0, 0.0], rescore=lambda q, p: 1.0 / F.length(p))
    ids = lambda df: [r["id"] for r in df.orderBy("position").collect()]
    assert ids(e.search("filme do trem azul", "synopsis", 3))[0] == 1
    assert ids(e.search("trem azul", "auto", 2))[0] == 1 and ids(e.search("trem azu", "name", 1)) == [1]
    assert ids(e.search("trem azul", "auto", 4, {"year_max": 1995})) == [4]
    assert ids(e.search("Ana", "person", 5)) == [4, 1] and ids(e.search("", "auto")) == []
    assert ids(e.combined(director="Ana")) == [4, 1] and ids(e.combined("trem azul", director="Ana", actor="Bia")) == [4] and ids(e.combined(director="Nobody")) == []
    x = e.search("trem azul", "auto", 1).first()["explanation"]
    assert x["position"] == 1 and x["matched_title_terms"] == ["trem", "azul"] and 0 <= x["confidence"] <= 100
    with pytest.raises(ValueError):
        e.search("x", "other")


def test_stream_windows(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01 10:00:00', 'view', 1D), (TIMESTAMP '2024-01-01 11:00:00', 'view', 2D), (TIMESTAMP '2024-02-01 00:00:00', 'click', 4D), (CAST(NULL AS TIMESTAMP), 'view', 9D) AS t(ts, kind, value)")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    s = sp.event_stream(spark, str(tmp_path / "events"))
    every = sp.run_once(sp.popularity(s, "ts", "kind", "value", late=None), "t", "complete").collect()
    assert sorted((r["kind"], r["n"], r["total"]) for r in every) == [("click", 1, 4.0), ("view", 2, 3.0)]
    closed = sp.run_once(sp.popularity(s, "ts", "kind", "value"), "u").collect()
    assert [(r["kind"], r["n"]) for r in closed] == [("view", 2)]


def test_many_surplus_delimiters_are_split_over_two_fields():
    """70 surplus delimiters in Name and Review: the program finds the places where year and rating fit."""
    name, review = ",".join(f"n{k}" for k in range(41)), ",".join(f"r{k}" for k in range(31))
    reason, fields, cost, edits = parse_line(f"2020,{name},1999,u,3.5,{review}", RATINGS_EXPORT)
    assert (reason, cost, len(edits)) == ("columns", 70, 70) and fields == ["2020", name, "1999", "u", "3.5", review]
    # an opening quote that is never closed: the closing one goes where the columns fit
    assert parse_line('2020,"Um, dois,1999,u,3.5,ok', RATINGS_EXPORT)[:3] == ("quoting", ["2020", "Um, dois", "1999", "u", "3.5", "ok"], 1)
    # by trying every way on short lines
    rng = random.Random(3)
    for _ in range(300):
        given = [rng.choice(["", "x", "1999", "3.5", "7", " "]) for _ in range(rng.randint(1, 9))]
        want = len(RATINGS_EXPORT.columns)
        cost, _, got = settle_delimiters(given, RATINGS_EXPORT)
        bad = lambda fs: sum(c.fails(fs[c.column]) for c in RATINGS_EXPORT.checks)
        if len(given) > want:
            ways = [[",".join(given[a:b]) for a, b in zip((0, *cuts), (*cuts, len(given)), strict=True)] for cuts in combinations(range(1, len(given)), want - 1)]
        else:
            ways = [[given[places.index(k)] if k in places else "" for k in range(want)] for places in combinations(range(want), len(given))]
        assert cost == abs(len(given) - want) and bad(got) == min(map(bad, ways)), given


def test_both_ways_of_reading_lines_agree(spark):
    lines = ["2020,A,1999,u,3.5,ok", "2020,,1999,u,3.5,ok", "2020,A,199,u,3.5,", "2020,A,,u,7,", '2020,"A, B",1999,u,3.5,""', "2020,A,1999,u,0.3,x", "2020,\u200b,1999,u,3,x", "2020,A, 1999 ,u, 3 ,x"]
    df = spark.createDataFrame(list(enumerate(lines)), "k long, line string")
    got = {r["key"]: (r["reason"], r["fields"]) for r in read_lines(df.withColumnRenamed("k", "key"), "key", "line", RATINGS_EXPORT).collect()}
    assert got == {k: (parse_line(x, RATINGS_EXPORT)[0], parse_line(x, RATINGS_EXPORT)[1]) for k, x in enumerate(lines)}


def test_ids_are_numbered_without_gaps(spark):
    keys = spark.createDataFrame([(1 << 40,), (-5,), (7,), (1_000_003,)], "item long").repartition(3)
    assert [r["i"] for r in cf.numbered(keys, "item", "i").orderBy("item").collect()] == [0, 1, 2, 3]


def test_a_lookup_that_cannot_be_read_raises(spark, tmp_path):
    path = tmp_path / "lookup"
    path.mkdir()
    (path / "part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):  # noqa: B017
        so.remember(spark, str(path), spark.createDataFrame([(1, "a")], "k int, v string"), "k").collect()
    assert (path / "part-0.parquet").read_bytes() == b"not a table"


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session)
    with runtime.scope():
        df = runtime.cut(spark.range(3))
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_hot_users_are_folded_in_by_parts(spark):
    rng = np.random.default_rng(0)
    items = [(k, rng.normal(size=4).tolist(), float(rng.normal())) for k in range(80)]
    known = [(u, k, float(rng.integers(1, 6))) for u in range(6) for k in range(80) if u == 0 or rng.random() < 0.2]
    frames = spark.createDataFrame(known, "user long, item long, rating double"), spark.createDataFrame(items, "item long, qi array<double>, bi double")
    got = {r["user"]: np.array(r["p"]) for r in cf.fold_in(*frames, 3.5, part=15).collect()}
    q, b = np.array([x[1] for x in items]), np.array([x[2] for x in items])
    for u in range(6):
        mine = [(k, r) for v, k, r in known if v == u]
        x = q[[k for k, _ in mine]]
        want = np.linalg.solve(x.T @ x + cf.RIDGE * np.eye(4), x.T @ np.array([r - 3.5 - b[k] for k, r in mine]))
        assert np.allclose(got[u], want)
    assert cf.fold_in(frames[0].limit(0), frames[1], 3.5).count() == 0


def test_pairs_of_hot_keys(spark):
    a = spark.createDataFrame([(k % 4, k) for k in range(40)] + [(None, 1)], "key int, a int")
    b = spark.createDataFrame([(0 if k % 3 else k % 5, k) for k in range(60)] + [(None, 2)], "key int, b int")
    rows = lambda df: sorted(tuple(r) for r in df.select("key", "a", "b").collect())
    assert rows(runtime.salted_pairs(a, b, "key", "b", 3)) == rows(a.join(b, "key")) == rows(runtime.salted_pairs(a, b, "key", "b"))


def test_fewest_edits_of_both_kinds():
    """Against every way to touch up to two quotes, counting the delimiters that are still to go or to come."""
    legal = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')
    field = re.compile(r',("(?:[^"]|"")*"|[^",]*)')

    def touched(line, times):
        yield line
        if times:
            for k in range(len(line) + 1):
                yield from touched(line[:k] + '"' + line[k:], times - 1)
                if line[k : k + 1] == '"':
                    yield from touched(line[:k] + line[k + 1 :], times - 1)

    rng = random.Random(11)
    for _ in range(250):
        line = "".join(rng.choices('a,"', weights=(3, 4, 2), k=rng.randint(0, 8)))
        ways = {}
        for quotes in range(3):
            for x in set(touched(line, quotes)):
                if legal.fullmatch(x):
                    total = quotes + abs(len(field.findall("," + x)) - 3)
                    ways[quotes] = min(total, ways.get(quotes, 99))
        parts = marks(line, ",")
        assert (settle_quotes(parts, ",")[0] == 0) == bool(legal.fullmatch(line)), line
        cost, edits, fields = settle_quotes(parts, ",", 3)
        assert cost + abs(len(fields) - 3) <= min(ways.values(), default=99), line
        if cost <= 2:
            assert cost + abs(len(fields) - 3) == min(ways.values()), line
