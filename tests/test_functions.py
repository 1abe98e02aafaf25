"""Text, vectors, similarity and fusion on hand-made frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tamarack.functions import similarity as si
from tamarack.functions import text as tx
from tamarack.functions import vectors as vx
from tamarack.operators import fusion as fu
from tamarack.operators import search as se


def one(spark, column, **values):
    names, row = zip(*values.items(), strict=True) if values else (("x",), (0,))
    return spark.createDataFrame([row], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in values.items()) or "x int").select(column).first()[0]


def test_fold_and_tokens(spark):
    assert one(spark, tx.tokens(F.col("t")), t="A Ação_é já! o x1 éta") == ["acao_e", "ja", "x1", "eta"]
    assert one(spark, tx.tokens(F.col("t")), t=None) == []
    assert one(spark, tx.content_tokens(F.col("t")), t="  O filme da Ação  secreta ") == ["acao", "secreta"]


@pytest.mark.parametrize(("text", "key"), [("O  Psicopata", "psicopata"), ("o", ""), ("Os", ""), ("Oeste", "oeste"), (None, ""), ("a a b", "a b")])
def test_name_key(spark, text, key):
    assert one(spark, tx.name_key(F.col("t")), t=text) == key


@pytest.mark.parametrize(("query", "want"), [("Filme da mulher", "mulher"), ("aquele filme que", "que"), ("o", "o"), ("", ""), ("¿Qual o filme? trem.", "trem"), (" trem ", "trem")])
def test_clean_query(spark, query, want):
    assert tx.clean_query(query) == want
    assert one(spark, tx.clean_query_column(F.col("t")), t=query) == want


def test_small_functions(spark):
    assert one(spark, tx.countries(F.col("t")), t="BR||US|") == ["BR", "US"] and one(spark, tx.countries(F.col("t")), t=None) == []
    assert one(spark, tx.year_of(F.col("t")), t="1999-01-02") == 1999 and one(spark, tx.year_of(F.col("t")), t="x") is None
    assert one(spark, tx.placeholder_url(F.col("t")), t="A/B c é") == "https://placehold.co/300x450?text=A/B%20c%20%C3%A9"
    assert one(spark, tx.passage(F.lit("  "), F.lit("T"), F.array(F.lit("a"), F.lit("b")))) == "T a b"
    assert one(spark, tx.with_prefix(F.lit("x"), "multilingual-e5-large", "query")) == "query: x" and tx.with_prefix(None, "other", "query") is None


def test_attribute_phrases(spark):
    def phrases(y, v, c, t):
        return spark.createDataFrame([(y, v, c, t)], "y int, v double, c long, t int").select(tx.attribute_phrases(F.col("y"), F.col("v"), F.col("c"), F.col("t"))).first()[0]

    assert phrases(None, None, None, None) == [] and phrases(0, 0.0, 500, 0) == []
    assert phrases(1929, 8.0, 300, 44)[-2:] == ["filme aclamado muito bom premiado obra-prima", "curta-metragem curta"] and "filme mudo" in phrases(1929, None, None, None)
    assert phrases(1935, 7.0, 1, 150) == ["década de 1930", "filme dos anos 1930", "de 1935", "preto e branco", "filme antigo clássico", "filme bem avaliado bom", "filme longo épico"]
    assert phrases(2018, 4.5, 80, 100)[3:] == ["filme recente atual", "filme ruim mal avaliado fraco"]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vx.dot(a, a)) == 25 and one(spark, vx.unit(a)) == [0.6, 0.8] and one(spark, vx.unit(b)) == [0.0, 0.0]
    assert one(spark, vx.mix(vx.unit(a), F.lit(None).cast("array<double>"), 0.25)) == pytest.approx([0.6, 0.8])


def test_ratios():
    assert si.ratio("abcd", "abxd") == 75 and si.ratio("", "") == 100
    assert si.common_subsequence("kitten", "sitting") == 4
    assert si.partial_ratio("matrix", "the matrix reloaded") == 100
    assert si.token_sort_ratio("b a", "a b") == 100 and si.token_set_ratio("a b", "a b c") == 100
    assert si.weighted_ratio("", "x") == 0 and si.weighted_ratio("matrix", "matrix") == 100
    assert si.weighted_ratio("matrix", "the matrix reloaded") == pytest.approx(90)


def test_name_score(spark):
    df = spark.createDataFrame([("bakazela 7",), ("bakazela 7 redux",), ("bak",), ("",)], "t string").withColumn("k", tx.name_key(F.col("t")))
    s = [r[0] for r in df.select(si.name_score("bakazela 7", F.col("k"), F.col("t"), F.lit(0.5), ["bakazela"])).collect()]
    assert s[0] == 1.0 and s[1] == 0.65 and s[2] == pytest.approx(0.5 * (0.4 + 0.6 * 0.3) * 0.2) and s[3] == pytest.approx(0.5 * 0.4 * 0.2)
    assert df.select(si.name_score("", F.col("k"), F.col("t"), F.lit(0.5), [])).first()[0] < 0.6  # an empty key is no beginning


def test_z_and_min_max(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None)], "id int, x double")
    got = {r["id"]: r for r in fu.with_min_max(fu.with_z(df, z="x"), m="x").collect()}
    assert (got[1]["z"], got[2]["z"], got[3]["z"]) == (-1.0, 1.0, None) and (got[1]["m"], got[2]["m"]) == (0.0, 1.0)
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, x double")
    assert [r["z"] for r in fu.with_z(same, z="x").collect()] == [0.0, 0.0] and [r["m"] for r in fu.with_min_max(same, 0.0, m="x").collect()] == [0.0, 0.0]
    assert fu.with_z(df.limit(0), z="x").count() == 0


def test_weights_and_intent():
    assert [fu.lexical_weight(n) for n in (3, 4, 7)] == [0.30, 0.25, 0.20] and [fu.name_weight(n) for n in (3, 5, 6)] == [0.6, 0.3, 0.05]
    assert fu.intent(0.92, 0.3) == (0.9, "name") and fu.intent(0.85, 0.3) == (0.6, "name") and fu.intent(0.5, 0.3) == (0.3, "description")


def test_reciprocal_ranks_and_positions(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id int, rank int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "id int, rank int")
    got = {r["id"]: r["score"] for r in fu.reciprocal_ranks([(a, 1.0), (b, 0.5)], "id").collect()}
    assert got == pytest.approx({1: 1 / 20, 2: 1 / 21 + 0.5 / 20, 3: 0.5 / 21})
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("s")).repartition(9)
    ranked = fu.with_position(df, F.desc("s"), F.asc("id")).orderBy("position").collect()
    assert [r["position"] for r in ranked] == list(range(1, 1001)) and [r["id"] for r in ranked] == sorted(range(1000), key=lambda i: (-(i % 7), i))


def test_rerank_keeps_tail_and_ids(spark):
    df = spark.createDataFrame([(i, float(10 - i)) for i in range(8)], "id long, score double")
    r = fu.rerank_head(df, "id", "score", F.col("id").cast("double"), pool=4, blend=0.0)
    order = [x["id"] for x in r.orderBy("is_tail", F.desc("final"), F.desc("score"), "id").collect()]
    assert order == [3, 2, 1, 0, 4, 5, 6, 7]


def test_relevance_confidence_shares(spark):
    c = lambda x: one(spark, x)
    assert c(se.relevance(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 100 and c(se.relevance(F.lit(0.5), F.lit(0.0), F.lit(1.0))) == 50
    assert c(se.confidence(F.lit(1.4), F.lit(None).cast("double"), F.lit(0.0))) == 50 and c(se.confidence(F.lit(-9.0), F.lit(1.3), F.lit(0.3))) == 100
    got = c(se.contributions(F.lit(1.0), F.lit(3.0), F.lit(0.0), F.lit(0.5), F.lit(0.8), F.lit(0.5), F.lit(0.4)))
    assert [(x["signal"], x["share"]) for x in got][:3] == [("synopsis", 0.5), ("name", 0.333), ("lexical", 0.167)]
    assert math.isclose(sum(x["share"] for x in got), 1, abs_tol=0.002)
    assert c(se.matched_title_terms("o trem azul do mar", F.lit("Trem Azul, trem de Mar"))) == ["trem", "azul", "mar"]


def test_partial_ratio_against_every_window():
    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc d", k=rng.randint(1, 9))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        windows = [long[max(0, s) : s + len(short)] for s in range(1 - len(short), len(long))]
        assert si.partial_ratio(a, b) == pytest.approx(max(si.ratio(short, w) for w in windows)), (a, b)


@pytest.mark.parametrize(
    ("a", "b", "name", "value"),
    [
        # values of the public definition, worked out by hand
        ("this is a test", "this is a test!", "ratio", 100 * 28 / 29), ("this is a word", "THIS IS A WORD", "ratio", 100 * 6 / 28), ("this is a test", "this is a test!", "partial_ratio", 100.0),
        ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", "token_sort_ratio", 100.0), ("fuzzy was a bear but not a dog", "fuzzy was a bear", "token_set_ratio", 100.0),
        ("abcd", "abce", "weighted_ratio", 75.0), ("a b", "b a", "weighted_ratio", 95.0), ("trem", "o trem azul do norte", "weighted_ratio", 90.0), ("", "x", "weighted_ratio", 0.0), ("ab", "ab" + "x" * 30, "weighted_ratio", 60.0),
    ],
)
def test_ratios(a, b, name, value):
    assert getattr(si, name)(a, b) == pytest.approx(value)


def test_weighted_ratio_from_a_least_value_on():
    from tamarack.functions.similarity import weighted_ratio

    texts = ["o farol", "farol", "o farol azul de vasodira", "the night", "night of the farol zul", "vasodria", "a b", "xarol zul", "b"]
    for a in texts:
        for b in texts:
            s = weighted_ratio(a, b)
            assert weighted_ratio(a, b, s) == s and weighted_ratio(a, b, s / 2) == s and weighted_ratio(a, b, s + 1) < s + 1
