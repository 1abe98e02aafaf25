"""Skeletons, encodings, tokens, containers, reading levels, entity matching."""

import json
import math
import os
import random
import unicodedata
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tamarack.llm import bpe, match, mojibake, packing, reading, retrieval
from tamarack.llm.queries import TOKENIZERS
from tamarack.llm.skeleton import confusables, look_alikes, skeleton, skeletons

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize(("a", "b"), [("Café", "Café"), ("Ｎｏｚａ", "Noza"), ("a b", "a　b"), ("Xiza​re", "Xizare"), ("Тhе", "The"), ("ﬁm", "fim"), ("Parte Ⅱ", "Parte II"), ("ｶﾞ", "ガ"), ("o͏́", "ó")])
def test_same_look(a, b):
    assert skeleton(a) == skeleton(b)


@pytest.mark.parametrize(("a", "b"), [("Cafe", "Café"), ("x²", "x2"), ("½", "1/2"), ("A", "a"), ("カ", "ガ"), ("a-b", "a b")])
def test_other_look(a, b):
    assert skeleton(a) != skeleton(b)


# by script, what looks like which Latin letters
SCRIPTS = [
    ("АВЕЅІЈКМНОРСТУХѴԜԌ", "ABESIJKMHOPCTYXVWG"), ("аеорсухѕіјһԁԛԝѵүѡ", "aeopcyxsijhdqwvyw"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"), ("ανορυικϲϱ", "avopuikcp"), ("ՕՍՏօոսհցզ", "OUSonuhgq"),
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"), ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"), ("ⲎⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "HKMNOPCTYX"), ("ᴄᴏᴠᴡᴢɪɑɡıʏ", "covwziagiy"), ("ꮯꮩꮃꮓꮪ", "cvwzs"), ("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm"), ("℮ℓℕℚ", "elNQ"),
]


def test_look_alikes_of_every_script(spark):
    """Pairs by script, and the styled and wide alphabets, whose plain form Unicode's compatibility mapping tells."""
    pairs = [(a, b) for other, latin in SCRIPTS for a, b in zip(other, latin, strict=True)]
    pairs += [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0x1D400, 0x1D6A4)) if unicodedata.name(chr(c), "")]
    pairs = [(a, b) for a, b in pairs if b.isascii()]
    assert len(pairs) > 800
    got = {r["text"]: r["form"] for r in skeletons(spark.createDataFrame([(f"x{a}y",) for a, _ in pairs], "t string"), "t").collect()}
    wrong = [(a, b, got[f"x{a}y"]) for a, b in pairs if got[f"x{a}y"] != f"x{b}y"]
    assert not wrong
    apart = [("x²", "x2"), ("½", "1/2"), ("ー", "一"), ("が", "か"), ("é", "e"), ("A", "a"), ("Ж", "X"), ("l", "I"), ("0", "O"), ("1", "l"), ("rn", "m"), ("-", "–"), ("ф", "o"), ("ß", "B")]
    forms = {r["text"]: r["form"] for r in skeletons(spark.createDataFrame([(x,) for p in apart for x in p], "t string"), "t").collect()}
    assert all(forms[a] != forms[b] for a, b in apart), [p for p in apart if forms[p[0]] == forms[p[1]]]


def test_no_confusables_data_is_an_error():
    class Gone:
        def __getattr__(self, name):
            raise TypeError("'JavaPackage' object is not callable")

    with pytest.raises(RuntimeError, match="ICU"):
        confusables(Gone())


def test_look_alikes(spark):
    left = spark.createDataFrame([(1, "Тhе Sea", 0), (1, "Тhе Sea", 0), (2, "The Sea", 0), (3, None, 0), (None, "x", 0), (4, "", 0)], "id long, t string, form int")
    right = spark.createDataFrame([(10, "The Sea"), (11, "Тhе Sea"), (12, "the sea"), (13, ""), (14, None)], "k long, n string")
    got = sorted(tuple(r) for r in look_alikes(left, "id", "t", right, "k", "n").collect())
    assert got == [(1, 10), (2, 11)]
    assert look_alikes(left.limit(0), "id", "t", right, "k", "n").count() == 0
    assert skeleton("é" * 100_000) == "é" * 100_000 and skeleton(None) is None


CLEAN = ["A irmã traz o pão e a maçã no verão.", "Según la abuela, el niño salió mañana.", "L'été, la mère a été très sûre.", "O coração não vê a lição.", "Город помнит зимний вечер.", "the quiet house by the sea"] * 40


def test_garbled(spark):
    wrong = [
        (1, "A irmÃ£ traz o pÃ£o", "A irmã traz o pão"), (2, "coraÃƒÂ§ÃƒÂ£o", "coração"), (3, "Ãîðîä ïîìíèò çèìíèé âå÷åð", "Город помнит зимний вечер"),
        (4, "a lição n├úo", "a lição não"), (5, "A irmã e a maÃ§Ã£", "A irmã e a maçã"), (6, "o p�o", "o p�o"),
    ]
    rows = [(100 + k, t) for k, t in enumerate(CLEAN)] + [(k, t) for k, t, _ in wrong] + [(7, None), (8, ""), (9, "IRMÃ: £40"), (1, "A irmÃ£ traz o pÃ£o")]
    df = spark.createDataFrame(rows, "id long, text string").withColumnRenamed("text", "key")
    got = {r["id"]: r for r in mojibake.garbled(df, "id", ["key"]).collect()}
    assert set(got) == {k for k, _, _ in wrong}
    assert all(got[k]["restored"] == t for k, _, t in wrong) and got[6]["lossy"]
    assert mojibake.garbled(df.limit(0), "id", ["key"]).count() == 0


def test_margin_of_every_held_out_record(spark):
    """Beyond four thousand records as well, the one in a thousand that gains most counts."""

    class Stub:
        def best(self, text):
            return (float(text[1:]) - 9_990 if float(text[1:]) > 9_990 else 0.0), text, ()

    held = spark.createDataFrame([(f"é{k}",) for k in range(10_000)], "text string")
    margin = mojibake.validated_margin(SimpleNamespace(value=Stub()), held)
    assert margin == sorted(max(0.0, k - 9_990.0) for k in range(10_000))[int(0.999 * 9_999)] == 0.0
    held = held.unionByName(spark.createDataFrame([(f"é{k}",) for k in range(10_000, 10_010)], "text string"))
    assert mojibake.validated_margin(SimpleNamespace(value=Stub()), held) == sorted(max(0.0, k - 9_990.0) for k in range(10_010))[int(0.999 * 10_009)] > 0


def misread(text, *chain):
    """`text` written in one encoding and read by another, step by step."""
    for right, wrong in chain:
        raw = text.encode(right)
        text = raw.decode(wrong) if wrong in mojibake.DOUBLE else "".join({b: c for c, b in mojibake.to_bytes(wrong).items()}.get(x, chr(x)) if x > 127 else chr(x) for x in raw)
    return text


JAPANESE = ["静かな海と約束の夜を彼は忘れない", "猫が赤い列車を見て静かな村に帰る", "約束の庭で猫と海の秘密を見た", "アサトのタイカイノサカ"]
CHAINS = [
    ("A irmã traz o pão e a maçã no verão.", [("utf-8", "cp1252"), ("cp1252", "mac_roman")]), ("A irmã traz o pão e a maçã no verão.", [("utf-8", "mac_roman"), ("utf-8", "latin-1")]),
    ("Según la abuela, el niño salió mañana.", [("utf-8", "iso8859-2")]), ("Según la abuela, el niño salió mañana.", [("utf-8", "cp932")]), ("L'été, la mère a été très sûre.", [("utf-8", "gbk")]),
    ("O coração não vê a lição.", [("utf-8", "big5")]), ("A irmã traz o pão e a maçã no verão.", [("utf-8", "cp1252")] * 3), ("Город помнит зимний вечер.", [("utf-8", "cp1252"), ("utf-8", "latin-1")]),
    ("Город помнит зимний вечер.", [("koi8-r", "cp1251")]), (JAPANESE[0], [("utf-8", "cp1252")]), (JAPANESE[1], [("shift_jis", "cp1252")]), (JAPANESE[3], [("euc_jp", "cp932")]), (JAPANESE[0], [("euc_jp", "latin-1")]),
]


def test_chains():
    batch = pa.RecordBatch.from_arrays([pa.array(CLEAN + JAPANESE * 40)], ["text"])
    counts = Counter()
    for b in mojibake._count(iter([batch])):
        for gram, n in zip(b.column("gram").to_pylist(), b.column("n").to_pylist(), strict=True):
            if gram >= 0:
                text = "".join(chr(gram >> k & ((1 << 21) - 1)) for k in (42, 21, 0))
                for k in range(3):
                    counts[text[k:]] += n
    model = mojibake.Model(dict(counts))
    for text, chain in CHAINS:
        broken = misread(text, *chain)
        assert broken != text
        gain, source, how = model.best(broken)
        assert (source, gain > 0) == (text, True), (text, chain, broken, source, how)
        # one broken place in a long sound text is found as any other
        if all(right == "utf-8" for right, _ in chain):
            assert model.best("O coração não vê a lição. " + broken)[1] == "O coração não vê a lição. " + text
    for text in CLEAN + JAPANESE + ["", "plain"]:
        assert model.best(text) == (0.0, text, ())


TEXTS = ["Hello world's  end", "", None, "a" * 5000, "  \n\n x", "日本語の本", "<|endoftext|> é", "xx" * 500 + " 12,3 don't"]


def test_bpe_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)), "ids long, text string")
    got = {r[0]: list(r[1]) for r in bpe.encode_corpus(df.withColumnRenamed("ids", "n_tokens"), "n_tokens", "text", PATH).collect()}
    assert got == {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(TEXTS)}
    counts = {r[0]: r[1] for r in bpe.token_counts(df, "ids", "text", PATH).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert bpe.encode_corpus(df.limit(0), "ids", "text", PATH).count() == 0


def test_other_ways_of_encoding_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        said = json.load(f)
    said["model"] |= {"vocab": {}, "merges": []}
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": said["model"] | {"ignore_merges": True}}):
        (tmp_path / "t.json").write_text(json.dumps(said | change))
        with pytest.raises(ValueError, match="byte-level"):
            bpe.Vocabulary.load(str(tmp_path / "t.json"))


def test_long_words_merge_alike():
    v = bpe.Vocabulary.load(PATH)
    word = ("internationalization" * 15).encode()
    assert v._merge_long(word).tolist() == v.merge_words([word])[0].tolist()


@pytest.mark.parametrize("seed", range(3))
def test_plan_holds_exactly_the_items(seed):
    rng = np.random.default_rng(seed)
    capacity = 200
    histogram = np.bincount(np.minimum(rng.lognormal(3.4, 0.8, 4000).astype(int) + 1, capacity), minlength=capacity + 1)
    plan = packing.plan_containers(histogram, capacity)
    used = np.zeros(capacity + 1, int)
    for count, pattern in plan:
        assert count > 0 and sum(s * m for s, m in pattern) <= capacity
        for s, m in pattern:
            used[s] += count * m
    assert (used[1:] == histogram[1:]).all()
    tokens = (histogram * np.arange(capacity + 1)).sum()
    assert sum(c for c, _ in plan) <= 1.01 * -(-tokens // capacity) + 1


def test_containers(spark):
    rows = [(1, 5), (2, 0), (3, None), (4, 23), (5, 10), (6, 10), (7, 3), (7, 3), (None, 4), (8, -2)]
    df = spark.createDataFrame(rows, "rank long, n long").withColumnRenamed("n", "size")
    got = packing.fill_containers(df, "rank", "size", 10).collect()
    fill = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
    assert max(fill.values()) <= 10 and sum(fill.values()) == 58
    assert sorted((r["piece"], r["n_tokens"]) for r in got if r["rank"] == 4) == [(0, 10), (1, 10), (2, 3)]
    assert len(got) == len(rows) + 2
    assert packing.fill_containers(df.limit(0), "rank", "size", 10).count() == 0


def test_reading_levels(spark):
    easy, hard = "The cat sees the dog. ", "Transnational hermeneutics, notwithstanding institutional exigencies, problematizes phenomenological subjectivity, insofar as representation eludes closure. "
    rows = [(k, easy * (8 + k % 5)) for k in range(30)] + [(100 + k, hard * (4 + k % 5)) for k in range(30)] + [(500, None), (501, ""), (502, "123 ..."), (503, hard * 9 + "The cat sees the dog."), (504, "Transnational Infrastructure Association: X; " + easy * 30)]
    df = spark.createDataFrame(rows, "id long, text string").withColumnRenamed("id", "key")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 30, 2)] + [(100 + k, 4) for k in range(0, 30, 2)] + [(100, 3), (None, 2), (3, None), (99999, 4)], "d long, level int")
    got = {r["key"]: r for r in reading.reading_levels(df, "key", "text", labels, "d", "level").collect()}
    assert all(got[k]["level"] == 1 for k in range(30)) and all(got[100 + k]["level"] == 4 for k in range(30))
    assert got[503]["level"] == 4 and got[504]["level"] == 1 and got[500]["level"] is None and got[502]["level"] is None
    assert got[500]["n_words"] == 0 and got[0]["n_words"] == 40
    assert all(r["level"] is None or r["level"] == 1 + sum(r[f"border_{k}"] > 0 for k in (1, 2, 3)) and r["border_1"] >= r["border_2"] >= r["border_3"] for r in got.values())
    # the rank that covers nine tenths of a document's words
    features, _ = reading.measure([" ".join("abcdefghij"), "a b. a, b"], {c: k for k, c in enumerate("abcdefghij", 1)}, 100)
    assert np.exp(features[:, 0]) == pytest.approx([9, 2])
    none = reading.reading_levels(df, "key", "text", labels.limit(0), "d", "level")
    assert none.where("level IS NOT NULL").count() == 0 and reading.reading_levels(df.limit(0), "key", "text", labels, "d", "level").count() == 0


def test_quantiles_against_sorting():
    rng = np.random.default_rng(1)
    g, v, w = np.sort(rng.integers(0, 20, 500)), rng.normal(size=500), rng.integers(1, 9, 500)
    g[:20] = np.arange(20)
    got = reading._quantile(g, v, w, 0.5, 20)
    for k in range(20):
        x = np.repeat(v[g == k], w[g == k])
        assert got[k] == np.sort(x)[int(np.ceil(0.5 * len(x))) - 1]


def test_likeness():
    like = lambda a, b, **rare: match.likeness(match.analyse(a), match.analyse(b), rare, frozenset({"dvd"}))
    assert like("Promise of Kacecimo, The", "The Promise of Kacecimo") == (1, 1)
    assert like("Xabidone II", "Xabidone") == (0, 0) and like("Xabidone 7", "Xabidone 12") == (0, 0)
    assert like("Xabidone - DVD", "Xabidone")[0] > 0.9 > like("Xabidone e Zotico", "Xabidone")[0] and like("A Noite Azul de Xabidone", "A Noite de Xabidone")[0] < 0.8
    shared = {"noite": 0.3, "azul": 0.3}
    assert like("Noite Azul de Xabidnoe", "Noite Azul de Xabidone", **shared)[1] == 1 and like("Noite Azul de Zotico", "Noite Azul de Xabidone", **shared)[1] < 0.5
    assert match.distance("abcd", "abdc", 2) == 1 and match.distance("abcd", "xyzw", 2) == 3


def test_distance_is_exact_within_its_bound():
    rng = random.Random(3)

    def edits(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                swap = [d[i - 2, j - 2] + 1] if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] else []
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), *swap)
        return d[len(a), len(b)]

    for _ in range(3000):
        a, b = ("".join(rng.choice("abcde") for _ in range(rng.randint(0, 6))) for _ in range(2))
        for most in (1, 2):
            assert min(match.distance(a, b, most), most + 1) == min(edits(a, b), most + 1), (a, b, most)


def test_scored_by_the_words_that_were_read():
    """Names are taken apart once for a name, not once for a pair."""
    columns = {"q": [1, 2], "words": ["the long way", "long way"], "year": [1990, None], "known": ["long=0.5", None], "entity": [5, 6], "several": [False, True], "form_words": ["long way", "long wax"], "stands": [True, False], "lossy": [False, False], "eyear": [1991, 1990]}
    (got,) = match._score(iter([pa.RecordBatch.from_pydict(columns)]))
    a = match.likeness((["the", "long", "way"], (), None), (["long", "way"], (), None), {"long": 0.5})
    b = match.likeness((["long", "way"], (), None), (["long", "wax"], (), None), {})
    assert got.to_pydict() == {"q": [1, 2], "entity": [5, 6], "likeness": [a[0], match.SHORTENED * b[0]], "named": [a[1], b[1]], "whole": [a[0], 0.0], "years_apart": [1, None], "several": [False, True]}


def test_matching(spark):
    films = [(k, n, y) for k, (n, y) in enumerate([("O Farol de Vasodira", 1999), ("O Farol de Vasodira", 1970), ("Zemicota", 2001), ("Zemicota II", 2003), ("Hodoname: The Bird", None), (None, 2000), ("The Night", 2010), ("", 1990)])]
    rows = [(1, "FAROL DE VASODIRA, O", 2000), (2, "O Farol de Vasodiar", 1970), (3, "Zemicota", None), (4, "Zemictoa II", 2003), (5, "Zemicota IX", 2003), (6, "Hodoname - The Bird", 1980), (7, None, 1999), (8, "Quxelora", 2001), (9, "O Farol de Vasodira", None), (10, "zemicota (2001)", 0), (11, "", None), (3, "Zemicota", None), (12, "Zemicota", 1950)]
    left = spark.createDataFrame(rows, "id long, name string, year int").withColumnRenamed("name", "title")
    right = spark.createDataFrame(films, "film long, title string, year int")
    got = {r["id"]: r for r in match.match_entities(left, "id", "title", "year", right, "film", "title", "year").collect()}
    assert {k: r["film"] for k, r in got.items()} == {1: 0, 2: 1, 3: 2, 4: 3, 6: 4, 10: 2}
    assert all(0.5 <= r["confidence"] <= 1 for r in got.values())
    assert match.match_entities(left, "id", "title", "year", right.limit(0), "film", "title", "year").count() == 0


def test_matching_among_many_of_one_name(spark):
    films = [(k, "Zemicota", 1900 + k) for k in range(90)] + [(1000 + k, f"A Noite Azul {chr(97 + k // 26)}{chr(97 + k % 26)}xoqui", 1950 + k % 60) for k in range(300)] + [(5000, "Noite Azul", 2005)]
    rows = [(k, "Zemicota", 1900 + k) for k in (0, 30, 60, 88)] + [(100, "Zemictoa", 1975), (200, "Noite Azlu", 2005)]
    left = spark.createDataFrame(rows, "id long, title string, year int")
    right = spark.createDataFrame(films, "film long, title string, year int").where("film % 2 = 0 OR film >= 1000")
    got = {r["id"]: r["film"] for r in match.match_entities(left, "id", "title", "year", right, "film", "title", "year").collect()}
    assert got.items() >= {0: 0, 30: 30, 60: 60, 88: 88, 200: 5000}.items()


def brute_bm25(queries, docs, k):
    """Every query against every document that fits, the k best with all ties."""
    full = {d: Counter(t) + Counter([retrieval.year_term(y)] if y is not None else []) for d, t, y, _ in docs}
    df = Counter(t for c in full.values() for t in c)
    mean = sum(sum(c.values()) for c in full.values()) / len(docs)
    idf = {t: math.log1p((len(docs) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    out = {}
    for q, terms, year, mark in queries:
        ask = {t: 1.0 for t in terms} | ({retrieval.year_term(year): 1.0, retrieval.year_term(year - 1): 0.5, retrieval.year_term(year + 1): 0.5} if year is not None else {})
        scores = {}
        for d, _, dy, dm in docs:
            if dm == mark and (year is None or dy is None or abs(year - dy) <= 1):
                c, n = full[d], sum(full[d].values())
                s = sum(w * idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t, w in ask.items() if t in c)
                if s > 0:
                    scores[d] = s
        least = sorted(scores.values(), reverse=True)[min(k, len(scores)) - 1] if scores else 0
        out |= {(q, d): s for d, s in scores.items() if s >= least - 1e-9}
    return out


@pytest.mark.parametrize(("k", "block"), [(1, 1000), (3, 1000), (3, 40), (6, 25)])
def test_retrieval_is_exact(spark, monkeypatch, k, block):
    rng = random.Random(k)
    zipf = lambda: min(int(rng.paretovariate(0.6)), 300)
    row = lambda key: (key, [zipf() for _ in range(rng.randint(0, 9))], rng.choice([None, 1990, 1991, 1992, 1995]), rng.choice([0, 0, 0, 1]))
    docs, queries = [row(k) for k in range(160)], [row(k) for k in range(90)]
    docs += [(1000 + r[0], *r[1:]) for r in docs[:20]]  # ties
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "SLICE", 30)
    schema = "key long, terms array<int>, year int, mark long"
    got = {(r["q"], r["d"]): r["bm25"] for r in retrieval.retrieve(spark.createDataFrame(queries, schema), spark.createDataFrame(docs, schema), k).collect()}
    assert got == pytest.approx(brute_bm25(queries, docs, k)) and len(got) > 90
    none = spark.createDataFrame([], schema)
    assert retrieval.retrieve(none, none, k).count() == 0 and retrieval.retrieve(spark.createDataFrame(queries, schema), none, k).count() == 0


@pytest.mark.parametrize("cells", [1, 1 << 19])
def test_queries_of_one_year_are_answered_together(monkeypatch, cells):
    rng = random.Random(5)
    docs = [(k, [rng.randint(0, 30) for _ in range(rng.randint(1, 9))], rng.choice([None, 1990, 1991, 1995]), 0) for k in range(120)]
    docs += [(1000 + r[0], *r[1:]) for r in docs[:10]]  # ties
    asked = [[rng.randint(0, 40) for _ in range(rng.randint(0, 9))] for _ in range(50)]
    full = [Counter(t) + Counter([retrieval.year_term(y)] if y else []) for _, t, y, _ in docs]
    idf = np.zeros(retrieval.TERMS)
    for t, n in Counter(t for c in full for t in c).items():
        idf[t] = math.log1p((len(docs) - n + 0.5) / (n + 0.5))
    monkeypatch.setattr(retrieval, "CELLS", cells)
    table = pa.table({"key": [r[0] for r in docs], "terms": pa.array([r[1] for r in docs], pa.list_(pa.int32())), "year": pa.array([r[2] for r in docs], pa.int32()), "mark": pa.array([0] * len(docs), pa.int64())})
    index = retrieval.Postings(table, idf, sum(sum(c.values()) for c in full) / len(docs))
    for year in (None, 1991, 1960):
        n, keys, scores = index.best(np.array([t for q in asked for t in q], np.int64), np.array([len(q) for q in asked]), year, 0, 4)
        got = {(int(q), int(d)): s for q, d, s in zip(np.repeat(np.arange(len(asked)), n), keys, scores)}
        assert got == pytest.approx(brute_bm25([(k, q, year, 0) for k, q in enumerate(asked)], docs, 4))


def test_retrieval_of_real_names(spark):
    """The films that names of exports bring up are those of a search of every name against every title."""
    titles = spark.read.parquet(f"{DATA}/movies.parquet").selectExpr("title", "release_year AS year").where("title IS NOT NULL").distinct()
    names = spark.read.parquet(f"{DATA}/ratings.parquet").selectExpr("name AS title", "year").where("title IS NOT NULL").distinct()

    def terms(df):
        rows = [(r["title"], r["year"], *match.analyse(r["title"])) for r in df.collect()]
        return [(k, retrieval.name_terms(w, n), y, zlib.crc32(" ".join(n).encode())) for k, (_, y, w, n, _) in enumerate(rows)]

    docs, queries = terms(titles), terms(names)
    schema = "key long, terms array<int>, year int, mark long"
    got = {(r["q"], r["d"]): r["bm25"] for r in retrieval.retrieve(spark.createDataFrame(queries, schema), spark.createDataFrame(docs, schema), match.TOP).collect()}
    assert got == pytest.approx(brute_bm25(queries, docs, match.TOP))


def test_many_entities_of_one_name_and_year(spark):
    """Between them nothing decides, and they make no more candidates than one."""
    films = [(k, "Zemicota", 1990) for k in range(400)] + [(1000, "Zemicota", 1994)] + [(2000 + k, f"Casa {chr(97 + k)}xuqoro", 1990) for k in range(20)]
    left = spark.createDataFrame([(1, "Zemicota", 1990), (2, "Zemicota", 1994), (3, "Zemicota", None)], "id long, title string, year int")
    got = match.match_entities(left, "id", "title", "year", spark.createDataFrame(films, "film long, title string, year int"), "film", "title", "year", accept=0.0)
    assert {r["id"]: r["film"] for r in got.collect()} == {2: 1000}


def test_a_nearer_name_of_another_entity_turns_a_match_down(spark):
    films = [(k, f"Farol {a} de Vasodira", 1990) for k, a in enumerate(("Azul", "Verde"))] + [(10 + k, f"Casa {chr(97 + k % 26)}{chr(97 + k // 26)}xuqoro", 1990) for k in range(60)]
    rows = [(0, "Farol Azul de Vasodira", 1990), (1, "Farol Verde de Vasodira", 1990), (2, "Farol de Vasodira", 1990), (3, "Farol Azlu de Vasodira", 1990)]
    left = spark.createDataFrame(rows, "id long, title string, year int")
    right = spark.createDataFrame(films, "film long, title string, year int")
    got = {r["id"]: r["film"] for r in match.match_entities(left, "id", "title", "year", right, "film", "title", "year", accept=0.0).collect()}
    assert got == {0: 0, 1: 1, 3: 0}


def test_every_entity_and_row_calibrates_the_confidence(spark, monkeypatch):
    word = lambda k: "".join(chr(97 + k // 26**p % 26) for p in range(4))
    films = spark.createDataFrame([(k, f"Casa {word(k)}xu", 1990) for k in range(4_300)], "film long, title string, year int")
    rows = spark.createDataFrame([(k, f"Casa {word(k)}", 1990) for k in range(20_100)], "id long, title string, year int")
    asked, seen = [], []

    class Enough(Exception):
        pass

    def search(queries, docs, k):
        asked.append({(tuple(r["terms"]), r["year"]) for r in queries.select("terms", "year").collect()})
        raise Enough

    def calibrate(trials, likely):
        seen.append(likely.count())
        raise Enough

    with monkeypatch.context() as m, pytest.raises(Enough):
        m.setattr(match, "retrieve", search)
        match.match_entities(rows.limit(1), "id", "title", "year", films, "film", "title", "year")
    own = [tuple(retrieval.name_terms(*match.analyse(f"Casa {word(k)}xu")[:2])) for k in range(4_300)]
    assert asked[0] >= {(t, y) for t in own for y in (1990, None)}
    with monkeypatch.context() as m, pytest.raises(Enough):
        m.setattr(match, "_calibrate", calibrate)
        match.match_entities(rows, "id", "title", "year", films.limit(8), "film", "title", "year")
    assert seen == [20_100]
