"""Queries of lexical ranking, vector similarity, fusion, reranking and explanation. Documents are the catalogue here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions import text as tx
from tamarack.functions import vectors as vx
from tamarack.functions.models import encode, hashed_encoder
from tamarack.functions.similarity import edit_similarity, name_score
from tamarack.operators import fusion as fu
from tamarack.operators import search as se
from tamarack.plans.common import BM25, FILMS, GENRES, IDF, QUERY, PARTS, PEOPLE, alike_sql, catalogue, credits, films, fold_sql, genre_names, index_of, keyword_bridge, keyword_vectors, parts, people, plain_form, postings_sql, tokens_sql, vectors
from tamarack.runtime import scratch, table

#: Document whose vector serves as query vector.
ANCHOR = 7


def bm25_build(spark: SparkSession, d: str) -> DataFrame:
    """Builds and saves the index that the searches of documents read: its size."""
    index = index_of(spark, d, "documents", rebuild=True)
    return index.rows.agg(F.count(F.lit(1)).alias("n_postings"), F.countDistinct("term").alias("n_terms"), F.lit(index.n_docs).cast("long").alias("n_docs"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best documents for a query by BM25."""
    s = index_of(spark, d, "documents").scores(QUERY).withColumn("score", F.round("score", 6))
    return fu.top(s, 20, "id").select(F.col("id").alias("doc_id"), "score", "position")


def bm25_film_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 best films by their overviews."""
    s = index_of(spark, d, "overviews").scores(QUERY).withColumn("score", F.round("score", 6))
    return fu.top(s, 20, "id").select(F.col("id").alias("tmdb_id"), "score", "position")


def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf of every term of the documents."""
    return index_of(spark, d, "documents").terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Size of the collection, mean length of documents with terms, longest document."""
    index = index_of(spark, d, "documents")
    lens = index.rows.groupBy("id").agg(F.max("len").alias("len"))
    return lens.agg(F.lit(index.n_docs).cast("long").alias("n_docs"), F.round(F.lit(index.avgdl), 6).alias("avgdl"), F.max("len").alias("longest"))


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    """For every genre name as a query, the 3 best film overviews."""
    index = index_of(spark, d, "overviews")
    s = index.batch(table(spark, d, "genres").withColumn("q", F.concat(F.col("name"), F.lit(" segredo investigação viagem"))), "genre_id", "q").withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select(F.col("query").alias("genre_id"), F.col("id").alias("tmdb_id"), "score", "rank")


def stopword_postings(spark: SparkSession, d: str) -> DataFrame:
    """Documents' token and content-token counts: the stopwords left out."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n_tokens"), F.size(tx.content_tokens(F.col("text"))).alias("n_content"))


def fold_accents(spark: SparkSession, d: str) -> DataFrame:
    """Titles without accents, in lower case."""
    return films(spark, d).select("tmdb_id", tx.fold(F.lower("title")).alias("folded"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 vectors nearest to one vector."""
    v = vectors(spark, d)
    q = v.where(F.col("id") == ANCHOR).select(F.col("vector").alias("q"))
    scored = v.crossJoin(F.broadcast(q)).select("id", F.round(vx.dot(F.col("vector"), F.col("q")), 6).alias("score"))
    return fu.top(scored, 20, "id").select(F.col("id").alias("vec_id"), "score", "position")


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Length of every vector, and its largest component at length 1."""
    v = vectors(spark, d)
    return v.select(F.col("id").alias("vec_id"), F.round(vx.length(F.col("vector")), 5).alias("length"), F.round(F.array_max(vx.unit(F.col("vector"))), 5).alias("largest"))


def popularity_prior(spark: SparkSession, d: str) -> DataFrame:
    """Popularity prior of every film: 0.35 z(ln(1 + votes))."""
    return se.popularity_prior(films(spark, d), "vote_count").select("tmdb_id", F.round("prior", 6).alias("prior"))


def _vector(spark: SparkSession, d: str):
    """The query vector as a literal."""
    row = vectors(spark, d).where(F.col("id") == ANCHOR).first()
    return F.array(*[F.lit(float(x)) for x in row["vector"]]) if row else None


def _engine(spark: SparkSession, d: str) -> se.SearchEngine:
    """Search over documents, whose lengths stand for votes; they have no titles."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL")
    cat = docs.select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("overview"), F.year("posted_at").alias("year"), F.col("lang").alias("language"), F.col("n_chars").alias("votes"), F.lit(None).cast("double").alias("vote_average"), F.col("n_chars").cast("double").alias("popularity"))
    return se.SearchEngine(cat, index_of(spark, d, "documents"), vectors=vectors(spark, d), keyword_vectors=keyword_vectors(spark, d), base=edit_similarity, title_base=edit_similarity)


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """(id, lexical, synopsis, keyword, prior, z_synopsis, z_keyword) of all documents."""
    return _engine(spark, d).components(QUERY, _vector(spark, d))


def _signals_sql(source: str, key: str, text: str, votes: str, query: str, vector: str, theme: str, weight: float = 0.25) -> str:
    """The same over any table: `vector` and `theme` give the number of a row's vectors."""
    return f"""{postings_sql(source, key, text)},
    q AS (SELECT DISTINCT unnest({tokens_sql(f"'{query}'")}) AS term),
    lx AS (SELECT p.id, {BM25} AS score FROM p JOIN q ON p.term = q.term JOIN dfs ON dfs.term = p.term, st GROUP BY p.id),
    a AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {ANCHOR}),
    nv AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], a.v) AS sim FROM embeddings, a),
    base AS (SELECT {key} AS id, ln(1 + coalesce({votes}, 0)::DOUBLE) AS pop, {vector} AS vi, {theme} AS ki FROM {source} WHERE {key} IS NOT NULL),
    raw AS (SELECT base.id, coalesce(lx.score, 0.0) AS lex, x.sim AS syn, y.sim AS kw, pop FROM base LEFT JOIN lx ON lx.id = base.id LEFT JOIN nv x ON x.id = vi LEFT JOIN nv y ON y.id = ki),
    m AS (SELECT avg(lex) AS ml, stddev_pop(lex) AS sl, avg(syn) AS ms, stddev_pop(syn) AS ss, avg(kw) AS mk, stddev_pop(kw) AS sk, avg(pop) AS mp, stddev_pop(pop) AS sp FROM raw),
    sg AS (SELECT id, {weight} * greatest(0.0, (lex - ml) / sl) AS lexical, 0.6 * greatest(0.0, coalesce((syn - ms) / ss, 0.0)) AS synopsis, 0.5 * greatest(0.0, coalesce((kw - mk) / sk, 0.0)) AS keyword, 0.35 * (pop - mp) / sp AS prior, coalesce((syn - ms) / ss, 0.0) AS z_synopsis, coalesce((kw - mk) / sk, 0.0) AS z_keyword FROM raw, m)"""


_SIGNALS = _signals_sql("documents", "doc_id", "text", "n_chars", QUERY, "doc_id", "doc_id + 1")


def zscore_relu_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fused score of every document: weighted ReLU z-scores and the prior."""
    return se.SearchEngine.fused(_signals(spark, d)).select(F.col("id").alias("doc_id"), *[F.round(c, 5).alias(c) for c in ("lexical", "synopsis", "keyword", "prior", "score")])


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return se.SearchEngine.fused(_signals(spark, d))


_FUSE = "fs AS (SELECT id, round(lexical + synopsis + keyword + prior, 9) AS score, round(synopsis, 9) AS synopsis, round(keyword, 9) AS keyword, lexical, z_synopsis, z_keyword FROM sg)"
_FUSED = f"{_SIGNALS}, {_FUSE}"


def synopsis_positive(spark: SparkSession, d: str) -> DataFrame:
    """The 40 best fused documents, as far as their score is positive."""
    return _engine(spark, d).by_synopsis(QUERY, 10, _vector(spark, d)).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def full_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Position of every document in the fused ranking."""
    return fu.with_position(_fused(spark, d).select("id", "score"), F.desc("score"), F.asc("id")).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "position")


def per_signal_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates: the 40 best fused, the 80 best by either vector alone, blended with their scores."""
    found, _ = _engine(spark, d).candidates(QUERY, 10, _vector(spark, d))
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def _blended(spark: SparkSession, d: str) -> DataFrame:
    f = _fused(spark, d)
    cut_ = f.orderBy(F.desc("score"), "id").limit(200)
    m = fu.with_min_max(cut_, norm="score")
    return m.withColumn("final", F.round(0.7 * F.col("norm") + 0.3 * F.least(F.lit(1.0), F.col("synopsis")), 6))


_BLENDED = f"""{_FUSED}, cc AS (SELECT * FROM fs ORDER BY score DESC, id LIMIT 200), mm AS (SELECT min(score) AS lo, max(score) AS hi FROM cc),
    bl AS (SELECT cc.*, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0 END AS norm FROM cc, mm), bf AS (SELECT *, round(0.7 * norm + 0.3 * least(1.0, synopsis), 6) AS final FROM bl)"""


def minmax_blend(spark: SparkSession, d: str) -> DataFrame:
    """The 200 best documents with their scores blended: min-max of the fused score, and the vector signal."""
    return _blended(spark, d).select(F.col("id").alias("doc_id"), F.round("norm", 6).alias("norm"), "final")


def relevance_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Relevance within the list, absolute confidence and its band for the 200 best documents."""
    b = _blended(spark, d)
    span = b.agg(F.min("final").alias("lo"), F.max("final").alias("hi"))
    conf = se.confidence(F.round(F.greatest("z_synopsis", "z_keyword"), 5), F.lit(None).cast("double"), F.lit(0.0))
    return b.crossJoin(F.broadcast(span)).select(F.col("id").alias("doc_id"), se.relevance(F.col("final"), F.col("lo"), F.col("hi")).alias("relevance"), conf.alias("confidence"), se.confidence_band(conf).alias("band"))


def signal_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the signals in each of the 200 best documents, largest first."""
    c = se.contributions(F.col("lexical"), F.col("synopsis"), F.col("keyword"), F.lit(1.0), F.lit(None).cast("double"), F.lit(0.0), F.lit(None).cast("double"))
    rows = _blended(spark, d).withColumn("lexical", F.round("lexical", 6)).select("id", F.posexplode(c).alias("pos", "s"))
    return rows.where("s.share > 0.001").select(F.col("id").alias("doc_id"), "pos", F.col("s.signal").alias("signal"), F.col("s.share").alias("share"))


def rerank_head_tail(spark: SparkSession, d: str) -> DataFrame:
    """The 200 best documents, the first 50 of them reordered by a second score (shorter texts first), the tail kept."""
    f = _fused(spark, d).orderBy(F.desc("score"), "id").limit(200).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars"), "id")
    r = fu.rerank_head(f, "id", "score", 1.0 / (1 + F.coalesce("n_chars", F.lit(0))), pool=50, blend=0.5)
    return r.select(F.col("id").alias("doc_id"), "is_tail", F.round("final", 5).alias("final"))


def intent_weights(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct film title as a query: words, content words, weights of lexical and name signal, intent by edit likeness to a fixed title."""
    t = films(spark, d).select("title").distinct().where("title IS NOT NULL")
    words = F.size(F.split(F.trim("title"), r"\s+"))
    n = F.size(tx.content_tokens(F.col("title")))
    lex = F.when(n <= 3, 0.30).when(n <= 6, 0.25).otherwise(0.20)
    base = F.when(words <= 3, 0.6).when(words <= 5, 0.3).otherwise(0.05)
    best = edit_similarity(plain_form(tx.name_key(F.col("title"))), F.lit("bakazela 7"))
    return t.select("title", lex.alias("lexical_weight"), base.alias("base"), fu.intent_column(best, base).alias("i")).select("title", "lexical_weight", "base", F.col("i.weight").alias("name_weight"), F.col("i.intent").alias("intent"))


def name_search(spark: SparkSession, d: str) -> DataFrame:
    """The 40 films whose titles answer a mistyped name best, with edit likeness as base."""
    cat = films(spark, d).select(F.col("tmdb_id").alias("id"), "title").where("title IS NOT NULL")
    q = "bakazela 7"
    keyed = cat.withColumn("key", tx.name_key(F.col("title"))).withColumn("base", edit_similarity(F.lit(q), plain_form(F.col("key"))))
    score = name_score(q, F.col("key"), F.col("title"), F.col("base"), ["bakazela"])
    return fu.top(keyed.select("id", F.round(score, 6).alias("score")), 40, "id").select(F.col("id").alias("tmdb_id"), "score", "position")


def wratio_name_search(spark: SparkSession, d: str) -> DataFrame:
    """The films whose titles answer a mistyped name best, by the weighted ratio."""
    cat = films(spark, d).select(F.col("tmdb_id").alias("id"), "title").where("title IS NOT NULL")
    return se.by_name(cat, "bakazela 7", 10).select(F.col("id").alias("tmdb_id"), F.round("score", 6).alias("score"))


def title_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words of a query that stand in film titles."""
    t = films(spark, d).select("tmdb_id", se.matched_title_terms("a noite azul do trem secreto", F.col("title")).alias("terms"))
    return t.where(F.size("terms") > 0)


def matched_keywords(spark: SparkSession, d: str) -> DataFrame:
    """For every label of the vectors, up to four of its vectors nearest to the query vector, at 0.30 or more."""
    e = table(spark, d, "embeddings")
    terms = e.select(F.col("label").alias("id"), F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("vector"))
    q = e.where(F.col("vec_id") == ANCHOR).select("embedding").first()
    if q is None:
        return terms.limit(0).select(F.col("id").alias("label"), F.array("name").alias("keywords"))
    vec = F.array(*[F.lit(float(x)) for x in q[0]])
    return se.matched_keywords(terms, vec).select(F.col("id").alias("label"), "keywords")


def passage_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of every film's passage by the test encoder."""
    text = tx.with_prefix(tx.passage(F.col("overview"), F.col("title"), F.lit(None).cast("array<string>")), "e5", "passage")
    return films(spark, d).select("tmdb_id", encode(text, hashed_encoder(32)).alias("vector"))


def _new_film_engine(spark: SparkSession, d: str) -> se.SearchEngine:
    cat = catalogue(spark, d).select("id", "title", "overview", "year", "language", "votes", "vote_average", "popularity")
    v = vectors(spark, d)
    numbers = cat.select(F.col("id").alias("film")).crossJoin(F.broadcast(v.agg(F.count(F.lit(1)).alias("n"))))
    mine = lambda k: numbers.withColumn("id", F.pmod(F.col("film") + k, "n")).join(v, "id").select(F.col("film").alias("id"), "vector")
    bridge, named = keyword_bridge(spark, d).dropna().distinct(), table(spark, d, "keywords").where("name IS NOT NULL")
    terms = bridge.join(named, "keyword_id").withColumn("v", F.pmod(F.col("keyword_id").cast("long"), F.lit(v.count()))).join(v.select(F.col("id").alias("v"), "vector"), "v").select("id", "name", "vector")
    tables = {"genres": genre_names(spark, d), "keywords": named.select(F.col("keyword_id").alias("entity"), "name"), "keyword_bridge": bridge.select(F.col("keyword_id").alias("entity"), "id"), "keyword_terms": terms}
    return se.SearchEngine(cat, index_of(spark, d, "overviews"), vectors=mine(0), keyword_vectors=mine(1), **tables)


_saved: dict[tuple[str, str], str] = {}


def _film_engine(spark: SparkSession, d: str) -> se.SearchEngine:
    """Search over films, whose index is written once in a session; a film's vectors are those whose number is the film's
    id, or the next, modulo their count."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _saved:
        path = scratch(spark, "films", keep=True)
        _new_film_engine(spark, d).save(path)
        _saved[key] = path
    return se.SearchEngine.load(spark, _saved[key], base=edit_similarity, title_base=edit_similarity, rescore=lambda q, p: 1.0 / (1 + F.length(p)))


_FILM_SIGNALS = _signals_sql("films", "tmdb_id", "overview", "vote_count", QUERY, "tmdb_id % (SELECT count(*) FROM embeddings)", "(tmdb_id + 1) % (SELECT count(*) FROM embeddings)")
_FILTERS = {"year_min": 2000}


def _told(out: DataFrame) -> DataFrame:
    e = F.col("explanation")
    return out.select(F.col("id").alias("tmdb_id"), F.round("score", 4).alias("score"), "position", e["relevance"].alias("relevance"), e["confidence"].alias("confidence"), e["matched_title_terms"].alias("title_terms"), e["matched_keywords"].alias("keywords"), F.element_at(e["constraints"], "director").alias("director"))


def search_auto(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search over all films with explanations: every signal, candidates, blend, second score, filters."""
    return _told(_film_engine(spark, d).search(QUERY, "auto", 20, _FILTERS, vector=_vector(spark, d)))


def search_synopsis(spark: SparkSession, d: str) -> DataFrame:
    """The same by the synopsis alone."""
    return _told(_film_engine(spark, d).search(QUERY, "synopsis", 20, _FILTERS, vector=_vector(spark, d)))


NAME = "segredo de bakazela"


def search_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Films whose titles answer a title best, by edit likeness."""
    return _told(_film_engine(spark, d).search(NAME, "name", 20, explain=True)).drop("keywords", "director")


def search_by_keyword(spark: SparkSession, d: str) -> DataFrame:
    """Films of the keywords most like a mistyped one, the more popular first among equals."""
    engine = _film_engine(spark, d)
    engine.keywords = engine.keywords.withColumn("name", plain_form(F.trim("name")))
    return _told(engine.search("wintr journey", "keyword", 20, explain=True)).select("tmdb_id", "score", "position", "relevance")


def _part_engine(spark: SparkSession, d: str) -> se.SearchEngine:
    """Search among the parts that people are credited in."""
    cat = parts(spark, d).select("id", "title", F.col("title").alias("overview"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("long").alias("votes"), F.lit(None).cast("double").alias("vote_average"), "popularity")
    return se.SearchEngine(cat, None, people=people(spark, d), credits=credits(spark, d), base=edit_similarity, title_base=edit_similarity)


def search_by_person(spark: SparkSession, d: str) -> DataFrame:
    """What the people named most like a mistyped name are credited in as directors."""
    found = _part_engine(spark, d).search("Suplier#00000012", "person", 20, role="director")
    return _told(found).select(F.col("tmdb_id").alias("id"), "score", "position", "relevance")


def search_combined(spark: SparkSession, d: str) -> DataFrame:
    """Search among what one person directed, without a text: by popularity, with the constraint in the explanation."""
    found = _part_engine(spark, d).combined(None, "Supplier#000000005", None, 20)
    return _told(found).select(F.col("tmdb_id").alias("id"), "score", "position", "relevance", "director")


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_film_topk, bm25_term_stats, bm25_lengths, bm25_batch, stopword_postings, fold_accents, vector_topk, unit_vectors, popularity_prior, zscore_relu_fusion, synopsis_positive, full_ranking,
    per_signal_candidates, minmax_blend, relevance_confidence, signal_shares, rerank_head_tail, intent_weights, name_search, wratio_name_search, title_terms, matched_keywords, passage_vectors, search_auto,
    search_synopsis, search_by_name, search_by_keyword, search_by_person, search_combined, bm25_build,
)}

_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_CONTENT = lambda c: f"[x FOR x IN regexp_split_to_array(trim({fold_sql(c)}), '\\s+') IF length(x) > 2 AND x NOT IN ({_STOP})]"
_KEY = r"regexp_replace(regexp_replace(trim(lower(title)), '\s+', ' ', 'g'), '^(?:o|a|os|as|um|uma|uns|umas)(?: |$)', '')"


def _topk(source: str, key: str, text: str, name: str) -> str:
    return f"""WITH {FILMS}, {postings_sql(source, key, text)}, q AS (SELECT DISTINCT unnest({tokens_sql(f"'{QUERY}'")}) AS term),
        s AS (SELECT p.id, round({BM25}, 6) AS score FROM p JOIN q ON p.term = q.term JOIN dfs ON dfs.term = p.term, st GROUP BY p.id)
        SELECT id AS {name}, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS position FROM s ORDER BY score DESC, id LIMIT 20"""


#: Candidates without names, as no title is near the query: their weight is 0.05 for a query of more than five words.
_CANDIDATES = """ci AS (SELECT id FROM (SELECT id FROM fs ORDER BY score DESC, id LIMIT 40) UNION SELECT id FROM (SELECT id FROM fs ORDER BY synopsis DESC, id LIMIT 80) UNION SELECT id FROM (SELECT id FROM fs ORDER BY keyword DESC, id LIMIT 80)),
    cs AS (SELECT fs.* FROM fs JOIN ci ON ci.id = fs.id), cm AS (SELECT min(score) AS lo, max(score) AS hi FROM cs),
    bl AS (SELECT cs.* EXCLUDE (score), round((1 - 0.05) * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.0 END, 9) AS score FROM cs, cm)"""
_SECOND = "1.0::DOUBLE / (1 + length(coalesce(nullif(trim(overview, ' '), ''), trim(coalesce(title, ''), ' '))))"


def _searched(scored: str, before: str) -> str:
    """What comes after the candidates `scored` (id, score, z_synopsis, z_keyword): second score for the 300 best, filter, cut, explanation."""
    words = ", ".join(f"'{w}'" for w in sorted({w for w in QUERY.split() if len(w) > 2}))
    return f"""WITH {FILMS}, {before}, c AS (SELECT s.*, f.title, f.release_year, {_SECOND} AS sec, row_number() OVER (ORDER BY s.score DESC, s.id) AS rn FROM {scored} s JOIN films f ON f.tmdb_id = s.id),
        hm AS (SELECT min(sec) AS a, max(sec) AS b, min(score) AS lo, max(score) AS hi FROM c WHERE rn <= 300), r AS (SELECT c.* EXCLUDE (score), round(0.5 * CASE WHEN b > a THEN (sec - a) / (b - a) ELSE 0 END + 0.5 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 9) AS score FROM c, hm WHERE rn <= 300),
        sp AS (SELECT min(score) AS lo, max(score) AS hi FROM r), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS position FROM r WHERE release_year >= 2000),
        kt AS (SELECT DISTINCT k.id, w.name, list_dot_product(e.embedding::DOUBLE[], a.v) AS sim FROM k JOIN movie_keywords b ON b.tmdb_id = k.id JOIN keywords w ON w.keyword_id = b.keyword_id JOIN embeddings e ON e.vec_id = w.keyword_id % (SELECT count(*) FROM embeddings), a WHERE k.position <= 20 AND w.name IS NOT NULL),
        kk AS (SELECT id, list(name ORDER BY rn) AS names FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, name) AS rn FROM kt WHERE sim >= 0.30) WHERE rn <= 4 GROUP BY 1)
        SELECT k.id AS tmdb_id, round(score, 4) AS score, CAST(position AS INTEGER) AS position, CASE WHEN hi > lo THEN CAST(round_even(100 * (score - lo) / (hi - lo), 0) AS INTEGER) ELSE 100 END AS relevance, CAST(round_even(100 / (1 + exp(-0.85 * (greatest(z_synopsis, z_keyword) - 1.4))), 0) AS INTEGER) AS confidence,
            list_distinct([t FOR t IN regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+') IF t IN ({words})]) AS title_terms, coalesce(names, []) AS keywords, CAST(NULL AS VARCHAR) AS director FROM k LEFT JOIN kk ON kk.id = k.id, sp WHERE position <= 20"""


_PLAIN_KEY = fold_sql(_KEY)
_NAMED = f"""x AS (SELECT tmdb_id, title, {_KEY} AS k FROM films), b AS (SELECT *, {alike_sql("'" + NAME + "'", "k")} AS base FROM x WHERE title IS NOT NULL), f AS (SELECT * FROM b WHERE base >= 0.5 ORDER BY base DESC, tmdb_id LIMIT 160),
    s AS (SELECT tmdb_id, title, round(CASE WHEN k = '{NAME}' THEN base + 0.5 WHEN starts_with(k, '{NAME}') THEN base + 0.15 ELSE base * (0.4 + 0.6 * least(1.0, length(k)::DOUBLE / {len(NAME)})) * (0.2 + 0.8 * (list_contains({_CONTENT('title')}, 'segredo')::INT + list_contains({_CONTENT('title')}, 'bakazela')::INT)::DOUBLE / 2) END, 9) AS score FROM f),
    t AS (SELECT * FROM s ORDER BY score DESC, tmdb_id LIMIT 80), sp AS (SELECT min(score) AS lo, max(score) AS hi FROM t)"""
_RELEVANCE = "CASE WHEN hi > lo THEN CAST(round_even(100 * (score - lo) / (hi - lo), 0) AS INTEGER) ELSE 100 END AS relevance"

ORACLE = {
    "bm25_build": f"WITH {postings_sql('documents', 'doc_id', 'text')} SELECT count(*) AS n_postings, count(DISTINCT term) AS n_terms, any_value(st.n) AS n_docs FROM p, st",
    "search_auto": _searched("bl", f"{_FILM_SIGNALS}, {_FUSE}, {_CANDIDATES}"),
    "search_synopsis": _searched("(SELECT * FROM fs ORDER BY score DESC, id LIMIT 80)", f"{_FILM_SIGNALS}, {_FUSE}"),
    "search_by_name": f"""WITH {FILMS}, {_NAMED} SELECT tmdb_id, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, tmdb_id) AS INTEGER) AS position, {_RELEVANCE},
        CAST(round_even(100 * greatest(1 / (1 + exp(0.85 * 1.4)), least(1.0, score)), 0) AS INTEGER) AS confidence, list_distinct([t FOR t IN regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+') IF t IN ('segredo', 'bakazela')]) AS title_terms FROM t, sp ORDER BY position LIMIT 20""",
    "search_by_keyword": f"""WITH {FILMS}, g AS (SELECT keyword_id, {alike_sql("'wintr journey'", 'n')} AS s FROM (SELECT keyword_id, {fold_sql("trim(name, ' ')")} AS n FROM keywords WHERE name IS NOT NULL)), e AS (SELECT * FROM g WHERE s >= 0.8 ORDER BY s DESC, keyword_id LIMIT 15),
        b AS (SELECT DISTINCT tmdb_id AS id, keyword_id FROM movie_keywords WHERE tmdb_id IS NOT NULL), m AS (SELECT id, sum(s) AS score FROM e JOIN b USING (keyword_id) GROUP BY 1), t AS (SELECT m.id, m.score, coalesce(popularity, 0) AS pop FROM m LEFT JOIN films ON films.tmdb_id = m.id ORDER BY m.score DESC, pop DESC, m.id LIMIT 80),
        k AS (SELECT t.* FROM t JOIN films ON films.tmdb_id = t.id), sp AS (SELECT min(score) AS lo, max(score) AS hi FROM k) SELECT id AS tmdb_id, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, pop DESC, id) AS INTEGER) AS position, {_RELEVANCE} FROM k, sp ORDER BY position LIMIT 20""",
    "search_by_person": f"""WITH {PEOPLE}, {PARTS}, f AS (SELECT person, {alike_sql("'Suplier#00000012'", 'name')} AS s FROM people), e AS (SELECT * FROM f WHERE s >= 0.8 ORDER BY s DESC, person LIMIT 15), m AS (SELECT id, max(s) AS score FROM e JOIN credits USING (person) WHERE role = 'director' GROUP BY 1),
        t AS (SELECT m.id, score, coalesce(popularity, 0) AS pop FROM m JOIN parts ON parts.id = m.id ORDER BY score DESC, pop DESC, m.id LIMIT 80), sp AS (SELECT min(score) AS lo, max(score) AS hi FROM t) SELECT id, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, pop DESC, id) AS INTEGER) AS position, {_RELEVANCE} FROM t, sp ORDER BY position LIMIT 20""",
    "search_combined": f"""WITH {PEOPLE}, {PARTS}, t AS (SELECT id, coalesce(popularity, 0) AS score FROM parts WHERE id IN (SELECT id FROM credits JOIN people USING (person) WHERE name = 'Supplier#000000005' AND role = 'director')), sp AS (SELECT min(score) AS lo, max(score) AS hi FROM t)
        SELECT id, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS position, {_RELEVANCE}, 'Supplier#000000005' AS director FROM t, sp ORDER BY position LIMIT 20""",
    "bm25_topk": _topk("documents", "doc_id", "text", "doc_id"),
    "bm25_film_topk": _topk("films", "tmdb_id", "overview", "tmdb_id"),
    "bm25_term_stats": f"WITH {postings_sql('documents', 'doc_id', 'text')} SELECT term, df, round({IDF}, 6) AS idf FROM dfs, st",
    "bm25_lengths": f"WITH {postings_sql('documents', 'doc_id', 'text')} SELECT any_value(st.n) AS n_docs, round(any_value(st.avgdl), 6) AS avgdl, max(len) AS longest FROM ln, st",
    "bm25_batch": f"""WITH {FILMS}, {postings_sql('films', 'tmdb_id', 'overview')}, q AS (SELECT DISTINCT genre_id, unnest({tokens_sql("name || ' segredo investigação viagem'")}) AS term FROM genres),
        s AS (SELECT genre_id, p.id, round({BM25}, 6) AS score FROM p JOIN q ON p.term = q.term JOIN dfs ON dfs.term = p.term, st GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY genre_id ORDER BY score DESC, id) AS rank FROM s) SELECT genre_id, id AS tmdb_id, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""",
    "stopword_postings": f"SELECT doc_id, CAST(coalesce(len({tokens_sql('text')}), 0) AS INTEGER) AS n_tokens, CAST(len({_CONTENT('coalesce(text, chr(32))')}) AS INTEGER) AS n_content FROM documents",
    "fold_accents": f"WITH {FILMS} SELECT tmdb_id, {fold_sql('title')} AS folded FROM films",
    "vector_topk": f"WITH a AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {ANCHOR}), s AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], a.v), 6) AS score FROM embeddings, a) SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS position FROM s ORDER BY score DESC, vec_id LIMIT 20",
    "unit_vectors": "WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) SELECT vec_id, round(n, 5) AS length, round(CASE WHEN n > 0 THEN list_max(v) / n ELSE list_max(v) END, 5) AS largest FROM x",
    "popularity_prior": f"WITH {FILMS}, x AS (SELECT tmdb_id, ln(1 + coalesce(vote_count, 0)::DOUBLE) AS l FROM films), m AS (SELECT avg(l) AS a, stddev_pop(l) AS s FROM x) SELECT tmdb_id, round(0.35 * CASE WHEN s > 0 THEN (l - a) / s ELSE 0 END, 6) AS prior FROM x, m",
    "zscore_relu_fusion": f"WITH {_SIGNALS} SELECT id AS doc_id, round(lexical, 5) AS lexical, round(synopsis, 5) AS synopsis, round(keyword, 5) AS keyword, round(prior, 5) AS prior, round(round(lexical + synopsis + keyword + prior, 9), 5) AS score FROM sg",
    "synopsis_positive": f"WITH {_FUSED} SELECT id AS doc_id, round(score, 6) AS score FROM (SELECT * FROM fs ORDER BY score DESC, id LIMIT 40) WHERE score > 0",
    "full_ranking": f"WITH {_FUSED} SELECT id AS doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS position FROM fs",
    "per_signal_candidates": f"WITH {_FUSED}, {_CANDIDATES} SELECT id AS doc_id, round(score, 6) AS score FROM bl",
    "minmax_blend": f"WITH {_BLENDED} SELECT id AS doc_id, round(norm, 6) AS norm, final FROM bf",
    "relevance_confidence": f"""WITH {_BLENDED}, sp AS (SELECT min(final) AS lo, max(final) AS hi FROM bf), c AS (SELECT id, CAST(round_even(100 * (final - lo) / (hi - lo), 0) AS INTEGER) AS relevance, CAST(round_even(100 * (1 / (1 + exp(-0.85 * (round(greatest(z_synopsis, z_keyword), 5) - 1.4)))), 0) AS INTEGER) AS confidence FROM bf, sp)
        SELECT id AS doc_id, relevance, confidence, CASE WHEN confidence >= 70 THEN 'high' WHEN confidence >= 40 THEN 'mid' ELSE 'low' END AS band FROM c""",
    "signal_shares": f"""WITH {_BLENDED}, bt AS (SELECT *, round(lexical, 6) + synopsis + keyword AS total FROM bf), u AS (SELECT id, 'lexical' AS signal, round(lexical, 6) AS v, total FROM bt UNION ALL SELECT id, 'synopsis', synopsis, total FROM bt UNION ALL SELECT id, 'keyword', keyword, total FROM bt UNION ALL SELECT id, 'name', 0.0, 1.0 FROM bt),
        s AS (SELECT id, signal, round(CASE WHEN total > 0 THEN v / total ELSE 0 END, 3) AS share FROM u), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY share DESC, signal) - 1 AS INTEGER) AS pos FROM s) SELECT id AS doc_id, pos, signal, share FROM k WHERE share > 0.001""",
    "rerank_head_tail": f"""WITH {_FUSED}, c AS (SELECT fs.id, score, 1.0::DOUBLE / (1 + coalesce(n_chars, 0)) AS sec, row_number() OVER (ORDER BY score DESC, fs.id) AS rn FROM fs JOIN documents ON doc_id = fs.id), h AS (SELECT * FROM c WHERE rn <= 50), hm AS (SELECT min(sec) AS a, max(sec) AS b, min(score) AS lo, max(score) AS hi FROM h)
        SELECT id AS doc_id, false AS is_tail, round(0.5 * CASE WHEN b > a THEN (sec - a) / (b - a) ELSE 0 END + 0.5 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 5) AS final FROM h, hm UNION ALL SELECT id, true, round(score, 5) FROM c WHERE rn > 50 AND rn <= 200""",
    "intent_weights": f"""WITH {FILMS}, t AS (SELECT DISTINCT title FROM films WHERE title IS NOT NULL), x AS (SELECT title, len(regexp_split_to_array(trim(title), '\\s+')) AS w, len({_CONTENT('title')}) AS n, {_KEY} AS k FROM t),
        y AS (SELECT title, CASE WHEN n <= 3 THEN 0.30 WHEN n <= 6 THEN 0.25 ELSE 0.20 END::DOUBLE AS lexical_weight, CASE WHEN w <= 3 THEN 0.6 WHEN w <= 5 THEN 0.3 ELSE 0.05 END::DOUBLE AS base, {alike_sql('fk', "'bakazela 7'")} AS b FROM (SELECT *, {fold_sql('k')} AS fk FROM x))
        SELECT title, lexical_weight, base, CASE WHEN b >= 0.92 THEN 0.9 WHEN b >= 0.85 THEN greatest(base, 0.6) ELSE base END::DOUBLE AS name_weight, CASE WHEN b >= 0.85 THEN 'name' ELSE 'description' END AS intent FROM y""",
    "name_search": f"""WITH {FILMS}, x AS (SELECT tmdb_id, {_KEY} AS k, list_contains({_CONTENT('title')}, 'bakazela') AS hit FROM films WHERE title IS NOT NULL), y AS (SELECT *, {alike_sql("'bakazela 7'", 'fk')} AS b FROM (SELECT *, {fold_sql('k')} AS fk FROM x)),
        s AS (SELECT tmdb_id, round(CASE WHEN k = 'bakazela 7' THEN b + 0.5 WHEN starts_with(k, 'bakazela 7') THEN b + 0.15 ELSE b * (0.4 + 0.6 * least(1.0, length(k)::DOUBLE / 10)) * (0.2 + 0.8 * hit::INT::DOUBLE) END, 6) AS score FROM y)
        SELECT tmdb_id, score, CAST(row_number() OVER (ORDER BY score DESC, tmdb_id) AS INTEGER) AS position FROM s ORDER BY score DESC, tmdb_id LIMIT 40""",
    "title_terms": f"""WITH {FILMS}, x AS (SELECT tmdb_id, [t FOR t IN regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+') IF t IN ('noite', 'azul', 'trem', 'secreto')] AS l FROM films)
        SELECT tmdb_id, list_filter(l, lambda t, i: list_position(l, t) = i) AS terms FROM x WHERE len(l) > 0""",
    "matched_keywords": f"""WITH a AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {ANCHOR}), s AS (SELECT label, vec_id::VARCHAR AS name, list_dot_product(embedding::DOUBLE[], a.v) AS sim FROM embeddings, a),
        k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, name) AS rn FROM s WHERE sim >= 0.30) SELECT label, list(name ORDER BY rn) AS keywords FROM k WHERE rn <= 4 GROUP BY label""",
}
