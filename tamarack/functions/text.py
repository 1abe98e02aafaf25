"""Text functions as columns: folding, tokens, keys, query cleaning, phrases about a film's attributes."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

#: Two or more letters, digits or underscores; spelled out, as \w is ASCII in Java and Unicode elsewhere.
TOKEN = r"[\p{L}\p{N}_]{2,}"
WORD = r"[\p{L}\p{N}_]+"

# Leading articles that a title key drops.
ARTICLES = ("o", "a", "os", "as", "um", "uma", "uns", "umas")
# Words (accents folded) that carry no content in a query.
STOPWORDS = (
    "a", "o", "as", "os", "um", "uma", "uns", "umas", "de", "da", "do", "das", "dos", "e", "em", "no", "na", "nos", "nas", "com", "sem", "sob", "sobre", "por", "para", "pra", "que", "qual", "quais",
    "quem", "onde", "como", "quando", "ao", "aos", "se", "seu", "sua", "seus", "suas", "ele", "ela", "eles", "elas", "este", "esta", "esse", "essa", "aquele", "aquela", "aqueles", "aquelas", "isto",
    "isso", "aquilo", "meu", "minha", "filme", "filmes", "longa", "longas", "desenho", "animacao", "serie", "cinema",
)
EDGE = " ?¿!.,;:"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Characters whose canonical decomposition is a base and marks, and those bases."""
    source, target = [], []
    for code in range(0xC0, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7FF or 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        d = unicodedata.normalize("NFD", c)
        base = "".join(x for x in d if unicodedata.category(x) != "Mn")
        if d != c and len(base) == 1 and code < 0x10000:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target)


def fold(text: Column) -> Column:
    """Accents removed: composed letters to their base, combining marks dropped."""
    source, target = _folding()
    return F.regexp_replace(F.translate(text, source, target), r"\p{M}+", "")


def tokens(text: Column) -> Column:
    """Lower-case, accent-free tokens of two or more word characters, in their order; empty for null."""
    return F.coalesce(F.regexp_extract_all(fold(F.lower(text)), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def content_tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Tokens between blanks, folded, of more than two characters, without stopwords."""
    words = F.split(F.trim(fold(F.lower(F.coalesce(text, F.lit(""))))), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stopwords))


def name_key(text: Column) -> Column:
    """Lower case, blanks collapsed, one leading article dropped (a lone article gives the empty key)."""
    words = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+", " ")
    return F.regexp_replace(words, rf"^(?:{'|'.join(ARTICLES)})(?: |$)", "")


def space_key(text: Column) -> Column:
    """Trimmed, lower case, runs of blanks as one: the key under which lookups are remembered."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def of_request(spark: SparkSession, **columns: Column) -> Row:
    """Values of columns that are made of literals only, as of one request's strings: the optimiser folds them, no job runs."""
    return spark.sql("SELECT 1").select(*[c.alias(n) for n, c in columns.items()]).first()


def clean_query(query: str | None) -> str:
    """A descriptive query without its leading filler words; at least one word stays. For the one string of a request."""
    text = (query or "").strip()
    words = text.split()

    def filler(word: str) -> bool:
        bare = unicodedata.normalize("NFD", word.lower().strip("?¿!.,;:"))
        return "".join(c for c in bare if unicodedata.category(c) != "Mn") in STOPWORDS

    keep = next((k for k, w in enumerate(words) if not filler(w)), len(words) - 1)
    return " ".join(words[max(keep, 0) :]).strip(EDGE) or text


def clean_query_column(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """`clean_query` for a column of queries."""
    text = F.trim(F.coalesce(text, F.lit("")))
    words = F.split(text, r"\s+")
    solid = F.transform(words, lambda w: ~fold(F.lower(F.regexp_replace(w, r"^[?¿!.,;:]+|[?¿!.,;:]+$", ""))).isin(*stopwords))
    first = F.array_position(solid, F.lit(True))
    start = F.when(first > 0, first).otherwise(F.size(words)).cast("int")
    cleaned = F.regexp_replace(F.array_join(F.slice(words, start, F.size(words)), " "), r"^[ ?¿!.,;:]+|[ ?¿!.,;:]+$", "")
    return F.when(cleaned != "", cleaned).otherwise(text)


def countries(text: Column) -> Column:
    """Parts between pipes, empty ones dropped."""
    return F.coalesce(F.filter(F.split(text, "[|]"), lambda x: x != ""), F.array().cast("array<string>"))


def year_of(date: Column) -> Column:
    """The year that a date text starts with; null if it starts otherwise."""
    return F.substring(date, 1, 4).try_cast("int")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def decade_label(year: Column) -> Column:
    return F.concat(decade(year).cast("string"), F.lit("s"))


def passage(overview: Column, title: Column, keywords: Column) -> Column:
    """What a reranker reads: the trimmed overview, else the title with up to ten keywords."""
    other = F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(F.slice(F.coalesce(keywords, F.array().cast("array<string>")), 1, 10), " ")))
    return F.coalesce(F.nullif(F.trim(overview), F.lit("")), other)


def with_prefix(text: Column, family: str, side: str) -> Column:
    """The prefix that encoders of the e5 family ask for: side is query or passage."""
    return F.concat(F.lit(f"{side}: "), text) if "e5" in family.lower() else text


def placeholder_url(title: Column, base: str = "https://placehold.co/300x450?text=") -> Column:
    """A stand-in picture with the first 40 characters of the title; blanks as %20, slashes kept."""
    return F.concat(F.lit(base), F.replace(F.replace(F.url_encode(F.substring(title, 1, 40)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


# What is added to a film's thematic text for its era, acclaim and length.
PHRASES = {
    "year": ("década de {decade}", "filme dos anos {decade}", "de {year}"),
    "until 1929": ("filme mudo", "cinema mudo", "preto e branco", "filme muito antigo"),
    "1930 to 1935": ("preto e branco", "filme antigo clássico"),
    "1936 to 1969": ("filme antigo clássico",),
    "from 2018": ("filme recente atual",),
    "acclaimed": ("filme aclamado muito bom premiado obra-prima",),
    "good": ("filme bem avaliado bom",),
    "bad": ("filme ruim mal avaliado fraco",),
    "short": ("curta-metragem curta",),
    "long": ("filme longo épico",),
}
# Keywords in English and what is added for them.
KEYWORD_SYNONYMS = {
    "black and white": "preto e branco",
    "silent film": "filme mudo cinema mudo sem diálogo",
    "based on a true story": "baseado em fatos reais história real",
    "based on novel or book": "baseado em livro adaptação literária",
    "based on comic": "baseado em quadrinhos hq",
    "stop motion": "stop motion animação quadro a quadro",
    "anime": "anime animação japonesa",
    "found footage": "found footage filmagem encontrada",
    "mockumentary": "falso documentário",
    "cult film": "filme cult",
    "remake": "refilmagem remake",
    "sequel": "continuação sequência",
    "based on video game": "baseado em videogame jogo",
}


def attribute_phrases(year: Column, vote: Column, votes: Column, runtime: Column, phrases: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Phrases for a film's era, acclaim and length, in that order; a missing or zero value adds none."""
    phrases = PHRASES if phrases is None else phrases

    def say(name: str) -> Column:
        parts = []
        for p in phrases.get(name, ()):
            text = F.lit(p)
            for mark, value in (("{decade}", decade(year)), ("{year}", year)):
                text = F.replace(text, F.lit(mark), value.cast("string")) if mark in p else text
            parts.append(text)
        return F.array(*parts) if parts else none

    none = F.array().cast("array<string>")
    # fixed values: the years, votes and minutes at which a phrase begins or ends
    vote, votes = F.coalesce(vote, F.lit(0.0)), F.coalesce(votes, F.lit(0))
    era = F.when(year == 0, none).when(year <= 1929, say("until 1929")).when(year <= 1935, say("1930 to 1935")).when(year <= 1969, say("1936 to 1969")).otherwise(none)
    acclaim = F.when((vote >= 7.8) & (votes >= 300), say("acclaimed")).when(vote >= 7.0, say("good")).when((vote != 0) & (vote <= 4.5) & (votes >= 80), say("bad")).otherwise(none)
    length = F.when((runtime != 0) & (runtime < 45), say("short")).when(runtime >= 150, say("long")).otherwise(none)
    return F.concat(F.when(year != 0, say("year")).otherwise(none), era, F.when(year >= 2018, say("from 2018")).otherwise(none), acclaim, length)


def keyword_synonyms(names: Column, synonyms: dict[str, str] | None = None) -> Column:
    """What is added for those of the keywords (an array) that have a synonym, in their order."""
    pairs = [F.lit(x) for kv in (synonyms or KEYWORD_SYNONYMS).items() for x in kv]
    return F.array_compact(F.transform(names, lambda k: F.element_at(F.create_map(*pairs), F.lower(k))))
