"""Reading level of every document, from vocabulary coverage and sentence complexity.

The corpus gives a frequency-ranked vocabulary of fixed size. For every document the smallest rank is found up to which
that vocabulary covers a fixed share of its words. As credits, headings or a stray sentence move that rank, the same is
taken of every sentence, beside its length, clauses and word length, and the document has the weighted quartiles of
these over its sentences. Readers' judgements calibrate all: one threshold model per level border, fitted on a bounded
number of labelled documents and applied to all as a SQL expression. Who is above a border is above all lower ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.runtime import cut

#: Words of the ranked vocabulary; any other word has the last rank. Part of the measure, the same at every corpus size.
VOCABULARY = 65_536
#: Share of a document's, and of a sentence's, words that the vocabulary must cover.
SHARE = 0.9
#: A sentence weighs as many as it has words, but so many at most: a few long strays shall not outweigh the rest.
WEIGHT = 12
#: Letters that a word counts with at most; longer ones are no words.
LETTERS = 30
#: Labelled documents, at most, on which the level borders are fitted.
LABELLED = 50_000
QUARTILES = (0.25, 0.5, 0.75)
MEASURES = ("coverage", "length", "letters", "clauses")
FEATURES = ["coverage", *(f"{m}_{round(q * 100)}" for m in MEASURES for q in QUARTILES)]

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SENTENCE = re.compile(r"[.!?…;\n\r]+")
_BLANK = re.compile(r"[^ \t\n\r]+")


def _parts(batch: pa.RecordBatch, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(x) if x else 0 for x in batch.column("text").to_pylist()], np.int64)
    part = np.cumsum(sizes) // limit
    edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(sizes)] if len(sizes) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        for t in b.column("text").to_pylist():
            counts.update(_WORD.findall(t.lower()))
        if len(counts) > 1_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts = Counter()
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def ranked_vocabulary(df: DataFrame, text: str, size: int = VOCABULARY) -> dict[str, int]:
    """The `size` most frequent words over all texts, with their ranks from 1."""
    rows = df.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    top = rows.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return {r["word"]: k for k, r in enumerate(top.collect(), 1)}


def _quantile(group: np.ndarray, value: np.ndarray, weight: np.ndarray, q: float, n: int) -> np.ndarray:
    """Per group 0..n-1 (all present): the least value up to which the share q of the group's weight lies."""
    order = np.lexsort((value, group))
    g, v, w = group[order], value[order], weight[order].astype(float)
    first = np.searchsorted(g, np.arange(n))
    total = np.add.reduceat(w, first)
    run = np.cumsum(w) - np.repeat(np.cumsum(total) - total, np.diff(np.r_[first, len(g)]))
    enough = np.where(run >= q * total[g] - 1e-6, np.arange(len(g)), len(g))
    return v[np.minimum.reduceat(enough, first)]


def measure(texts: list[str], ranks: dict[str, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(features of the texts, NaN where a text has no word; number of words between blanks)."""
    out = np.full((len(texts), len(FEATURES)), np.nan)
    blanks = np.array([len(_BLANK.findall(t)) for t in texts], np.int64)
    rank, letters, per_sentence, commas, owner = [], [], [], [], []
    for k, t in enumerate(texts):
        for s in _SENTENCE.split(t.lower()):
            ws = _WORD.findall(s)
            if ws:
                rank += [ranks.get(w, size) for w in ws]
                letters += [min(len(w), LETTERS) for w in ws]
                per_sentence.append(len(ws))
                commas.append(s.count(","))
                owner.append(k)
    if not owner:
        return out, blanks
    n = np.array(per_sentence)
    start = np.r_[0, np.cumsum(n)[:-1]]
    sentence = np.repeat(np.arange(len(n)), n)
    values = {
        "coverage": _quantile(sentence, np.log(np.array(rank, float)), np.ones(len(rank)), SHARE, len(n)),
        "length": np.log(n),
        "letters": np.add.reduceat(np.array(letters, float), start) / n,
        "clauses": np.array(commas, float),
    }
    docs, group = np.unique(np.array(owner), return_inverse=True)
    out[docs, 0] = _quantile(np.repeat(group, n), np.log(np.array(rank, float)), np.ones(len(rank)), SHARE, len(docs))
    for j, (m, q) in enumerate(((m, q) for m in MEASURES for q in QUARTILES), 1):
        out[docs, j] = _quantile(group, values[m], np.minimum(n, WEIGHT), q, len(docs))
    return out, blanks


def _features(broadcast, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = broadcast.value
        for whole in batches:
            for b in _parts(whole):
                f, words = measure([x or "" for x in b.column("text").to_pylist()], ranks, size)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(words), *(pa.array(c, pa.float64(), from_pandas=True) for c in f.T)], ["key", "n_words", *FEATURES])

    return run


def document_measures(df: DataFrame, key: str, text: str, size: int = VOCABULARY) -> DataFrame:
    """(key, n_words, one column per feature): null features for texts without a word. One row per row of `df`."""
    ranks = df.sparkSession.sparkContext.broadcast(ranked_vocabulary(df, text, size))
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n_words", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES]])
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_features(ranks, size), schema)


def _terms(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    return np.hstack([np.ones((len(x), 1)), x, *(x[:, [i]] * x[:, i:] for i in range(n))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_borders(x: np.ndarray, level: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(mean, spread, coefficients per border): a row is above border k if its terms times the coefficients exceed 0."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    t = _terms((x - mean) / spread)
    borders = []
    for k in range(1, levels):
        y = (level > k + 0.5).astype(float)
        w = _logistic(t, y)
        # judgements that the rest contradicts strongly are slips of the readers
        sure = np.abs(t @ w) > 3
        keep = ~(sure & ((t @ w > 0) != (y > 0)))
        borders.append(_logistic(t[keep], y[keep]) if 0 < y[keep].sum() < keep.sum() else w)
    return mean, spread, borders


def _expression(w: np.ndarray) -> Column:
    """The terms of the scaled features times the coefficients."""
    n, at = len(FEATURES), 1 + len(FEATURES)
    parts = [f"{float(w[0])!r}D"]
    for i, f in enumerate(FEATURES):
        inner = [f"{float(w[1 + i])!r}D"] + [f"{float(w[at + j - i])!r}D * `{FEATURES[j]}`" for j in range(i, n)]
        parts.append(f"`{f}` * ({' + '.join(inner)})")
        at += n - i
    return F.expr(" + ".join(parts))


def reading_levels(df: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, levels: int = 4, labelled: int = LABELLED) -> DataFrame:
    """(key, n_words, level, border_1.. border_n): the reading level of every row, and its distance above each border or
    any higher one, so that the level is one more than the number of borders with a distance above 0.

    Several judgements of a document count with their mean; null labels and labels of unknown documents take no part.
    Texts without a word, null ones included, have a null level; with no usable label every level is null. Keys may
    repeat or be null; an empty table gives no rows; other columns are ignored; whole texts are measured.
    """
    measured = cut(document_measures(df, key, text))
    judged = labels.select(F.col(label_key).alias("key"), F.col(label).cast("double").alias("y")).dropna().groupBy("key").agg(F.avg("y").alias("y"))
    sample = measured.where(F.col(FEATURES[0]).isNotNull()).join(judged, "key").orderBy(F.xxhash64("key")).limit(labelled)
    rows = np.array([list(r) for r in sample.select("y", *FEATURES).collect()], float).reshape(-1, 1 + len(FEATURES))
    names = [f"border_{k}" for k in range(1, levels)]
    if len(rows) < 10:
        out = measured.select("*", *[F.lit(None).cast("double").alias(b) for b in names])
    else:
        mean, spread, borders = fit_borders(rows[:, 1:], rows[:, 0], levels)
        scaled = measured.select("key", "n_words", *[((F.col(f) - float(m)) / float(d)).alias(f) for f, m, d in zip(FEATURES, mean, spread, strict=True)])
        # written once: the borders are read several times below, and their terms would be put in wherever they are
        out = cut(scaled.select("key", "n_words", *[_expression(w).alias(b) for b, w in zip(names, borders, strict=True)]))
    out = out.withColumns({b: F.greatest(*names[k:]) for k, b in enumerate(names[:-1])})
    above = [F.when(F.col(b) > 0, 1).when(F.col(b) <= 0, 0) for b in names]
    return out.select(F.col("key").alias(key), "n_words", (sum(above[1:], above[0]) + 1).alias("level"), *names)
