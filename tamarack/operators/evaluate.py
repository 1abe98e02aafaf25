"""Evaluation of rankings: targets, positions, reciprocal ranks, hits, precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.similarity import token_set_ratio_col
from tamarack.functions.text import tokens
from tamarack.operators.bm25 import Bm25Index
from tamarack.runtime import cut, met_in_cells

#: Documents that a task holds, and cases, about, that it streams past them.
BLOCK, SLICE = 250_000, 100_000


def resolve_targets(cases: DataFrame, catalogue: DataFrame, fallback=token_set_ratio_col, cutoff: float = 80.0) -> DataFrame:
    """(case, id): the film of the case's year whose title holds the hint, the shortest title first; else the most similar.

    `cases` is (case, hint, year), `catalogue` (id, title, year). Cases without a target have no row.
    """
    # titles and hints that several rows share meet once; of equally long titles the least id counts, so it stands for all
    lowered = catalogue.withColumn("lower_title", F.lower(F.coalesce("title", F.lit(""))))
    titles = lowered.groupBy("year", "lower_title").agg(F.min("id").alias("id"))
    asked = cases.select("year", F.lower("hint").alias("lower_hint")).distinct()
    best = asked.join(titles, "year").where(F.contains("lower_title", "lower_hint")).groupBy("year", "lower_hint").agg(F.min(F.struct(F.length("lower_title").alias("n"), "id")).alias("best"))
    first = cases.withColumn("lower_hint", F.lower("hint")).join(best, ["year", "lower_hint"]).select("case", F.col("best.id").alias("id"))
    if fallback is None:
        return first
    pairs = cases.withColumn("lower_hint", F.lower("hint")).join(lowered, "year")
    rest = pairs.join(first.select("case"), "case", "left_anti").withColumn("s", fallback(F.col("lower_hint"), F.col("lower_title"))).where(F.col("s") >= cutoff)
    v = Window.partitionBy("case").orderBy(F.desc("s"), "id")
    return first.unionByName(rest.withColumn("rn", F.row_number().over(v)).where("rn = 1").select("case", "id"))


def positions(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """(case, id, position): where each target stands among the scores (case, id, score); by counting, without a sort."""
    goal = targets.join(scores, ["case", "id"]).select("case", F.col("id").alias("goal"), F.col("score").alias("goal_score"))
    ahead = scores.join(goal, "case").where((F.col("score") > F.col("goal_score")) | ((F.col("score") == F.col("goal_score")) & (F.col("id") < F.col("goal"))))
    n = ahead.groupBy("case").agg(F.count(F.lit(1)).alias("n"))
    return goal.join(n, "case", "left").select("case", F.col("goal").alias("id"), (F.coalesce("n", F.lit(0)) + 1).alias("position"))


class _Titles:
    """Documents of one cell: equal ones are one, with all their ids; postings by term and by document."""

    def __init__(self, held: pa.Table):
        ids = held.column("id").to_numpy()
        lists = [held.column(c).combine_chunks() for c in ("terms", "weights")]
        at = lists[0].offsets.to_numpy().astype(np.int64)
        terms, weights = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        at = at - at[0]
        seen: dict[tuple[bytes, bytes], int] = {}
        kind = np.array([seen.setdefault((terms[a:b].tobytes(), weights[a:b].tobytes()), len(seen)) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
        order = np.lexsort((ids, kind))
        self.ids, self.at = ids[order], np.searchsorted(kind[order], np.arange(len(seen) + 1))
        one = order[self.at[:-1]]  # stands for its kind
        sizes = np.diff(at)[one]
        self.first = np.r_[0, np.cumsum(sizes)]
        flat = _spans(at[one], sizes)
        self.known, self.term = np.unique(terms[flat], return_inverse=True)
        self.weight, owner = weights[flat], np.repeat(np.arange(len(one)), sizes)
        by_term = np.argsort(self.term, kind="stable")
        self.starts = np.searchsorted(self.term[by_term], np.arange(len(self.known) + 1))
        self.owner, self.held = owner[by_term], self.weight[by_term]
        self.most = np.maximum.reduceat(self.held, self.starts[:-1])
        self.rest = np.zeros(len(self.known))

    def ahead(self, terms: np.ndarray, goal: int, score: float) -> int:
        """How many documents score more, to six places, than `score`, or the same with an id less than `goal`.

        A document that has none of the terms beyond which the others cannot reach the score is not met.
        """
        at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        at = at[self.known[at] == terms]
        at = at[np.argsort(self.most[at])]
        need = np.searchsorted(np.cumsum(self.most[at]), score - 2e-6)
        weak, strong = at[:need], at[need:]
        if not len(strong):
            return 0
        n = self.starts[strong + 1] - self.starts[strong]
        index = _spans(self.starts[strong], n)
        met, back = np.unique(self.owner[index], return_inverse=True)
        total = np.bincount(back, self.held[index])
        keep = total + self.most[weak].sum() >= score - 2e-6
        met, total = met[keep], total[keep]
        if len(weak) and len(met):
            self.rest[weak] = 1.0
            n = self.first[met + 1] - self.first[met]
            index = _spans(self.first[met], n)
            total = total + np.add.reduceat(self.rest[self.term[index]] * self.weight[index], np.r_[0, np.cumsum(n)[:-1]])
            self.rest[weak] = 0.0
        places, want = np.floor(total * 1e6 + 0.5), np.floor(score * 1e6 + 0.5)
        n = self.at[met + 1] - self.at[met]
        same = places == want
        return int(n[places > want].sum()) + int((self.ids[_spans(self.at[met[same]], n[same])] < goal).sum())


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each first on, so many of each."""
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]][: len(n)], n) + np.arange(n.sum())


def _ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, block = [], None
    for b in batches:
        n = int(np.searchsorted(b.column("asked").to_numpy(zero_copy_only=False), True))
        if n:
            parts.append(b.slice(0, n))
        b = b.slice(n)
        if not b.num_rows or not parts:
            continue
        block = block or _Titles(pa.Table.from_batches(parts))
        parts = [parts[0]]
        at, terms = b.column("terms").offsets.to_numpy(), b.column("terms").values.to_numpy(zero_copy_only=False)
        counts = [block.ahead(terms[x:y], g, s) for x, y, g, s in zip(at[:-1], at[1:], b.column("goal").to_pylist(), b.column("score").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("number"), pa.array(counts, pa.int64())], ["number", "n"])


def lexical_positions(index: Bm25Index, cases: DataFrame, key: str, text: str, targets: DataFrame) -> DataFrame:
    """(case, id, position) as `positions` gives them of the scores `index.batch` to six places, which are never written.

    Documents and cases meet in cells; of each case only those documents are met that may stand ahead of its target.
    Targets (case, id) have whole numbers as ids; those that share no term with their case have no position.
    """
    numbers = index.terms.select("term", F.xxhash64("term").alias("t"), "idf")
    parts = index.rows.join(numbers, "term").select("id", "t", index.part().alias("w"))
    docs = parts.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("x")).select("id", F.col("x.t").alias("terms"), F.col("x.w").alias("weights"))
    asked = cases.select(F.col(key).alias("case"), F.transform(F.array_distinct(tokens(F.col(text))), lambda x: F.xxhash64(x)).alias("terms"))
    wanted = targets.join(asked, "case")
    score = wanted.select("case", "id", F.explode("terms").alias("t")).join(parts, ["id", "t"]).groupBy("case", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    goals = cut(wanted.join(score, ["case", "id"]).select("case", F.col("id").alias("goal"), "terms", "score").withColumn("number", F.monotonically_increasing_id()))
    # equal documents come into one cell
    cells = met_in_cells(cut(docs), goals.select("number", "goal", "terms", "score"), "terms", "number", BLOCK, SLICE)
    columns = cells.select("id", "terms", "weights", "number", F.col("goal").cast("long").alias("goal"), "score", "asked")
    n = columns.mapInArrow(_ahead, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    return goals.join(n, "number").select("case", F.col("goal").alias("id"), (F.col("n") + 1).alias("position"))


def ranking_metrics(cases: DataFrame, found: DataFrame) -> DataFrame:
    """One row (n, resolved, mrr, hits_1, hits_3, hits_10, median, mean); the mean reciprocal rank is over all cases."""
    joined = cases.select("case").join(found.select("case", "position"), "case", "left")
    p = F.col("position")
    return joined.agg(
        F.count(F.lit(1)).alias("n"), F.count(p).alias("resolved"), F.round(F.coalesce(F.sum(1 / p), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("mrr"),
        *[F.count_if(p <= k).alias(f"hits_{k}") for k in (1, 3, 10)], F.floor(F.median(p)).cast("int").alias("median"), F.round(F.avg(p), 1).alias("mean"),
    )


def worst(found: DataFrame, beyond: int = 10, n: int = 8) -> DataFrame:
    return found.where(F.col("position") > beyond).orderBy(F.desc("position"), "case").limit(n)


def precision_at(recommended: DataFrame, genres: DataFrame, k: int) -> DataFrame:
    """One row (k, precision): share of the first k recommendations (src, dst, rank) with a genre in common; always of k."""
    first = recommended.where(F.col("rank") <= k)
    shared = first.join(genres.select(F.col("id").alias("src"), "genre"), "src").join(genres.select(F.col("id").alias("dst"), "genre"), ["dst", "genre"]).select("src", "dst").distinct()
    n = first.select("src").distinct().agg(F.count(F.lit(1)).alias("n"))
    return shared.agg(F.count(F.lit(1)).alias("hits")).crossJoin(n).select(F.lit(k).alias("k"), (F.col("hits") / (F.col("n") * k)).alias("precision"))


def reciprocal(position: Column) -> Column:
    return 1 / position
