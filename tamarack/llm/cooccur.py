"""Items that appear together: pair counts over baskets, with lift and conviction.

Baskets are deduplicated, stripped of items that cannot reach a threshold, and collapsed: equal item arrays become
one array with a weight, so pairs are enumerated once per distinct basket. Items are numbered from the rarest to the
most frequent one, so an array is one of small sorted numbers, and each pair belongs to its rarer item, so a very frequent item owns few pairs. The items are
spread over blocks; a block gets of each basket only the part from its first own item on, counts its pairs in flat
arrays with numpy, and lets only supported pairs out. No pair is shuffled before it is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.operators.fusion import with_position
from tamarack.runtime import cores, cut, small

#: Pairs with repeats that one block counts; sets how many blocks there are.
PAIRS_PER_BLOCK = 4_000_000
#: Pairs that are held before they are merged into the counts so far.
CHUNK = 2_000_000


def _block_of(items: np.ndarray, blocks: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def _spread(blocks: int):
    """(items, weight) -> (block, items from the block's first own item on, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("items")
            flat = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(sizes)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            own = _block_of(flat, blocks)
            keep = np.ones(len(flat), bool)
            keep[ends[sizes > 0] - 1] = False  # the last item of a basket owns no pair
            at = np.flatnonzero(keep)
            key = rows[at] * blocks + own[at]
            _, first = np.unique(key, return_index=True)
            at = at[first]
            row, block = rows[at], own[at]
            length = ends[row] - at
            weight = b.column("weight").to_numpy()[row]
            total, lo = np.cumsum(length), 0
            while lo < len(at):  # parts of bounded size, whatever the baskets' lengths
                base = total[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(total, base + CHUNK, "right")))
                n = length[lo:hi]
                index = np.repeat(at[lo:hi] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                items = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat[index]))
                yield pa.RecordBatch.from_arrays([pa.array(block[lo:hi].astype(np.int32)), items, pa.array(weight[lo:hi])], ["block", "items", "weight"])
                lo = hi

    return run


def _count(blocks: int, least: int):
    """Pairs of a block's own items with the items after them, summed over (block, items, weight); those with `least` baskets."""

    def pairs(flat, sizes, weight, block):
        """Chunks (rarer item, other item, weight), cut so that memory stays bounded for baskets of any length."""
        ends = np.repeat(np.cumsum(sizes), sizes)
        at = np.flatnonzero(_block_of(flat, blocks) == np.repeat(block, sizes))
        n = ends[at] - at - 1
        w = np.repeat(weight, sizes)[at]
        lo, total = 0, np.cumsum(n)
        while lo < len(at):
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + CHUNK, "right")))
            k = n[lo:hi]
            start = np.r_[0, np.cumsum(k)[:-1]]
            other = np.repeat(at[lo:hi] + 1 - start, k) + np.arange(k.sum())
            yield np.repeat(flat[at[lo:hi]], k), flat[other], np.repeat(w[lo:hi], k)
            lo = hi

    def compact(parts):
        a, b, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        # numbers fit in 31 bits, so one machine word holds both; the rarer item of a pair has the lower one
        code = (a.astype(np.int64) << np.int64(31)) | b.astype(np.int64)
        order = np.argsort(code, kind="stable")
        code, w = code[order], w[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        code = code[first]
        return code >> np.int64(31), code & np.int64((1 << 31) - 1), np.add.reduceat(w, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one block per task; were there more, a pair would still lie in one of them, so one set of counts serves all
        held, rows = [], 0
        done = None
        for batch in batches:
            lists = batch.column("items")
            flat = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            for part in pairs(flat, sizes, batch.column("weight").to_numpy(), batch.column("block").to_numpy()):
                held.append(part)
                rows += len(part[0])
                if rows >= CHUNK + (len(done[0]) if done is not None else 0):
                    done = compact(held + ([done] if done is not None else []))
                    held, rows = [], 0
        if held:
            done = compact(held + ([done] if done is not None else []))
        if done is None:
            return
        keep = done[2] >= least
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in done], ["a", "b", "n"])

    return run


def pairs_together(df: DataFrame, basket: str, item: str, min_together: int = 1, min_lift: float = 0.0) -> DataFrame:
    """How often two items share a basket, and how much more often than chance.

    Result: item_a < item_b (LONG), n_a, n_b, n_together (distinct baskets), n_baskets, lift, conviction (of a => b; null
    where b is in every basket with a). Pairs with n_together >= `min_together` and lift >= `min_lift`. The item must be
    of an integer type. Rows with a null basket or item take no part, repeated rows count once; an empty table gives
    no rows; other columns are ignored.
    """
    least = max(1, min_together)
    d = cut(df.select(F.col(basket).alias("u"), F.col(item).cast("long").alias("i")).where(F.col("u").isNotNull() & F.col("i").isNotNull()).distinct())
    total = d.select("u").distinct().count()
    # lift >= L needs n_b <= N / L, as n_together <= n_a; both follow from the thresholds, so nothing is lost
    counts = d.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    if min_lift > 0:
        counts = counts.where(F.col("n") * F.lit(float(min_lift)) <= F.lit(float(total)))
    # numbered rarest first; the item breaks ties
    counts = cut(with_position(counts, F.asc("n"), F.asc("i")).select("i", "n", (F.col("position") - 1).cast("int").alias("k")))
    kept = d.join(small(counts.select("i", "k")), "i")
    baskets = kept.groupBy("u").agg(F.sort_array(F.collect_list("k")).alias("items")).where(F.size("items") > 1)
    weighted = cut(baskets.groupBy("items").agg(F.count(F.lit(1)).alias("weight")))
    work = weighted.agg(F.sum(F.size("items").cast("double") * (F.size("items") - 1) / 2)).first()[0] or 0.0
    blocks = int(max(2 * cores(df.sparkSession), -(-work // PAIRS_PER_BLOCK)))
    spread = weighted.mapInArrow(_spread(blocks), "block int, items array<int>, weight long")
    found = spread.repartitionById(blocks, "block").mapInArrow(_count(blocks, least), "a long, b long, n long")
    side = lambda c: counts.select(F.col("k").cast("long").alias(c), F.struct("i", "n").alias(f"x{c}"))
    both = found.join(small(side("a")), "a").join(small(side("b")), "b").select("n", F.least("xa", "xb").alias("x"), F.greatest("xa", "xb").alias("y"))
    out = both.select("n", F.col("x.i").alias("a"), F.col("x.n").alias("n_a"), F.col("y.i").alias("b"), F.col("y.n").alias("n_b"), F.lit(total).cast("long").alias("n_baskets"))
    # the ratio of whole numbers is compared, so a lift of exactly the threshold is kept
    exact = F.col("n").cast("double") * F.col("n_baskets") >= F.lit(float(min_lift)) * F.col("n_a").cast("double") * F.col("n_b")
    lift = F.col("n").cast("double") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    miss = 1 - F.col("n") / F.col("n_a")
    conviction = F.when(miss > 0, (1 - F.col("n_b") / F.col("n_baskets")) / miss)
    return out.where(exact).select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_a", "n_b", F.col("n").alias("n_together"), "n_baskets", lift.alias("lift"), conviction.alias("conviction"))
