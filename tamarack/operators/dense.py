"""Best products of two sets of vectors, in cells of bounded size.

Rows of the right side are spread over blocks, rows of the left side over slices; a cell is a block and a slice. A task
holds the matrix of its block and streams its slice past it, a panel of the block at a time, keeping of every row its
best candidates only. Shuffled are right * slices + left * blocks rows and then left * blocks * k candidates, never all
pairs; exact. Memory is one block of vectors and one panel of products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions import vectors as vx
from tamarack.runtime import cores, cut

#: Vectors of the right side that a task holds, and rows of the left side, about, that one streams past them.
BLOCK, SLICE = 100_000, 100_000
#: Rows and columns of the products that are in memory at once.
PANEL = (1024, 8192)


def _matrix(rows: pa.RecordBatch | pa.Table, field: str = "v") -> np.ndarray:
    lists = rows.column(field)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _best(a: np.ndarray, c: np.ndarray, bias: np.ndarray, gone: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of c, score) of the k best of each row of a, all that tie with the last included; `gone` are pairs
    (row of a in order, row of c) that do not count."""
    least = np.full(len(a), -np.inf)
    found = []
    for lo in range(0, len(c), PANEL[1]):
        hi = min(lo + PANEL[1], len(c))
        s = a @ c[lo:hi].T + bias[lo:hi]
        inside = (gone[1] >= lo) & (gone[1] < hi)
        s[gone[0][inside], gone[1][inside] - lo] = -np.inf
        if hi - lo > k:  # the k-th best of a panel is a bound for the k-th best of all
            least = np.maximum(least, np.partition(s, hi - lo - k, axis=1)[:, hi - lo - k])
        x, y = np.nonzero((s >= least[:, None] - 1e-9) & np.isfinite(s))
        found.append((x, y + lo, s[x, y]))
    x, y, s = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    keep = s >= least[x] - 1e-9
    x, y, s = x[keep], y[keep], s[keep]
    order = np.lexsort((-s, x))
    x, y, s = x[order], y[order], s[order]
    first = np.searchsorted(x, np.arange(len(a)))
    last = np.minimum(first + k, np.searchsorted(x, np.arange(len(a)), "right")) - 1
    cut_at = np.where(last >= first, s[np.maximum(last, 0)], np.inf) if len(s) else np.full(len(a), np.inf)
    keep = s >= cut_at[x] - 1e-9
    return x[keep], y[keep], s[keep]


def _multiply(k: int, not_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, block = [], None
        for b in batches:
            n = int(np.searchsorted(b.column("asked").to_numpy(zero_copy_only=False), True))
            if n:
                parts.append(b.slice(0, n))
            b = b.slice(n)
            if not b.num_rows or not parts:
                continue
            if block is None:
                held = pa.Table.from_batches(parts)
                ids = held.column("r").combine_chunks()
                values = ids.to_numpy(zero_copy_only=False)
                order = np.argsort(values, kind="stable")
                block = (ids, values[order], order, _matrix(held), held.column("bias").to_numpy())
                parts = [parts[0].slice(0, 0)]
            ids, ordered, order, c, bias = block
            for lo in range(0, b.num_rows, PANEL[0]):
                part = b.slice(lo, PANEL[0])
                seen = part.column("seen")
                rows = np.repeat(np.arange(len(part)), np.diff(seen.offsets.to_numpy()))
                gone = seen.flatten().to_numpy(zero_copy_only=False)
                if not_self:
                    rows, gone = np.r_[rows, np.arange(len(part))], np.r_[gone, part.column("l").to_numpy(zero_copy_only=False)]
                at = np.minimum(np.searchsorted(ordered, gone), len(ordered) - 1)
                hit = ordered[at] == gone
                x, y, s = _best(_matrix(part), c, bias, (rows[hit], order[at[hit]]), k)
                yield pa.RecordBatch.from_arrays([part.column("l").take(pa.array(x)), ids.take(pa.array(y)), pa.array(s)], ["l", "r", "score"])

    return run


def top_products(left: DataFrame, right: DataFrame, k: int, exclude: DataFrame | None = None, not_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(l, r, score, rank): for every row of `left` (l, v) the k rows of `right` (r, v, bias) of greatest v.v + bias.

    `exclude` (l, r) names pairs that do not count, `not_self` leaves out pairs of equal ids. Equal scores (to nine
    places) by r. Rows with null ids or vectors take no part. Ids of a side are unique and of one type.
    """
    spark = left.sparkSession
    asked = left.where("l IS NOT NULL AND v IS NOT NULL").select("l", vx.as_double(F.col("v")).alias("v"))
    known = right.where("r IS NOT NULL AND v IS NOT NULL").select("r", vx.as_double(F.col("v")).alias("v"), F.coalesce("bias", F.lit(0.0)).cast("double").alias("bias"))
    asked, known = cut(asked), cut(known)
    n_known, n_asked = known.count(), asked.count()
    blocks, slices = max(1, -(-n_known // block)), max(1, -(-n_asked // SLICE))
    # cells enough for all cores: of the two sides the smaller one is repeated
    blocks, slices = (max(blocks, -(-cores(spark) // slices)), slices) if n_known > n_asked else (blocks, max(slices, -(-cores(spark) // blocks)))
    block_of, slice_of = (F.pmod(F.xxhash64(c, F.lit(n)), F.lit(n)).cast("int") for c, n in (("r", blocks), ("l", slices)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind_l, kind_r = left.schema["l"].dataType, right.schema["r"].dataType
    none = F.array().cast(T.ArrayType(kind_r))
    held = known.select("r", "v", "bias", block_of.alias("b"), every(slices).alias("s")).select("b", "s", "r", "v", "bias", F.lit(None).cast(kind_l).alias("l"), none.alias("seen"), F.lit(False).alias("asked"))
    rows = asked.select("l", "v", slice_of.alias("s"), every(blocks).alias("b"))
    if exclude is not None:
        # a list holds rows of one block, so its length is bounded by the block's
        seen = exclude.select("l", "r").distinct().join(known.select("r"), "r", "left_semi").groupBy("l", block_of.alias("b")).agg(F.collect_list("r").alias("seen"))
        rows = rows.join(seen, ["l", "b"], "left")
    else:
        rows = rows.withColumn("seen", none)
    rows = rows.select("b", "s", F.lit(None).cast(kind_r).alias("r"), "v", F.lit(0.0).alias("bias"), "l", F.coalesce("seen", none).alias("seen"), F.lit(True).alias("asked"))
    cells = held.unionByName(rows).withColumn("cell", F.col("s") * blocks + F.col("b")).repartitionById(slices * blocks, "cell").sortWithinPartitions("asked").select("r", "v", "bias", "l", "seen", "asked")
    schema = T.StructType([T.StructField("l", kind_l), T.StructField("r", kind_r), T.StructField("score", T.DoubleType())])
    near = cells.mapInArrow(_multiply(k, not_self), schema)
    w = Window.partitionBy("l").orderBy(F.desc(F.round("score", 9)), "r")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
