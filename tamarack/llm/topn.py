"""Top N items within every group, by partition lower bounds.

Each partition's local N-th best row of a group is a bound that the group's N best rows reach. The best of these
bounds over all partitions drops most rows of large groups before anything is shuffled; the survivors are deduplicated
and ranked. Bounds are optional for correctness, so the ones of the groups with the most rows, at most `max_bounds`,
are broadcast and smaller groups simply keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.runtime import cut

MAX_BOUNDS = 500_000
BUFFER_ROWS = 1 << 18
COLUMNS = ["g", "s", "i", "seen"]


def _local_bounds(n: int):
    """Arrow batches (g, s, i) -> rows (g, s, i, seen): the local n-th best distinct item and the rows counted."""

    def best(parts: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
        t = pa.concat_tables(parts).group_by(["g", "i"]).aggregate([("s", "max"), ("seen", "sum")])
        t = t.rename_columns(["g", "i", "s", "seen"]).select(COLUMNS).combine_chunks().sort_by([("g", "ascending"), ("s", "descending"), ("i", "ascending")])
        codes = t["g"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
        sizes = np.diff(np.r_[first, len(codes)])
        pos = np.arange(len(codes)) - np.repeat(first, sizes)
        if len(first):  # the rows seen so far stay on the first row of a group
            totals = np.add.reduceat(t["seen"].to_numpy(), first)
            seen = np.zeros(len(codes), np.int64)
            seen[first] = totals
            t = t.set_column(3, "seen", pa.array(seen))
        keep = pos < n
        return t.filter(pa.array(keep)), pos[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, pos = 0, np.zeros(0, int)
        for b in batches:
            # made from arrays, as what `best` gives is: tables are put together only if their schemas are equal
            held.append(pa.table([*(b.column(c) for c in COLUMNS[:3]), pa.array(np.ones(b.num_rows, np.int64))], names=COLUMNS))
            rows += b.num_rows
            if rows >= BUFFER_ROWS:
                t, pos = best(held)
                held, rows = [t], 0
        if not held:
            return
        t, pos = best(held)
        if not t.num_rows:
            return
        first = np.flatnonzero(pos == 0)
        seen = np.repeat(t["seen"].to_numpy()[first], np.diff(np.r_[first, len(pos)]))
        t = t.set_column(3, "seen", pa.array(seen)).filter(pa.array(pos == n - 1))
        yield from t.combine_chunks().to_batches()

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, max_bounds: int = MAX_BOUNDS) -> DataFrame:
    """The `n` best distinct items of every group: columns `group`, `item`, `score`, rank (1..n).

    An item counts once per group, with its highest score; order is score descending, item ascending, so ties always
    fall alike. Rows whose group, item or score is null or NaN take no part; groups with fewer items give fewer rows;
    an empty table gives none. Other columns are ignored, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be positive")
    kind = df.schema[score].dataType
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s"))
    ok = F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        ok = ok & ~F.isnan("s")
    rows = rows.where(ok)
    schema = T.StructType([T.StructField("g", df.schema[group].dataType), T.StructField("s", kind), T.StructField("i", df.schema[item].dataType), T.StructField("seen", T.LongType())])
    local = rows.select("g", "s", "i").mapInArrow(_local_bounds(n), schema)
    # best-first order is ascending (-s, i), so the least local bound is the tightest
    bounds = cut(local.groupBy("g").agg(F.min(F.struct((-F.col("s")).alias("neg"), "i")).alias("bound"), F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "g").limit(max_bounds))
    survivors = rows.join(F.broadcast(bounds.select("g", "bound")), "g", "left").where(F.col("bound").isNull() | (F.struct((-F.col("s")).alias("neg"), "i") <= F.col("bound")))
    best = survivors.groupBy("g", "i").agg(F.max("s").alias("s"))
    w = Window.partitionBy("g").orderBy(F.desc("s"), "i")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
