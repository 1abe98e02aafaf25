"""Filling containers of fixed capacity with items, by pattern packing with non-negative least squares.

Only the histogram of sizes reaches the driver: at most `capacity` numbers, however many items there are. Patterns of
few different lengths that fill a container exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what remains is packed best-fit, still by histogram. The plan is then
applied to the items by their rank within their size, which is counted without gathering a size in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.runtime import cut, small

#: Items of one size that one task numbers.
ROWS_PER_SALT = 500_000
Pattern = tuple[tuple[int, int], ...]  # ((length, times), ...)


def enumerate_patterns(lengths: np.ndarray, capacity: int, splits: int = 4) -> list[Pattern]:
    """Patterns of at most three different lengths, all among `lengths`, that fill `capacity` exactly."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    found: set[Pattern] = set()

    def add(parts: list[tuple[int, int]]) -> None:
        total: dict[int, int] = {}
        for length, times in parts:
            total[length] = total.get(length, 0) + times
        found.add(tuple(sorted(total.items(), reverse=True)))

    have = np.flatnonzero(present)
    for a in have[have > 0].tolist():
        for m in range(1, capacity // a + 1):
            rest = capacity - m * a
            if rest == 0:
                add([(a, m)])
                continue
            for m2 in range(1, splits + 1):  # the rest by one more length, once or several times
                if rest % m2 == 0 and present[rest // m2]:
                    add([(a, m), (rest // m2, m2)])
            below = have[(have > 0) & (have < rest)]
            if len(below):  # or by two lengths, spread over the range
                step = max(1, len(below) // splits)
                for b in below[m % step :: step][:splits].tolist():
                    if present[rest - b]:
                        add([(a, m), (b, 1), (rest - b, 1)])
    return sorted(found)


def fit_counts(patterns: list[Pattern], histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, A having a column per pattern; accelerated projected gradient."""
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([length for p in patterns for length, _ in p])
    val = np.array([times for p in patterns for _, times in p], float)
    scale = np.sqrt(np.bincount(col, val**2, len(patterns)))  # unit columns
    val = val / scale[col]
    n = len(histogram)
    forward = lambda x: np.bincount(row, val * x[col], n)
    back = lambda r: np.bincount(col, val * r[row], len(patterns))
    v = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue of A'A
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top or 1
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - histogram) / (top * 1.02 or 1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x / scale


def pack_rest(left: np.ndarray, capacity: int) -> list[tuple[int, Pattern]]:
    """Best fit, longest first, of `left` items per size; containers alike are handled as one group."""
    groups: dict[int, dict[tuple, int]] = {}  # free space -> {((length, times), ...): containers}
    for size in range(capacity, 0, -1):
        todo = int(left[size])
        moved: list[tuple[int, tuple, int]] = []

        def fill(count: int, each: int, free: int, held: tuple) -> int:
            """Put `todo` items, `each` per container, into at most `count` containers; how many containers took some."""
            nonlocal todo
            whole = min(count, todo // each)
            rest = todo - whole * each if whole < count and todo - whole * each < each else 0
            for containers, times in ((whole, each), (1 if rest else 0, rest)):
                if containers:
                    moved.append((free - times * size, (*held, (size, times)), containers))
            todo -= whole * each + rest
            return whole + (1 if rest else 0)

        for free in sorted(f for f in groups if f >= size):
            if not todo:
                break
            same = groups[free]
            for held in list(same):
                if not todo:
                    break
                taken = fill(same[held], free // size, free, held)
                same[held] -= taken
                if not same[held]:
                    del same[held]
            if not same:
                del groups[free]
        if todo:
            fill(-(-todo // (capacity // size)), capacity // size, capacity, ())
        for free, held, containers in moved:
            same = groups.setdefault(free, {})
            same[held] = same.get(held, 0) + containers
    return [(count, held) for same in groups.values() for held, count in same.items()]


def plan_containers(histogram: np.ndarray, capacity: int) -> list[tuple[int, Pattern]]:
    """[(number of containers, pattern)] that together hold exactly the items of `histogram` (index = size)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[int, Pattern]] = []
    full = int(left[capacity])
    if full:
        plan.append((full, ((capacity, 1),)))
        left[capacity] = 0
    patterns = enumerate_patterns(np.flatnonzero(left), capacity)
    if patterns:
        x = np.floor(fit_counts(patterns, left.astype(float)) + 1e-6)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            times = int(min(x[k], *(left[length] // m for length, m in patterns[k])))
            if times:
                plan.append((times, patterns[k]))
                for length, m in patterns[k]:
                    left[length] -= times * m
    return plan + pack_rest(left, capacity)


def _segments(plan: list[tuple[int, Pattern]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size: (first rank, first container, items per container) of its segments."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for count, pattern in plan:
        for length, times in pattern:
            by.setdefault(length, []).append((used.get(length, 0), base, times))
            used[length] = used.get(length, 0) + count * times
        base += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in by.items()}


def _assign(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = broadcast.value
        for b in batches:
            size, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            container = np.zeros(len(size), np.int64)
            for s in np.unique(size).tolist():
                at = np.flatnonzero(size == s)
                start, base, times = segments[s]
                k = np.searchsorted(start, rank[at], "right") - 1
                container[at] = base[k] + (rank[at] - start[k]) // times[k]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("piece"), b.column("size"), pa.array(container)], ["key", "piece", "size", "container"])

    return run


def fill_containers(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, n_tokens, container): the container of every item; containers never hold more than `capacity`.

    An item is cut only if it is larger than a container: into pieces 0, 1, ... that are full but for the last. Items of
    size 0, null or below take no room and stand in container 0. Keys should be unique; repeated rows are placed each
    by itself. An empty table gives no rows; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = df.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("total"))
    last = F.greatest(F.ceil(F.col("total") / capacity).cast("long") - 1, F.lit(0))
    pieces = rows.select("key", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    items = cut(pieces.select("key", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("int").alias("size")))
    salts = max(1, -(-items.count() // ROWS_PER_SALT))
    items = items.withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(salts)).cast("int"))
    counts = cut(items.where("size > 0").groupBy("size", "salt").agg(F.count(F.lit(1)).alias("c")))
    histogram = np.zeros(capacity + 1, np.int64)
    for s, c in counts.groupBy("size").agg(F.sum("c")).collect():  # at most `capacity` rows
        histogram[s] = c
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("size", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset")))
    within = Window.partitionBy("size", "salt").orderBy("key", "piece")
    ranked = items.where("size > 0").withColumn("rn", F.row_number().over(within)).join(small(offsets), ["size", "salt"])
    ranked = ranked.select("key", "piece", "size", (F.col("offset") + F.col("rn") - 1).alias("rank"))
    segments = df.sparkSession.sparkContext.broadcast(_segments(plan_containers(histogram, capacity)))
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("piece", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("container", T.LongType())])
    placed = ranked.mapInArrow(_assign(segments), schema)
    none = items.where("size = 0").select("key", "piece", "size", F.lit(0).cast("long").alias("container"))
    return placed.unionByName(none).select(F.col("key").alias(key), "piece", F.col("size").alias("n_tokens"), "container")
