"""Similar sets, top N, items together: against brute force on small frames, with the awkward cases."""

import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from tamarack.llm import topn
from tamarack.llm.cooccur import pairs_together
from tamarack.llm.setjoin import needed, similar_sets, subset_plan
from tamarack.llm.topn import top_n


def brute_sets(rows, threshold, least):
    sets = {}
    for r, v in rows:
        if r is not None and v is not None:
            sets.setdefault(r, set()).add(v)
    sets = {k: v for k, v in sets.items() if len(v) >= least}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize(("threshold", "least", "seed"), [(0.6, 6, 1), (0.8, 1, 2), (0.5, 3, 3)])
def test_similar_sets(spark, threshold, least, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        base = rng.sample(range(30), rng.randint(1, 14))
        rows += [(i, v) for v in base]
        if rng.random() < 0.5:  # near copy
            rows += [(1000 + i, v) for v in base[: rng.randint(1, len(base))]] + [(1000 + i, rng.randint(0, 40))]
        if rng.random() < 0.2:  # exact copies, delivered twice
            rows += [(2000 + i, v) for v in base] * 2 + [(3000 + i, v) for v in base]
    rows += [(None, 1), (5, None)]
    df = spark.createDataFrame([(r, v, 0) for r, v in rows], "rec long, val int, rep int")
    got = {(r["id_a"], r["id_b"]) for r in similar_sets(df, "rec", "val", threshold, least).collect()}
    assert got == brute_sets(rows, threshold, least)


def test_similar_sets_empty_and_strings(spark):
    df = spark.createDataFrame([], "id string, v string")
    assert similar_sets(df, "id", "v").count() == 0
    df = spark.createDataFrame([("x", "p"), ("y", "p"), ("z", "q")], "id string, v string")
    assert [tuple(r) for r in similar_sets(df, "id", "v").collect()] == [("x", "y", 1.0)]


def test_needed_overlap():
    assert needed(6, 6, 0.6) == 5 and needed(6, 10, 0.6) == 6 and needed(10, 10, 0.6) == 8
    assert subset_plan(0.6, 6)[0] == 8


def test_top_n(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(1, 40), rng.choice([1.0, 2.0, 2.5, float("nan"), None])) for _ in range(800)]
    rows += [(None, 1, 5.0), (1, None, 5.0), (4, 7, 1.5), (4, 7, 3.0)]
    df = spark.createDataFrame(rows, "g long, i long, s double").withColumnRenamed("g", "bound").repartition(7)
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), -1), s)
    want = set()
    for g in {k[0] for k in best}:
        ranked = sorted((-s, i) for (h, i), s in best.items() if h == g)[:3]
        want |= {(g, i, -s, k) for k, (s, i) in enumerate(ranked, 1)}
    assert {tuple(r) for r in top_n(df, "bound", "i", "s", 3).collect()} == want
    assert {tuple(r) for r in top_n(df, "bound", "i", "s", 3, max_bounds=1).collect()} == want
    assert top_n(df.limit(0), "bound", "i", "s", 3).count() == 0


def test_top_n_of_partitions_beyond_the_buffer(monkeypatch):
    """What is held of earlier batches goes together with later ones."""
    monkeypatch.setattr(topn, "BUFFER_ROWS", 50)
    rng = random.Random(8)
    rows = [(rng.randint(1, 5), rng.randint(1, 9) / 2, rng.randint(1, 30)) for _ in range(700)]
    kinds = [pa.field("g", pa.int64(), nullable=False), pa.field("s", pa.float64()), pa.field("i", pa.int64())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 40], strict=True)], schema=pa.schema(kinds)) for k in range(0, 700, 40)]
    got = {(r["g"], r["s"], r["i"], r["seen"]) for b in topn._local_bounds(3)(iter(batches)) for r in b.to_pylist()}
    want = set()
    for g in range(1, 6):
        best = {}
        for h, s, i in rows:
            if h == g:
                best[i] = max(best.get(i, 0), s)
        s, i = sorted((-s, i) for i, s in best.items())[2]
        want.add((g, -s, i, sum(h == g for h, _, _ in rows)))
    assert got == want


def test_top_n_strings_and_dates(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 'x', 1), ('a', 'y', 1), ('a', 'z', 2), ('b', 'x', 0) AS t(g, i, s)")
    assert sorted(tuple(r) for r in top_n(df, "g", "i", "s", 2).collect()) == [("a", "x", 1, 2), ("a", "z", 2, 1), ("b", "x", 0, 1)]


def test_pairs_together(spark):
    rng = random.Random(5)
    rows = [(u, min(int(rng.expovariate(0.12)), 45)) for u in range(150) for _ in range(rng.randint(1, 12))]
    rows += [(900 + k, i) for k in range(3) for i in (1, 2, 3)] + rows[:40] + [(None, 3), (4, None)] + [(777, i) for i in range(46)]
    df = spark.createDataFrame(rows, "basket long, item long").withColumn("n", __import__("pyspark").sql.functions.lit(1))
    baskets = {}
    for u, i in rows:
        if u is not None and i is not None:
            baskets.setdefault(u, set()).add(i)
    n, one = len(baskets), Counter(i for b in baskets.values() for i in b)
    two = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    for least, lift in ((1, 0.0), (5, 1.2)):
        got = {(r["item_a"], r["item_b"]): r for r in pairs_together(df, "basket", "item", least, lift).collect()}
        assert set(got) == {p for p, c in two.items() if c >= least and c * n >= lift * one[p[0]] * one[p[1]]}
        for (a, b), r in got.items():
            assert (r["n_a"], r["n_b"], r["n_together"], r["n_baskets"]) == (one[a], one[b], two[a, b], n)
            assert r["lift"] == pytest.approx(two[a, b] * n / one[a] / one[b])
            miss = 1 - two[a, b] / one[a]
            assert r["conviction"] is None if miss == 0 else r["conviction"] == pytest.approx((1 - one[b] / n) / miss)
    assert pairs_together(df.limit(0), "basket", "item").count() == 0


def test_pairs_of_negative_and_large_ids(spark):
    df = spark.createDataFrame([(1, -5), (1, 1 << 40), (2, -5), (2, 1 << 40)], "basket long, item long")
    assert [(r["item_a"], r["item_b"], r["n_together"]) for r in pairs_together(df, "basket", "item").collect()] == [(-5, 1 << 40, 2)]
