"""Collaborative filtering for all users at once: factor model, fold-in of unseen users, item neighbours, cascade."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions import vectors as vx
from tamarack.operators.dense import top_products
from tamarack.operators.fusion import with_position
from tamarack.runtime import cut, shared_dir, small

# Defaults of the factor model and of what is built on it.
FACTORS, EPOCHS, REGULARISATION, HOLDOUT, NEIGHBOURS, SEED = 50, 20, 0.02, 0.1, 50, 42
RIDGE, MIN_OVERLAP, BIAS_WEIGHT = 0.1, 2, 0.5
#: Rounds of alternating least squares; each solves exactly what an epoch of gradient steps only nears.
ROUNDS = 10
#: Ratings of one user, about, that one task sums up.
PART = 20_000


def clean_ratings(df: DataFrame, user: str, item: str, rating: str, low: float = 0.5, high: float = 5.0) -> DataFrame:
    """(user, item, rating): the mean of every pair's ratings within the scale; nulls and NaN take no part."""
    rows = df.select(F.col(user).alias("user"), F.col(item).alias("item"), F.col(rating).cast("double").alias("rating"))
    return rows.where(F.col("user").isNotNull() & F.col("item").isNotNull() & F.col("rating").between(low, high)).groupBy("user", "item").agg(F.avg("rating").alias("rating"))


def sample(df: DataFrame, n: int, seed: int = SEED, *keys: str) -> DataFrame:
    """Exactly n rows (all, if fewer), the same for the same seed: the least hashes of the keys."""
    return df.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))), *keys).limit(n)


def biases(ratings: DataFrame, damping_item: float = 10.0, damping_user: float = 15.0) -> tuple[float, DataFrame, DataFrame]:
    """(mean, item biases, user biases): damped means of what is left of the ratings, items first."""
    mu = ratings.agg(F.avg("rating")).first()[0] or 0.0
    bi = ratings.groupBy("item").agg((F.sum(F.col("rating") - mu) / (F.count(F.lit(1)) + damping_item)).alias("bi"))
    rest = ratings.join(bi, "item").withColumn("left", F.col("rating") - mu - F.col("bi"))
    bu = rest.groupBy("user").agg((F.sum("left") / (F.count(F.lit(1)) + damping_user)).alias("bu"))
    return mu, bi, bu


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """`df` with whole numbers from 0 without gaps in the order of `key`, as the factor model asks for ids that fit in an int."""
    return with_position(df, F.asc(key)).withColumn(name, F.when(F.col("position") <= 1 << 31, F.col("position") - 1).otherwise(F.raise_error(F.lit("more ids than an int holds"))).cast("int")).drop("position")


def train(ratings: DataFrame, factors: int = FACTORS, iterations: int = ROUNDS, regularisation: float = 0.1, seed: int = SEED) -> tuple[float, DataFrame, DataFrame]:
    """(mean, items (item, qi, bi), users (user, pu, bu)): alternating least squares on what damped biases leave.

    Ids of any kind are numbered without gaps first; ALS keeps its own blocks and spills. Factors are checkpointed in
    every round, after which what the round before shuffled is deleted.
    """
    from pyspark.ml.recommendation import ALS

    context = ratings.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # without one ALS cuts no lineage, and the shuffled factors of all rounds stay on disk
        context.setCheckpointDir(shared_dir(ratings.sparkSession))
    mu, bi, bu = biases(ratings)
    bi, bu = cut(numbered(bi, "item", "i")), cut(numbered(bu, "user", "u"))
    rest = ratings.join(bi, "item").join(bu, "user").select("u", "i", (F.col("rating") - mu - F.col("bi") - F.col("bu")).cast("float").alias("left"))
    model = ALS(rank=factors, maxIter=iterations, regParam=regularisation, userCol="u", itemCol="i", ratingCol="left", seed=seed, coldStartStrategy="nan", checkpointInterval=1).fit(cut(rest))
    items = bi.join(model.itemFactors.select(F.col("id").alias("i"), F.col("features").alias("qi")), "i", "left").select("item", "qi", "bi")
    users = bu.join(model.userFactors.select(F.col("id").alias("u"), F.col("features").alias("pu")), "u", "left").select("user", "pu", "bu")
    return mu, items, users


def evaluate(ratings: DataFrame, holdout: float = HOLDOUT, seed: int = SEED, **options) -> DataFrame:
    """One row (n, rmse, mae) of a model trained without a seeded share of the ratings, on that share."""
    marked = ratings.withColumn("__h", F.pmod(F.xxhash64("user", "item", F.lit(seed)), F.lit(1000)))
    kept = cut(marked.where(F.col("__h") >= holdout * 1000).drop("__h"))
    mu, items, users = train(kept, seed=seed, **options)
    test = marked.where(F.col("__h") < holdout * 1000).join(items, "item", "left").join(users, "user", "left")
    guess = mu + F.coalesce("bi", F.lit(0.0)) + F.coalesce("bu", F.lit(0.0)) + F.coalesce(vx.dot(F.col("qi"), F.col("pu")), F.lit(0.0))
    return errors(test.withColumn("predicted", F.greatest(F.lit(0.5), F.least(F.lit(5.0), guess))), "rating", "predicted")


def errors(df: DataFrame, rating: str, predicted: str) -> DataFrame:
    """One row (n, rmse, mae)."""
    e = F.col(predicted) - F.col(rating)
    return df.agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def fold_in(known: DataFrame, items: DataFrame, mu: float, ridge: float = RIDGE, part: int = PART) -> DataFrame:
    """(user, p): the factors of every user that explain the user's ratings best, by ridge regression.

    `known` is (user, item, rating), `items` (item, qi, bi). The normal equations of a user are sums over the ratings. A
    user's rows lie together, sorted, so a task holds one user at a time and writes the result at once. Users of more
    than `part` ratings, about, are summed in several parts, so that no task gets all rows of a hot user; only these few
    users' k x k sums are shuffled again.
    """
    rows = known.join(items.where(F.col("qi").isNotNull()), "item").select("user", vx.as_double(F.col("qi")).alias("q"), (F.col("rating") - mu - F.col("bi")).alias("y"))
    counts = known.groupBy("user").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part)
    hot = cut(counts.select("user", F.ceil(F.col("n") / part).cast("int").alias("parts")))
    rows = rows.join(small(hot), "user", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("q", "y"), F.col("parts"))).otherwise(F.lit(0)).cast("int"))
    placed = rows.repartition("user", "part").sortWithinPartitions("user", "part")
    users = T.StructField("user", known.schema["user"].dataType)
    doubles = T.ArrayType(T.DoubleType())

    def solved(gram: np.ndarray, rhs: np.ndarray) -> list[float]:
        return np.linalg.solve(gram + ridge * np.eye(len(rhs)), rhs).tolist()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gram, rhs, whole = None, None, None, True
        out: list[tuple] = []

        def done() -> None:
            if at is not None:
                # a whole user is solved here; parts of one are summed up behind
                out.append((at[0], solved(gram, rhs), None, None) if whole else (at[0], None, gram.ravel().tolist(), rhs.tolist()))

        def batch(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            lists = [pa.array(c, pa.list_(pa.float64())) for c in columns[1:]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *lists], ["user", "p", "gram", "rhs"])

        kind = None
        for b in batches:
            if not b.num_rows:
                continue
            kind = b.column("user").type
            q, y = np.array(b.column("q").to_pylist()), b.column("y").to_numpy()
            keys = list(zip(b.column("user").to_pylist(), b.column("part").to_pylist(), strict=True))
            split = b.column("parts").is_valid().to_pylist()
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                x, v = q[lo:hi], y[lo:hi]
                if keys[lo] == at:
                    gram, rhs = gram + x.T @ x, rhs + x.T @ v
                    continue
                done()
                at, gram, rhs, whole = keys[lo], x.T @ x, x.T @ v, not split[lo]
                if len(out) >= 500:
                    yield batch(kind)
        done()
        if out:
            yield batch(kind)

    made = cut(placed.mapInArrow(sums, T.StructType([users, *(T.StructField(c, doubles) for c in ("p", "gram", "rhs"))])))
    # element by element, partial sums first: no list of matrices is gathered
    parts = made.where("p IS NULL").select("user", F.posexplode(F.concat("gram", "rhs")).alias("pos", "x")).groupBy("user", "pos").agg(F.sum("x").alias("x"))
    total = parts.groupBy("user").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("sums"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s in b["sums"]:
                k = int((np.sqrt(4 * len(s) + 1) - 1) / 2)  # k * k + k numbers
                out.append(solved(np.array(s[: k * k]).reshape(k, k), np.array(s[k * k :])))
            yield pd.DataFrame({"user": b["user"], "p": out})

    return made.where("p IS NOT NULL").select("user", "p").unionByName(total.mapInPandas(solve, T.StructType([users, T.StructField("p", doubles)])))


def predicted(mu: float, bi, q, p):
    """The rating that is expected."""
    return F.lit(mu) + bi + vx.dot(q, p)


def rank_score(mu: float, bi, q, p, bias_weight: float = BIAS_WEIGHT):
    """What lists are ordered by: the item's bias counts less, so that taste counts more."""
    return F.lit(mu) + bias_weight * bi + vx.dot(q, p)


def neighbours(items: DataFrame, k: int = NEIGHBOURS, queries: DataFrame | None = None) -> DataFrame:
    """(src, dst, sim, rank): the k items (item, qi) of greatest cosine to each item, or to each of `queries`, itself
    excluded. Exact, in blocks; ties by id. Zero vectors have cosine 0."""
    unit = lambda df, name: df.where(F.col("qi").isNotNull()).select(F.col("item").alias(name), vx.unit(F.col("qi")).alias("v"))
    near = top_products(unit(queries if queries is not None else items, "l"), unit(items, "r").withColumn("bias", F.lit(0.0)), k, not_self=True)
    return near.select(F.col("l").alias("src"), F.col("r").alias("dst"), F.col("score").alias("sim"), "rank")


def item_item(known: DataFrame, near: DataFrame, mu: float) -> DataFrame:
    """(user, item, score): neighbours of the items that a user rated above the mean, weighted by how much."""
    liked = known.where(F.col("rating") > mu).select("user", F.col("item").alias("src"), (F.col("rating") - mu).alias("w"))
    return liked.join(near.where(F.col("sim") > 0).select("src", "dst", "sim"), "src").groupBy("user", F.col("dst").alias("item")).agg(F.sum(F.col("w") * F.col("sim")).alias("score"))


def strategies(users: DataFrame, known: DataFrame, items: DataFrame, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """(user, overlap, method): fold_in from `min_overlap` known items, item_item from one, else popularity."""
    overlap = known.join(items.select("item"), "item", "left_semi").groupBy("user").agg(F.countDistinct("item").alias("overlap"))
    out = users.select("user").distinct().join(overlap, "user", "left").select("user", F.coalesce("overlap", F.lit(0)).alias("overlap"))
    return out.withColumn("method", F.when(F.col("overlap") >= min_overlap, "fold_in").when(F.col("overlap") >= 1, "item_item").otherwise("popularity"))


def sought(known: DataFrame, items: DataFrame, mu: float) -> DataFrame:
    """The `items` whose neighbours `recommend` looks up: those that users of the item_item strategy rated above the mean."""
    users = strategies(known, known, items).where("method = 'item_item'")
    liked = known.where(F.col("rating") > mu).join(users, "user", "left_semi").select("item").distinct()
    return items.join(liked, "item", "left_semi")


def recommend(users: DataFrame, known: DataFrame, items: DataFrame, near: DataFrame, catalogue: DataFrame, mu: float, n: int = 20, exclude_rated: bool = True) -> DataFrame:
    """(user, item, score, predicted, method, rank): the n best items of every user by the user's strategy.

    Users stay distributed; each strategy is one branch of a union. `catalogue` is (item, popularity).
    """
    method = cut(strategies(users, known, items))
    by = lambda m: method.where(F.col("method") == m).select("user")
    factors = cut(fold_in(known.join(by("fold_in"), "user", "left_semi"), items, mu))
    seen = known.select(F.col("user").alias("l"), F.col("item").alias("r")).join(factors.select(F.col("user").alias("l")), "l", "left_semi") if exclude_rated else None
    best = top_products(factors.select(F.col("user").alias("l"), F.col("p").alias("v")), items.select(F.col("item").alias("r"), F.col("qi").alias("v"), (mu + BIAS_WEIGHT * F.col("bi")).alias("bias")), n, seen)
    best = best.select(F.col("l").alias("user"), F.col("r").alias("item"), "score")
    full = best.join(items.select("item", "bi"), "item").select("user", "item", "score", (F.col("score") + (1 - BIAS_WEIGHT) * F.col("bi")).alias("predicted"), F.lit("fold_in").alias("method"))
    second = item_item(known.join(by("item_item"), "user", "left_semi"), near, mu).select("user", "item", "score", F.lit(None).cast("double").alias("predicted"), F.lit("item_item").alias("method"))
    # users of this strategy know no item of the model, so n rows are enough
    most = catalogue.join(items.select("item"), "item", "left_semi").orderBy(F.desc(F.coalesce("popularity", F.lit(0.0))), "item").limit(n)
    third = by("popularity").crossJoin(F.broadcast(most)).select("user", "item", F.coalesce("popularity", F.lit(0.0)).alias("score"), F.lit(None).cast("double").alias("predicted"), F.lit("popularity").alias("method"))
    every = full.unionByName(second).unionByName(third)
    if exclude_rated:
        every = every.join(known.select("user", "item"), ["user", "item"], "left_anti")
    w = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def save(path: str, mu: float, items: DataFrame, near: DataFrame) -> None:
    items.write.mode("overwrite").parquet(f"{path}/items")
    near.write.mode("overwrite").parquet(f"{path}/neighbours")
    items.sparkSession.createDataFrame([(mu,)], "mu double").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark, path: str) -> tuple[float, DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/meta").first()["mu"], spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/neighbours")
