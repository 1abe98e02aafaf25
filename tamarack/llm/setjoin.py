"""All pairs of records whose value sets overlap above a threshold, by a size-aware overlap join.

Equal sets are joined once, as a class with a representative. Small sets are keyed by their subsets of the size of the
overlap that a partner needs: two small sets that are similar enough share such a subset. Large sets scan the inverted
lists of the rare values of all sets. What is shuffled by key is a set's number, size and position; the sets themselves
come in once sizes and positions have ruled out what cannot be similar enough. Keys with long lists are met in parts.
The union of both candidate lists is filtered by the exact similarity.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.runtime import cut, salted_pairs, small

#: Subsets that one small set may be keyed by; larger sets go through the inverted lists.
SUBSETS = 40


def _up(x: float) -> int:
    return ceil(x - 1e-9)


def needed(s: int, t: int, threshold: float) -> int:
    """Least number of common values of sets of `s` and `t` values whose Jaccard similarity reaches the threshold."""
    return max(1, _up(threshold / (1 + threshold) * (s + t)))


def subset_plan(threshold: float, min_size: int, budget: int = SUBSETS) -> tuple[int, dict[int, list[int]]]:
    """Largest small size, and for each small size the subset sizes under which it must be keyed."""

    def plan(top: int) -> dict[int, list[int]]:
        sizes = range(min_size, top + 1)
        return {s: sorted({needed(s, t, threshold) for t in sizes if min(s, t) >= threshold * max(s, t) - 1e-9}) for s in sizes}

    top = min_size - 1
    while all(sum(comb(s, c) for c in cs) <= budget for s, cs in plan(top + 1).items()) and top < min_size + 32:
        top += 1
    return top, plan(top)


def set_classes(df: DataFrame, record: str, value: str, min_size: int) -> tuple[DataFrame, DataFrame]:
    """(classes: rep, tokens rarest first; members: id, rep of the classes with more than one record)."""
    el = df.select(F.col(record).alias("id"), F.col(value).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).distinct()
    el = cut(el)
    part = el.groupBy("id").agg(F.count(F.lit(1)).alias("s")).where(F.col("s") >= max(1, min_size))
    el = cut(el.join(part.select("id"), "id"))
    freq = cut(el.groupBy("v").agg(F.count(F.lit(1)).alias("f")))
    tokens = F.transform(F.sort_array(F.collect_list(F.struct("f", "v"))), lambda x: x["v"])
    sets = cut(el.join(small(freq), "v").groupBy("id").agg(tokens.alias("tokens")))
    classes = cut(sets.groupBy("tokens").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    copied = classes.where("n > 1").select("tokens", "rep")
    return classes.select("rep", "tokens"), sets.join(copied, "tokens").select("id", "rep")


def similar_classes(classes: DataFrame, threshold: float, min_size: int, subsets: int = SUBSETS) -> DataFrame:
    """Pairs (rep_a < rep_b, overlap, similarity) of the classes of `set_classes`."""
    top, plan = subset_plan(threshold, max(1, min_size), subsets)
    sized = classes.withColumn("s", F.size("tokens"))
    keys = None
    for s, cs in plan.items():
        picks = [p for c in cs for p in combinations(range(s), c)]
        # one hash per subset; the subset's size is part of what is hashed
        literal = F.array(*[F.array(*[F.lit(i) for i in p]) for p in picks])
        hashes = F.transform(literal, lambda p: F.xxhash64(F.size(p), F.transform(p, lambda i: F.get("tokens", i))))
        part = sized.where(F.col("s") == s).select("rep", "s", F.explode(hashes).alias("key"))
        keys = part if keys is None else keys.unionByName(part)
    fits = lambda a, b: F.least(a, b) >= F.lit(threshold - 1e-9) * F.greatest(a, b)
    sides = lambda df, key, *more: [df.select(key, F.col("rep").alias(x), F.col("s").alias(f"s{x}"), *[F.col(c).alias(f"{c}{x}") for c in more]) for x in "ab"]
    found = []
    if keys is not None:
        keys = cut(keys)
        a, b = sides(keys, "key")
        found.append(salted_pairs(a, b, "key", "b").where((F.col("a") < F.col("b")) & fits(F.col("sa"), F.col("sb"))).select("a", "b", "sa", "sb"))
    # ceil(threshold * s) values are common at least, so one of the first s - that + 1 is
    prefix = F.col("s") - F.ceil(F.lit(threshold - 1e-9) * F.col("s")).cast("int") + 1
    lists = cut(sized.select("rep", "s", F.posexplode(F.slice("tokens", F.lit(1), prefix)).alias("pos", "v")))
    a, b = sides(lists, "v", "pos")
    once = (F.col("sb") <= top) | (F.col("a") < F.col("b"))
    room = 1 + F.least(F.col("sa") - F.col("posa") - 1, F.col("sb") - F.col("posb") - 1)
    enough = room >= F.lit(threshold / (1 + threshold) - 1e-9) * (F.col("sa") + F.col("sb"))
    met = salted_pairs(a.where(F.col("sa") > top), b, "v", "b").where(once & fits(F.col("sa"), F.col("sb")) & enough)
    found.append(met.select("a", "b", "sa", "sb"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    # the same two sets meet under many keys: once is enough to compare them
    pairs = pairs.distinct()
    tokens = lambda x: classes.select(F.col("rep").alias(x), F.col("tokens").alias(f"t{x}"))
    pairs = pairs.join(tokens("a"), "a").join(tokens("b"), "b").withColumn("overlap", F.size(F.array_intersect("ta", "tb")))
    pairs = pairs.withColumn("similarity", F.col("overlap") / (F.col("sa") + F.col("sb") - F.col("overlap"))).where(F.col("similarity") >= threshold - 1e-12)
    return pairs.select(F.least("a", "b").alias("rep_a"), F.greatest("a", "b").alias("rep_b"), "overlap", "similarity").distinct()


def similar_sets(df: DataFrame, record: str, value: str, threshold: float = 0.8, min_size: int = 1, subsets: int = SUBSETS) -> DataFrame:
    """Every pair of records whose sets of distinct non-null values have a Jaccard similarity of `threshold` or more.

    Result: id_a < id_b, similarity. Records with fewer than `min_size` values, null records and null values take no
    part; repeated rows count once; an empty table gives no rows; other columns are ignored. Records with equal sets
    are compared as one class and expanded at the end, so all their pairs come out.
    """
    classes, members = set_classes(df, record, value, min_size)
    pairs = similar_classes(classes, threshold, min_size, subsets)
    members = cut(members)
    every = classes.select("rep", F.col("rep").alias("id")).unionByName(members.where("id <> rep").select("rep", "id"))
    a = every.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    b = every.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = pairs.join(a, "rep_a").join(b, "rep_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    m, o = members.select("rep", F.col("id").alias("id_a")), members.select("rep", F.col("id").alias("id_b"))
    within = m.join(o, "rep").where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b", F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


def similar_links(df: DataFrame, record: str, value: str, threshold: float = 0.8, min_size: int = 1, subsets: int = SUBSETS) -> DataFrame:
    """(id, class_id, n_links) of every record that takes part: the class of equal sets it is in, named by its least
    record, and how many records it is similar to, those of its class included.

    What `similar_sets` says, without writing out the pairs that copies make: one row per record, whatever the classes' sizes.
    """
    classes, members = set_classes(df, record, value, min_size)
    members = cut(members)
    sizes = cut(classes.select("rep").join(members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")), "rep", "left").select("rep", F.coalesce("n", F.lit(1)).alias("n")))
    pairs = cut(similar_classes(classes, threshold, min_size, subsets))
    ways = pairs.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).unionByName(pairs.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))
    beyond = ways.join(sizes.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("n").alias("beyond"))
    told = sizes.join(beyond, "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    every = classes.select("rep", F.col("rep").alias("id")).unionByName(members.where("id <> rep").select("rep", "id"))
    return every.join(told, "rep").select("id", F.col("rep").alias("class_id"), "n_links")
