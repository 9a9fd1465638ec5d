"""Splits, shuffles, samples and rankings.

A shuffle is a contract, not a byte match: rows in the order of the seeded md5 of their key, ties by the key.  The two ways to
cut 80/10/10 differ where the row count is no multiple of ten; both are offered by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.functions.textfn import hash_order
from sparkcurate.operators.setops import numbered


def part(nth: Column, total: Column, how: str = "cutpoints", train: float = 0.8, valid: float = 0.1) -> Column:
    """The split of the nth row (from 1): by cut points int(.8 n) and int(.9 n), by sizes int(.8 n) and int(.1 n), or two parts."""
    if how == "two":
        return F.when(nth <= F.floor(total * F.lit(train)), "train").otherwise("valid")
    first = F.floor(total * F.lit(train))
    second = F.floor(total * F.lit(train + valid)) if how == "cutpoints" else first + F.floor(total * F.lit(valid))
    return F.when(nth <= first, "train").when(nth <= second, "valid").otherwise("test")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with nth, the place in the seeded order, and total.  Buckets are ranges of hashes, so they are evenly filled."""
    rows = df.withColumn("_order", hash_order(seed, F.col(key)))
    return numbered(rows, F.substring("_order", 1, 3), [F.col("_order"), F.col(key)]).drop("_order")


def sampled(df: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """k rows without replacement."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(k)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_class(df: DataFrame, k: int, by: str, *order: Column) -> DataFrame:
    """At most k rows of each class; Spark prunes a ranking under a limit on the map side, so large classes send k rows a task."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def diverse(df: DataFrame, target: int, by: str, *order: Column) -> DataFrame:
    """target rows: floor(target / classes) of each class by rank, then what is missing from the rest, largest classes first.

    A first pass counts classes (few rows); only rows of the first ``target`` ranks of a class can be chosen, which bounds what is ranked again.
    """
    sizes = df.groupBy(by).agg(F.count("*").alias("size"))
    classes = sizes.agg(F.count("*").alias("classes"))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= target)
    ranked = ranked.join(sizes, by).crossJoin(F.broadcast(classes)).withColumn("quota", F.floor(F.lit(target) / F.greatest("classes", F.lit(1))))
    chosen = F.col("rank") <= F.col("quota")
    # the chosen come first, then the rest; a limit over a total order needs no window over all rows
    return ranked.orderBy(F.when(chosen, 0).otherwise(1), F.desc("size"), F.col(by), "rank").limit(target).drop("size", "classes", "quota")


def arg_min(value: str, at: str) -> Column:
    """The place of the least value, the first of equal ones."""
    return F.min_by(at, F.struct(value, at))


def nearest_checkpoint(iteration: Column, every: int) -> Column:
    """Floor to a multiple; the first checkpoint stands for none."""
    low = (F.floor(iteration / every) * every).cast("bigint")
    return F.when(low == 0, F.lit(every)).otherwise(low)


def pick(values: tuple[str, ...], key: Column, seed: int) -> Column:
    """One of the values by the seeded hash of the key."""
    n = F.conv(F.substring(hash_order(seed, key), 1, 7), 16, 10).cast("bigint")
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
