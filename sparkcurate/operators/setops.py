"""Duplicates, leaks, unions: operators on whole datasets that keep the order of rows.

Order is a column, never the order of files or partitions.  "First" is the least by that column; ties are broken by the other order columns given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key.  Long keys are hashed before the shuffle and compared by a 128-bit digest; a null key is a key.

    An aggregation with a least struct combines on the map side, so a key with very many copies sends one row per task.
    """
    columns = df.columns
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("\x00null")))
    rows = df.select(digest.alias("_key"), F.struct(*order, *(c for c in columns if c not in order)).alias("_row"), F.struct(*order).alias("_order"))
    return rows.groupBy("_key").agg(F.min_by("_row", "_order").alias("_row")).select(*(F.col(f"_row.{c}").alias(c) for c in columns))


def duplicate_counts(df: DataFrame, key: Column) -> DataFrame:
    """One row (rows, distinct, duplicates)."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("\x00null")))
    return df.groupBy(digest.alias("k")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def without_leaks(df: DataFrame, other: DataFrame, key: Column, other_key: Column) -> DataFrame:
    """The rows of df whose key is not in other; copies within df stay.  Keys are digests, so the anti join moves 32 characters a row."""
    seen = other.select(F.md5(other_key).alias("_key")).distinct()
    return df.withColumn("_key", F.md5(key)).join(seen, "_key", "left_anti").drop("_key")


def leaks(df: DataFrame, other: DataFrame, key: Column, other_key: Column) -> DataFrame:
    """The rows of df whose key is in other."""
    seen = other.select(F.md5(other_key).alias("_key")).distinct()
    return df.withColumn("_key", F.md5(key)).join(seen, "_key", "left_semi").drop("_key")


def union_of(parts: list[DataFrame]) -> DataFrame:
    """All rows with source_ord, the place of their part; columns are matched by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("source_ord", F.lit(k)) for k, p in enumerate(parts)])


def first_match(left: DataFrame, right: DataFrame, on: str, order: list[str]) -> DataFrame:
    """left with the columns of the first row of right for its key, null where there is none."""
    first = right.groupBy(on).agg(*(F.min_by(c, F.struct(*order)).alias(c) for c in right.columns if c != on))
    return left.join(first, on, "left")


def nth(order: list[Column], partition: list[str] | None = None) -> Column:
    return F.row_number().over((Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))).orderBy(*order))


def numbered(df: DataFrame, bucket: Column, order: list[Column]) -> DataFrame:
    """df with nth (from 1 in the order, which must be total) and total.

    bucket must not decrease along the order.  Rows are numbered within their bucket and the counts of earlier buckets are added, so no
    task sees all rows; the counts are one row per bucket.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(F.lit(0))
    before = sizes.select("_bucket", (F.sum("_n").over(own.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(own).alias("total"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return rows.join(before, "_bucket").withColumn("nth", F.col("_before") + rank).drop("_bucket", "_before")
