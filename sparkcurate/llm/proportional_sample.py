"""Samples that follow target shares of categories (problem 4).

Every record gets a priority, a hash of its key; the reservoir of a category is its records in order of priority, so reservoirs of
parts merge into that of the whole.  A reservoir as long as a share of the pool cannot be held in one place: one pass over the pool writes
(pool, category, priority, key) of every record, and counts by category and BUCKETS equal ranges of priority, which add up over parts, stand for the
order.  When counts are final, quotas are set, and each reservoir is trimmed to its quota: whole ranges below the cut, and within the one
range that is cut the records of least priority.  That is a uniform sample of the category without replacement, and no task sees more than one range of
one category.  The pool itself is not read again.

What a category needs is the larger of its minimum and its share of the sample.  Its quota is feasible: no more than it has, no less than its
minimum (or all it has), and the others follow their target shares as closely as the size of the sample allows: what an exhausted category lacks is spread
over the others in proportion to their targets, and what minimums add is taken from the others alike.  Parts of a record are rounded by largest
remainder, so a plan's sample has the size asked for wherever its categories have that many records.

Categories are compared in lower case, without outer blanks, with blanks, hyphens and underscores between words as one underscore.
Records without a category (null map, missing key, null or blank value) count in the pool and in no category.  Repeated rows of a key
count once.  Null keys are left out.  A target whose category has no record has 0 available.  Empty targets give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.functions.textfn import BLANKS
from sparkcurate.llm.shared import written

BUCKETS = 4096
SEED = "4:"


def category_key(c: Column) -> Column:
    """The category in its common spelling; null for null and blank."""
    plain = F.regexp_replace(F.lower(F.btrim(c, F.lit(BLANKS))), r"[\s_\-]+", "_")
    return F.when(F.length(plain) > 0, plain)


def records(pool: str, df: DataFrame, key: str, category: Column) -> DataFrame:
    """(pool, key, category) of one pool, one row per record."""
    rows = df.select(F.col(key).cast("string").alias("key"), category_key(category).alias("category")).filter("key is not null")
    return rows.groupBy("key").agg(F.max("category").alias("category")).select(F.lit(pool).alias("pool"), "key", "category")


def reservoirs(pools: DataFrame) -> DataFrame:
    """(pool, category, key, priority, bucket) of all records, written: the one pass over the pools."""
    return written(with_priority(pools), "reservoirs")


def with_priority(pools: DataFrame) -> DataFrame:
    priority = F.md5(F.concat(F.lit(SEED), "key"))
    return pools.withColumn("priority", priority).withColumn("bucket", F.conv(F.substring("priority", 1, 3), 16, 10).cast("int"))


def sketches(kept: DataFrame) -> DataFrame:
    """(pool, category, bucket, n): the order of every category's reservoir; those of parts of a pool add up."""
    return kept.groupBy("pool", "category", "bucket").agg(F.count("*").alias("n"))


def feasible(share: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, names: list[str]) -> np.ndarray:
    """Whole quotas within low and high that add up to size, as near to one multiple of the shares as can be; where the bounds leave no
    room for size, to the nearest sum they allow.  Equal remainders are rounded by name."""
    high = np.where(share > 0, high, low)
    size = int(np.clip(size, low.sum(), high.sum()))
    at = lambda x: np.clip(x * share, low, high)
    some = share > 0
    turns = np.concatenate([[0.0], low[some] / share[some], high[some] / share[some]])
    x = max(t for t in turns if at(t).sum() <= size + 1e-9)
    slope = share[some & (x * share < high - 1e-9) & (x * share >= low - 1e-9)].sum()
    exact = at(x + (size - at(x).sum()) / slope) if slope > 0 else at(x)
    out = np.floor(exact + 1e-6).astype(np.int64)
    order = sorted(range(len(out)), key=lambda k: (-round(float(exact[k] - out[k]), 6), names[k]))
    for k in [k for k in order if out[k] < high[k]][: size - int(out.sum())]:
        out[k] += 1
    return out


QUOTAS = "plan_id bigint, pool string, common string, needed bigint, available bigint, quota bigint"


def quotas(sketch: DataFrame, targets: DataFrame) -> DataFrame:
    """QUOTAS of every plan and category, in the category's common spelling; the rows of a plan, as many as it names categories, are set together."""
    size = sketch.groupBy("pool").agg(F.sum("n").alias("pool_size"))
    count = sketch.groupBy("pool", F.col("category").alias("common")).agg(F.sum("n").alias("available"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    t = targets.select(F.col("plan_id").cast("bigint").alias("plan_id"), "pool", category_key(F.col("category")).alias("common"), zero("sample_pct").alias("sample_pct"), zero("target_pct").alias("target_pct"), zero("min_rows").alias("min_rows"))
    t = t.groupBy("plan_id", "pool", "common").agg(*(F.max(c).alias(c) for c in ("sample_pct", "target_pct", "min_rows")))
    rows = t.join(size, "pool", "left").join(count, ["pool", "common"], "left").withColumns({"pool_size": zero("pool_size"), "available": zero("available")})

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        share, low, high = group.target_pct.to_numpy(float), np.minimum(group.min_rows, group.available).to_numpy(float), group.available.to_numpy(float)
        total = int(group.pool_size.max()) * int(group.sample_pct.max()) // 100
        needed = np.maximum(group.min_rows, group.pool_size * group.sample_pct * group.target_pct // 10000)
        return group[["plan_id", "pool", "common", "available"]].assign(needed=needed, quota=feasible(share, low, high, total, [x or "" for x in group.common]))[["plan_id", "pool", "common", "needed", "available", "quota"]]

    return rows.groupBy("plan_id", "pool").applyInPandas(plan, QUOTAS)


def trimmed(kept: DataFrame, sketch: DataFrame, quota: DataFrame) -> DataFrame:
    """(plan_id, pool, category, key): the reservoirs cut to their quotas."""
    q = quota.filter("quota > 0").select("plan_id", "pool", F.col("common").alias("category"), "quota")
    before = F.sum("n").over(Window.partitionBy("plan_id", "pool", "category").orderBy("bucket")) - F.col("n")
    cuts = sketch.join(q, ["pool", "category"]).withColumn("before", before).filter("before < quota")
    rows = kept.join(cuts.select("plan_id", "pool", "category", "bucket", (F.col("quota") - F.col("before")).alias("most")), ["pool", "category", "bucket"])
    nth = F.row_number().over(Window.partitionBy("plan_id", "pool", "category", "bucket").orderBy("priority", "key"))
    return rows.withColumn("nth", nth).filter("nth <= most").select("plan_id", "pool", "category", "key")


def drawn(pools: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, category, key): the samples of all plans, category in its common spelling."""
    kept = reservoirs(pools)
    sketch = written(sketches(kept), "sketches")
    return trimmed(kept, sketch, quotas(sketch, targets)).select("plan_id", "category", "key")


def sample_report(pools: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, category, needed, available, taken, short) of every target: taken is the number of records drawn, short what the category has
    too little of what it needs."""
    kept = reservoirs(pools)
    sketch = written(sketches(kept), "sketches")
    quota = written(quotas(sketch, targets), "quotas")
    count = trimmed(kept, sketch, quota).groupBy("plan_id", "pool", F.col("category").alias("common")).agg(F.count("*").alias("taken"))
    of = targets.select(F.col("plan_id").cast("bigint").alias("plan_id"), "pool", "category", category_key(F.col("category")).alias("common"))
    rows = of.withColumn("c", F.coalesce("common", F.lit(""))).join(quota.withColumn("c", F.coalesce("common", F.lit(""))).drop("common"), ["plan_id", "pool", "c"]).join(count, ["plan_id", "pool", "common"], "left")
    return rows.select("plan_id", "category", "needed", "available", F.coalesce("taken", F.lit(0)).alias("taken"), F.greatest(F.col("needed") - F.col("available"), F.lit(0)).alias("short"))


def shortfalls(pools: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan_id, category): the targets for which the category's whole reservoir is too short."""
    return sample_report(pools, targets).filter("short > 0 and taken <= available").select("plan_id", "category")
