"""Scores of evaluation answers and their reports.

Scores are doubles in 0..1.  Lists of expectations that are null count as empty; an answer that is null counts as ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.functions.textfn import text0


def empty_list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def tool_score(expected: Column, called: Column) -> Column:
    """Share of the expected tools that were called, as sets; without expectations 1, or .5 if a tool was called anyway."""
    e, c = F.array_distinct(empty_list(expected)), empty_list(called)
    return F.when(F.size(e) == 0, F.when(F.size(c) > 0, 0.5).otherwise(1.0)).otherwise(F.size(F.array_intersect(e, c)) / F.size(e)).cast("double")


def keyword_score(expected: Column, response: Column) -> Column:
    """Share of the keywords found in any case; a keyword named twice counts twice; 1 without keywords."""
    e = empty_list(expected)
    found = F.size(F.filter(e, lambda k: F.lower(text0(response)).contains(F.lower(k))))
    return F.when(F.size(e) == 0, 1.0).otherwise(found / F.size(e)).cast("double")


def prompt_score(tools: Column, keywords: Column, called: Column, response: Column) -> Column:
    """The mean of both scores where both are expected, the one that is, 1 for neither."""
    t, k = F.size(empty_list(tools)) > 0, F.size(empty_list(keywords)) > 0
    a, b = tool_score(tools, called), keyword_score(keywords, response)
    return F.when(t & k, (a + b) / 2).when(t, a).when(k, b).otherwise(F.lit(1.0))


def autonomy(expects_tool: Column, expected: Column, called: Column, accuracy: Column) -> Column:
    """struct<decision, correctness, accuracy, overall>: was a tool used when one should be, was it the right one, mean of the three."""
    used = F.size(empty_list(called)) > 0
    decision = (used == expects_tool).cast("double")
    correct = F.when(~expects_tool, decision).otherwise(tool_score(expected, called))
    return F.struct(decision.alias("decision"), correct.alias("correctness"), accuracy.alias("accuracy"), ((decision + correct + accuracy) / 3).alias("overall"))


def ladder(exact: Column, right_tool: Column, any_tool: Column) -> Column:
    return F.when(exact, 1.0).when(right_tool, 0.5).when(any_tool, 0.1).otherwise(0.0)


def multi_score(found: Column, expected: Column, bonus: Column) -> Column:
    """Share of the expected calls, .1 more with the bonus, 1 at most."""
    return F.least(found / F.greatest(expected, F.lit(1)) + F.when(bonus, 0.1).otherwise(0.0), F.lit(1.0))


def layers(tests: dict[str, Column]) -> Column:
    """struct<failed, soft, strict>: the first layer that fails.  The first layer is the gate: failing it fails both; a later one fails strict only."""
    failed = F.coalesce(*(F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()))
    gate = next(iter(tests))
    return F.struct(failed.alias("failed"), F.coalesce(failed != gate, F.lit(True)).alias("soft"), failed.isNull().alias("strict"))


def concept_score(concepts: Column, response: Column, any_tool: Column) -> Column:
    """struct<accuracy, autonomous, success>: the share of concepts named; autonomous with a tool and over .5; success with .75."""
    e = empty_list(concepts)
    accuracy = F.when(F.size(e) == 0, 0.0).otherwise(F.size(F.filter(e, lambda k: F.lower(text0(response)).contains(F.lower(k)))) / F.size(e)).cast("double")
    auto = any_tool & (accuracy > 0.5)
    return F.struct(accuracy.alias("accuracy"), auto.alias("autonomous"), (auto & (accuracy >= 0.75)).alias("success"))


def score_class(score: Column) -> Column:
    return F.when(score >= 0.7, "good").when(score >= 0.4, "fair").otherwise("poor")


def with_category(results: DataFrame, prompts: DataFrame, unmatched: bool = True) -> DataFrame:
    """Results with their prompt's category; unmatched ones as "unknown", or left out.  Of prompts given twice the last by category counts.
    Prompts join by key; the optimizer broadcasts them while they are small."""
    one = prompts.groupBy("prompt_id").agg(F.max("category").alias("category"))
    joined = results.join(one, "prompt_id", "left" if unmatched else "inner")
    return joined.withColumn("category", F.coalesce("category", F.lit("unknown"))) if unmatched else joined


def category_report(results: DataFrame) -> DataFrame:
    """(category, n, passed, avg_score) with 0 for no score."""
    return results.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("passed"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"))


def run_report(results: DataFrame) -> DataFrame:
    """(run_id, n, overall_score, success_rate) of each run."""
    return results.groupBy("run_id").agg(F.count("*").alias("n"), F.avg("score").alias("overall_score"), F.avg(F.col("success").cast("int")).alias("success_rate"))


def with_delta(runs: DataFrame, order: str, value: str) -> DataFrame:
    """delta against the run before; null for the first.  Runs are few: one row a run."""
    return runs.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(F.lit(0)).orderBy(order)))


def matrix(results: DataFrame, runs: list[str]) -> DataFrame:
    """One row a category, one column a run, mean scores, 0 for missing cells."""
    return results.groupBy("category").pivot("run_id", runs).agg(F.avg("score")).fillna(0.0, runs)


def rollup_passes(results: DataFrame) -> DataFrame:
    """(category, n, soft, strict) of each category and, as "all", of all: one rollup."""
    rows = results.rollup("category").agg(F.grouping("category").alias("g"), F.count("*").alias("n"), F.count_if("soft").alias("soft"), F.count_if("strict").alias("strict"))
    return rows.select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "n", "soft", "strict")


def index_percentile(values: Column, share: float) -> Column:
    """The value at place min(n - 1, int(share n)) of the sorted array; -1 for none."""
    n = F.size(values)
    return F.when(n == 0, F.lit(-1.0)).otherwise(F.get(values, F.least(n - 1, F.floor(n * F.lit(share)).cast("int"))))


def latency(samples: DataFrame, by: str, cells: int = 4096) -> DataFrame:
    """(by, n, p50, p95, low, high) by index of the sorted seconds, failed runs (-1) left out; exact for groups of any size.

    Values are counted by value first, so a group's task sees different values, not rows; the index is found on running counts.
    """
    counts = samples.filter("seconds >= 0").groupBy(by, "seconds").agg(F.count("*").alias("c"))
    own = Window.partitionBy(by)
    rows = counts.withColumn("upto", F.sum("c").over(own.orderBy("seconds"))).withColumn("n", F.sum("c").over(own))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("seconds")))
    return rows.groupBy(by).agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("p50"), at(F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.95)))).alias("p95"), F.min("seconds").alias("low"), F.max("seconds").alias("high"))


def steady_state(samples: DataFrame, by: str) -> DataFrame:
    """(by, warm_up, steady): the first query of each group, and the mean of the others."""
    return samples.groupBy(by).agg(F.max(F.when(F.col("run_idx") == 1, F.col("seconds"))).alias("warm_up"), F.avg(F.when(F.col("run_idx") > 1, F.col("seconds"))).alias("steady"))


def grid(lists: dict[str, tuple], spark) -> DataFrame:
    """All combinations of short lists of parameters, numbered in the order of nested loops."""
    out = spark.range(1).select()
    for name, values in lists.items():
        out = out.select("*", F.posexplode(F.array(*map(F.lit, values))).alias(f"_{name}", name))
    order = F.lit(0)
    for name, values in lists.items():
        order = order * len(values) + F.col(f"_{name}")
    return out.select(order.alias("ord"), *lists)


def comparison(rows: DataFrame, key: str, baseline: str, seconds: str) -> DataFrame:
    """rows with speedup and improvement_pct against the baseline's seconds, and rank by seconds."""
    base = rows.filter(F.col(key) == baseline).select(F.col(seconds).alias("_base"))
    out = rows.crossJoin(F.broadcast(base.limit(1)))
    return out.select("*", (F.col("_base") / F.col(seconds)).alias("speedup"), ((F.col("_base") - F.col(seconds)) * 100 / F.col("_base")).alias("improvement_pct"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(seconds, key)).alias("rank")).drop("_base")
