"""Samples by category: quotas, shortfalls, uniform and repeatable draws."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkcurate.llm import proportional_sample as P

TARGETS = "plan_id int, pool string, sample_pct int, category string, target_pct int, min_rows int"


def pool(spark, rows):
    return P.records("p", spark.createDataFrame(rows, "id bigint, category string"), "id", F.col("category"))


def test_quotas_and_draws(spark):
    rows = [(i, ["Tool Choice", "tool-choice ", "TOOL_CHOICE", "plan", "plan", "plan", None, " ", "rare", "plan"][i % 10]) for i in range(1000)]
    rows += rows[:50]
    targets = spark.createDataFrame([(1, "p", 20, "tool_choice", 50, 0), (1, "p", 20, "plan", 40, 0), (1, "p", 20, "rare", 0, 150), (2, "p", 50, "none such", 10, 0), (3, "other", 10, "plan", 10, 2)], TARGETS)
    report = {(r.plan_id, r.category): (r.needed, r.available, r.taken, r.short) for r in P.sample_report(pool(spark, rows), targets).collect()}
    # 200 records are asked for; the 100 of the rare category, its minimum, are taken from the others alike
    assert report == {(1, "tool_choice"): (100, 300, 56, 0), (1, "plan"): (80, 400, 44, 0), (1, "rare"): (150, 100, 100, 50), (2, "none such"): (50, 0, 0, 50), (3, "plan"): (2, 0, 0, 2)}
    assert {tuple(r) for r in P.shortfalls(pool(spark, rows), targets).collect()} == {(1, "rare"), (2, "none such"), (3, "plan")}
    drawn = P.drawn(pool(spark, rows), targets).collect()
    assert Counter((r.plan_id, r.category) for r in drawn) == {(1, "tool_choice"): 56, (1, "plan"): 44, (1, "rare"): 100}
    assert len({(r.plan_id, r.key) for r in drawn}) == len(drawn)
    assert {tuple(r) for r in P.drawn(pool(spark, rows), targets).collect()} == {tuple(r) for r in drawn}
    ids = sorted(int(r.key) for r in drawn if r.category == "plan")
    assert 300 < sum(ids) / len(ids) < 700


def test_sketches_of_parts_add_up(spark):
    rows = [(i, "ab"[i % 2]) for i in range(400)]
    sketch = lambda r: P.sketches(P.reservoirs(pool(spark, r)))
    whole = {tuple(r) for r in sketch(rows).collect()}
    parts = sketch(rows[:150]).unionByName(sketch(rows[150:])).groupBy("pool", "category", "bucket").agg(F.sum("n").alias("n"))
    assert {tuple(r) for r in parts.collect()} == whole


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 40), st.integers(0, 300)), min_size=1, max_size=8), st.integers(0, 500))
@settings(max_examples=300, deadline=None)
def test_quotas_are_feasible_and_follow_the_shares(rows, size):
    share, least, high = (np.array(x, float) for x in zip(*rows))
    low = np.minimum(least, high)
    names = [f"c{k}" for k in range(len(rows))]
    q = P.feasible(share, low, high, size, names)
    top = np.where(share > 0, high, low)
    assert (q >= low).all() and (q <= top).all() and q.sum() == np.clip(size, low.sum(), top.sum())
    free = (share > 0) & (q > low + 1) & (q < top - 1)
    if free.any():
        multiple = q[free] / share[free]
        assert (np.abs(q[free] - multiple.mean() * share[free]) <= 1 + share[free] / share[free].min() * 1.0).all()
        # none that could have more has less than its multiple, none above its minimum has more
        x = (q[free].sum()) / share[free].sum()
        assert (q[(share > 0) & (q < top)] >= np.floor(x * share[(share > 0) & (q < top)]) - 1 - share[(share > 0) & (q < top)] / share[free].sum() * free.sum()).all()


def test_an_exhausted_category_is_made_up_by_the_others():
    q = P.feasible(np.array([50.0, 30.0, 20.0]), np.array([0.0, 0.0, 0.0]), np.array([20.0, 500.0, 500.0]), 100, ["a", "b", "c"])
    assert q.tolist() == [20, 48, 32]


def test_empty(spark):
    none = spark.createDataFrame([], TARGETS)
    assert P.drawn(pool(spark, [(1, "a"), (None, "a")]), none).count() == 0
    some = spark.createDataFrame([(1, "p", 10, "a", 100, 1)], TARGETS)
    assert [tuple(r) for r in P.shortfalls(pool(spark, []), some).collect()] == [(1, "a")]
