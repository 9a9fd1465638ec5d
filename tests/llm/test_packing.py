"""Packing: capacities, completeness, token counts."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkcurate.llm import packing

SCHEMA = "doc_id bigint, text string"


@given(st.lists(st.integers(1, 60), max_size=200), st.integers(60, 90))
@settings(max_examples=40, deadline=None)
def test_plan_places_every_piece_once(lengths, capacity):
    histogram = np.bincount(lengths, minlength=capacity + 1)
    rows, containers = packing.plan(histogram, capacity)
    seen, load = defaultdict(list), Counter()
    for length, first, n, base, times in rows:
        seen[length] += range(first, first + n)
        for k in range(n):
            load[base + k // times] += length
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in enumerate(histogram) if n}
    assert all(0 < v <= capacity for v in load.values()) and len(load) == containers


def test_counts_are_those_of_the_tokenizer():
    counter = packing.piece_tokens(packing.VOCABULARY)
    for t in ["", " ", "it's  a\n\n test\t\tx ", "a_b(c)[1] == 12.5\r\n", "été 東京 ​", "don't 'quote'\n   indent", "\x1c a\x1f"]:
        assert counter.count(t) == len(counter.encoding.encode_ordinary(t)), t


def test_containers(spark):
    texts = [(i, "word " * (i % 37 + 1)) for i in range(300)] + [(900, "long text " * 3000), (901, None), (902, ""), (903, " ")]
    rows = packing.packed(spark.createDataFrame(texts, SCHEMA), 256).collect()
    load = Counter()
    for r in rows:
        load[r.container] += r.tokens
    counter = packing.piece_tokens(packing.VOCABULARY)
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.tokens
    assert max(load.values()) <= 256
    assert total == Counter({i: n for i, t in texts if (n := counter.count(t or ""))})
    assert {r.doc_id for r in rows if r.parts > 1} == {900} and len({(r.doc_id, r.part) for r in rows}) == len(rows)
    assert len(load) <= -(-sum(total.values()) // 256) + 1
    assert [r.doc_id for r in packing.oversized(spark.createDataFrame(texts, SCHEMA), 256).collect()] == [900]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")]])
def test_nothing_to_pack(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert packing.packed(df).count() == 0
    assert packing.packing_report(df).head().containers == 0


def test_equal_texts_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "same text", 5), (1, "same text", 6), (2, "same text", 7)], "doc_id bigint, text string, container bigint")
    rows = packing.packed(df, 8).collect()
    assert len(rows) == 3 and max(Counter(r.container for r in rows).values()) <= 4
