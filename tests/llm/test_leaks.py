"""Leaks of held-out passages against brute force."""

import random

import pytest
from helpers import WORDS, text, vocabulary

from sparkcurate.llm import template_leaks as L

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, suite string, split string, item_text string"


def tables(spark, docs, items):
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, "s", "test", t) for i, t in items], ITEMS)


def brute(docs, items, n=12):
    index = {}
    for i, t in items:
        w = WORDS.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            index.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = WORDS.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in index.get(tuple(w[k : k + n]), ())}
    return out


@pytest.fixture(scope="module")
def data():
    rng, words = random.Random(2), vocabulary(80)
    items = [(i, text(rng, words, rng.randint(8, 40)).capitalize() + f" takes {i} ms in `do_{i}`.") for i in range(30)] + [(90, None), (91, ""), (92, items_twice := "One two three four five six seven eight nine ten eleven twelve"), (93, items_twice)]
    docs = [(100 + k, text(rng, words, 50)) for k in range(30)]
    for k in range(25):
        t = rng.choice(items)[1] or ""
        w = t.split()
        a = rng.randint(0, max(0, len(w) - 8))
        docs.append((200 + k, text(rng, words, 20) + "\n" + " ".join(w[a : a + rng.randint(9, 25)]).upper() + " - " + text(rng, words, 5)))
    return docs + [(300, None), (301, " "), (302, "x, " + items_twice + "!"), (302, "x, " + items_twice + "!")], items


@pytest.mark.parametrize("broadcast", [10**9, 0])
def test_pairs_are_those_of_brute_force(spark, data, broadcast):
    docs, items = data
    got = [(r.doc_id, r.item_id) for r in L.leaks(*tables(spark, docs, items), broadcast_chars=broadcast).filter("same > 0").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and len(got) > 8


@pytest.mark.parametrize("broadcast", [10**9, 0])
def test_reparameterised(spark, broadcast):
    line = "work out how many rows the {0} worker keeps when it reads {1} files and {0} closes after {2} seconds of rest"
    items = [(1, line.format("Alpha", 17, 4)), (2, line.format("Gamma", 9, 8)), (3, "work out how many rows the worker keeps when it reads files and closes after seconds of rest")]
    docs = [(1, line.format("Bravo", 99, 5)), (2, line.format("Bravo", 99, 5).replace("Bravo closes", "Other closes")), (3, line.format("Alpha", 17, 4))]
    d, i = tables(spark, docs, items)
    rows = L.leaks(d, i, broadcast).collect()
    assert {(1, 1), (1, 2), (3, 2)} <= {(r.doc_id, r.item_id) for r in rows if r.changed}
    # where two slots that were equal differ, windows that hold both tell
    assert max(r.changed for r in rows if (r.doc_id, r.item_id) == (2, 1)) < max(r.changed for r in rows if (r.doc_id, r.item_id) == (1, 1))
    exact = {(r.doc_id, r.item_id) for r in rows if r.same}
    assert (3, 1) in exact and (1, 1) not in exact
    assert {r.item_id: (r.documents, r.reparameterised) for r in L.leaked_items(d, i).collect()}[2] == (0, 3)


@pytest.mark.parametrize("broadcast", [10**9, 0])
def test_windows_of_names_alone_meet_nothing(spark, broadcast):
    rng, words = random.Random(4), vocabulary(2000)
    d, i = tables(spark, [(k, text(rng, words, 60)) for k in range(20)], [(k, text(rng, words, 60)) for k in range(20)])
    assert L.leaks(d, i, broadcast).count() == 0


def test_both_joins_count_alike(spark, data):
    docs, items = data
    one, two = (sorted(map(str, L.leaks(*tables(spark, docs, items), b).collect())) for b in (10**9, 0))
    assert one == two


def test_empty_and_report(spark):
    d, i = tables(spark, [], [(1, "a b c")])
    assert L.leaks(d, i).count() == 0
    assert [(r.item_id, r.documents) for r in L.leaked_items(d, i).collect()] == [(1, 0)]
    d, i = tables(spark, [(1, "a " * 50)], [])
    assert L.leaks(d, i).count() == 0
