"""Cut texts: ends of single texts, and the prefix join against brute force."""

import random

import pytest

from sparkcurate.llm import cut_texts as C

SOUND = [
    None, "", "  \n", "A whole sentence.", "Ends with a question?\n", "# Title\n\nText here.\n\nThanks", "Text.\n\nSee also: src/a/b.py", "Text.\n\n- lib/x.py\n- lib/y.py", "Done so far.\n\n+1",
    "Text.\n\n| a | b |\n| --- | --- |\n| x | 1 |", "Code:\n\n```python\nx = 1\n```", '{"a": [1, 2]}', '{"a": 1}\n{"a": 2}', "a.py::test_x PASSED\n=== 1 passed in 0.1s ===", "def f(a):\n    return g(a)", "最后一句。", "Text.\n\n(older entries are archived)", "x.\n\n-- the team",
    "It works now.\n\nKind regards,\nAnna", "Steps.\n\n- item one\n- item two\n- item three", "It ran.\n\nTotal: 42", "It ran.\nDeploy finished at 10:42", "# Heading\nSome text without stop", "Text.\n\n## Next steps",
    "import os\n\n\ndef f(y):\n    y = g(y)\n    print(y)",
]
CUT = [
    "The sentence stops in the mid", "Stops after a comma,", "It was cut…", "It was cut [...]", "bytes�", '{"a": [1, 2', "a.py::test_x PASSED\na.py::tes", "def f(a):\n    return g(a", 'def f(a):\n    x = "open', "Text.\n\n```python\nx = 1",
    "Text.\n\n| a | b |\n| --- | --- |\n| x", "Call `name", "Steps.\n\n- run the first tool\n- run the second tool\n- run", "Steps.\n\n- Run it.\n- Stop it.\n- Look at the", "def f(a):\n    return g(a)\n\n\ndef h(b):\n    b.x()", "def f(a):\n    for x in a:",
]


@pytest.mark.parametrize("text", SOUND)
def test_sound(text):
    assert C.cut_reason(text) is None


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert C.cut_reason(text)


def test_prefixes_are_those_of_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 9))) for _ in range(300)] + [None, "", "abc", "abc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    fps = {r.text: r.fp for r in df.selectExpr("text", "xxhash64(text) as fp").collect()}
    real = {t for t in texts if t and t.strip(" ")}
    want = {fps[t] for t in real if any(o != t and o.startswith(t) for o in real)}
    assert {r.fp for r in C.prefixes(df).collect()} == want


def test_goes_on_inside_a_word_and_copies_count_once(spark):
    texts = ["one two thr", "one two three", "one two three four", "one two three four", "one two three four."] + ["head " * 30 + "a" * k for k in range(40)] + ["head " * 30] * 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    fps = {r.text: r.fp for r in df.selectExpr("text", "xxhash64(text) as fp").collect()}
    got = {r.fp: (r.longer, r.goes_on) for r in C.prefixes(df).collect()}
    assert got[fps["one two thr"]] == (fps["one two three"], True) and got[fps["one two three"]] == (fps["one two three four"], False)
    assert got[fps["one two three four"]] == (fps["one two three four."], False)
    assert len(got) == 3 + 39 and got[fps["head " * 30 + "a"]] == (fps["head " * 30 + "aa"], True)


def test_functions_of_the_corpus_tell_how_functions_end(spark):
    source = "def f(a):\n    return a\n\n\ndef g(a):\n    return f(a)\n"
    single = "def h(a):\n    a = f(a)"
    df = lambda *t: spark.createDataFrame([(i, x, "s") for i, x in enumerate(t)], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in C.cut_documents(df(source, source, single)).collect()} == {2}
    assert C.cut_documents(df(single)).count() == 0


def test_documents_and_report(spark):
    rows = [(1, "One. Two and thr", "s", "x"), (2, "One. Two and three.", "s", "x"), (3, "One. Two and thr", None, "x"), (4, None, "t", "x"), (5, "Fine.", "t", "x"), (5, "Fine.", "t", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, reason string")
    assert {r.doc_id for r in C.cut_documents(df).collect()} == {1, 3}
    report = {r.source: (r.documents, r.cut, r.cut_share) for r in C.cut_report(df).collect()}
    assert report == {"s": (2, 1, 0.5), None: (1, 1, 1.0), "t": (2, 0, 0.0)}


def test_empty(spark):
    assert C.cut_documents(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
