"""Core operators on small literals."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkcurate.functions import codeintel, parsers, toolcalls
from sparkcurate.functions.textfn import canonical, chat_to_messages, messages_to_chat, strip
from sparkcurate.operators import checks, convert, filters, scoring, setops, split

M = "id bigint, messages array<struct<role:string,content:string>>"


def conv(spark, *rows):
    return spark.createDataFrame([(k, r) for k, r in enumerate(rows)], M)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_kept_and_removed_hold_every_row(spark):
    df = conv(spark, None, [], [("user", None)], [("user", "print foo now"), ("assistant", "long enough text")], [("user", "a good question"), ("assistant", "a good answer.")], [("user", "你好 你好 你好 你好"), ("assistant", "a good answer.")])
    m = F.col("messages")
    rows = filters.apply_filters(df, {"language": filters.is_language(m), "python": filters.is_modern_python(m), "quality": filters.is_quality(m)})
    assert [r.failed_rule for r in rows.orderBy("id").collect()] == ["quality", "quality", "quality", "python", None, "language"]
    assert rows.filter("keep").count() + rows.filter("not keep").count() == 6


LEGACY = ["print x", "d.has_key(k)", "for i in xrange(3):", "if a <> b:", "class Old:", "execfile(path)", "unicode(s)", "from __future__ import annotations"]
MODERN = ["print(x)", "d.has_key", "my_xrange_2 = 1", "a<>b", "class New(object):", "exec(path)", "unicode_text = 1", "import __future__"]


@pytest.mark.parametrize(("line", "keep"), [*((x, False) for x in LEGACY), *((x, True) for x in MODERN)])
def test_legacy_python(spark, line, keep):
    assert conv(spark, [("user", f"look:\n{line}\nend")]).filter(filters.is_modern_python(F.col("messages"))).count() == keep


def test_tool_class_needs_a_call(spark):
    texts = ["hover", "<tool_call>hover and read_file", "<tool_call>scan", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id bigint, t string")
    assert [r.c for r in rows.orderBy("id").select(checks.tool_class(F.col("t")).alias("c")).collect()] == ["direct_answer", "hover", "other", "direct_answer", "direct_answer"]


def test_categories_and_priority(spark):
    rows = spark.createDataFrame([(0, "import Flask, pandas"), (1, "from typing import Protocol"), (2, "wheel"), (3, None)], "id bigint, t string").orderBy("id")
    assert [r.c for r in rows.select(filters.diversity_category(F.col("t")).alias("c")).collect()] == ["web", None, "tools", None]
    code = "<tool_call>\nresult = f()\nif result.success:\n    for e in result.errors: pass"
    assert one(spark, filters.example_priority(F.lit(code))) == 25 and one(spark, filters.example_priority(F.lit(None).cast("string"))) == 0


@pytest.mark.parametrize(("text", "n"), [("exactly 10", 1), (" nine char ", 0)])
def test_quality_counts_stripped_characters(spark, text, n):
    assert conv(spark, [("user", text), ("assistant", "a long answer")]).filter(filters.is_quality(F.col("messages"))).count() == n


def test_strip_takes_unicode_blanks(spark):
    assert one(spark, strip(F.lit("\u00a0\n x y \u2003\t"))) == "x y"


def test_chat_round_trip_and_dirt(spark):
    text = "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>note<|im_start|>user \n two\nlines <|im_end|><|im_start|>assistant\nno end"
    m = one(spark, chat_to_messages(F.lit(text)))
    assert [(x.role, x.content) for x in m] == [("system", "Be brief."), ("user", "two\nlines"), ("assistant", "no end")]
    df = conv(spark, [("user", "a"), ("assistant", "b\nc")])
    assert df.select(canonical(chat_to_messages(messages_to_chat(F.col("messages")))).alias("a"), canonical(F.col("messages")).alias("b")).filter("a = b").count() == 1
    assert one(spark, chat_to_messages(F.lit(None).cast("string"))) == []


def test_either_form_needs_one(spark):
    with pytest.raises(Exception, match="neither"):
        spark.createDataFrame([(None, None)], "text string, messages array<struct<role:string,content:string>>").select(convert.either_form(F.col("text"), F.col("messages"))).collect()


def test_conversions(spark):
    fence = 'Look:\n```json\n{"name": "f", "arguments": {"a": 1, "b": "x"}}\n``` tail'
    assert one(spark, convert.fence_to_tags(F.lit(fence))) == "Look:\n<tool_call><function=f>\n<parameter=a>\n1\n</parameter>\n<parameter=b>\nx\n</parameter>\n</function></tool_call>"
    assert one(spark, convert.fence_to_tags(F.lit("plain"))) == "plain"
    tags = "<tool_call><function=f>\n<parameter=a>\n1\n</parameter>\n</function></tool_call>"
    assert json.loads(one(spark, convert.tags_to_json(F.lit(tags))).split("\n")[1]) == {"name": "f", "arguments": {"a": "1"}}
    assert one(spark, convert.single_quotes(F.lit("""a="x" b="it's" """))) == """a='x' b="it's" """
    assert one(spark, convert.fill_authors(F.lit("C(author=None) C(author=None) C(author=ann)"), ("x", "y"), F.lit(1))) == "C(author='y') C(author='x') C(author=ann)"
    assert [(m.role, m.content) for m in one(spark, convert.transcript_to_messages(F.lit("SYSTEM: s\n\nUSER: u\n\nodd\n\nFUNCTION RESPONSE: {}")))] == [("system", "s"), ("user", "u"), ("tool", "{}")]
    assert one(spark, convert.expand_template(F.lit("{a}-{b}"), {"a": ("1", "2"), "b": ("x", "y")})) == ["1-x", "2-x"]
    assert one(spark, convert.preview(F.lit("abcdef"), 3)) == "abc..."


@given(st.text(min_size=1, max_size=20))
@settings(max_examples=10, deadline=None)
def test_md5_mod5_equals_the_number(spark, text):
    import hashlib

    text = text.encode("utf-8", "ignore").decode()
    assert one(spark, convert.md5_mod5(F.lit(text))) == int(hashlib.md5(text.encode()).hexdigest(), 16) % 5


def test_sequence_needs_enough_messages(spark):
    df = conv(spark, None, [("assistant", "<tool_call>")], [("user", "q"), ("assistant", "<tool_call>x"), ("user", "r"), ("assistant", "a")])
    assert [r.x for r in df.orderBy("id").select(filters.has_tool_pattern(F.col("messages")).alias("x")).collect()] == [False, False, True]


def test_keep_first_is_by_order_and_idempotent(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, None), (5, None)], "n bigint, k string")
    first = setops.keep_first(df, F.col("k"), ["n"])
    assert sorted(r.n for r in first.collect()) == [1, 2, 4]
    assert setops.keep_first(first, F.col("k"), ["n"]).count() == 3
    assert tuple(setops.duplicate_counts(df, F.col("k")).head()) == (5, 3, 2)
    assert tuple(setops.duplicate_counts(df.limit(0), F.col("k")).head()) == (0, 0, 0)


def test_leaks_keep_copies(spark):
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("y",)], "k string")
    assert [r.k for r in setops.without_leaks(a, b, F.col("k"), F.col("k")).collect()] == ["x", "x"]
    assert setops.leaks(a, b, F.col("k"), F.col("k")).count() == 1


@pytest.mark.parametrize(("n", "how", "sizes"), [(57, "cutpoints", (45, 6, 6)), (57, "sizes", (45, 5, 7)), (0, "sizes", (0, 0, 0)), (3, "cutpoints", (2, 0, 1))])
def test_split_arithmetic(spark, n, how, sizes):
    rows = split.shuffled(spark.range(n), "id", 1).select(split.part(F.col("nth"), F.col("total"), how).alias("p")).collect()
    assert tuple(sum(r.p == p for r in rows) for p in ("train", "valid", "test")) == sizes


def test_shuffle_is_a_permutation(spark):
    rows = split.shuffled(spark.range(100), "id", 7).collect()
    assert sorted(r.nth for r in rows) == list(range(1, 101)) and sorted(r.id for r in rows) == list(range(100))
    assert [r.id for r in sorted(rows, key=lambda r: r.nth)] != list(range(100))


def test_scores(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, scoring.tool_score(a(), a("f"))) == 0.5
    assert one(spark, scoring.tool_score(a("f", "f", "g"), a("g"))) == 0.5
    assert one(spark, scoring.keyword_score(a("X", "x", "y"), F.lit("an x"))) == pytest.approx(2 / 3)
    assert one(spark, scoring.prompt_score(a(), a(), a("f"), F.lit(""))) == 1.0
    x = one(spark, scoring.layers({"gate": F.lit(True), "next": F.lit(None).cast("boolean")}))
    assert (x.failed, x.soft, x.strict) == ("next", True, False)
    assert one(spark, scoring.index_percentile(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), 0.5)) == 3.0
    assert one(spark, scoring.index_percentile(F.array().cast("array<double>"), 0.5)) == -1.0


def test_latency_is_by_index(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)] + [("a", -1.0), ("b", 5.0), ("b", 5.0)], "k string, seconds double")
    assert {r.k: (r.n, r.p50, r.p95, r.low, r.high) for r in scoring.latency(df, "k").collect()} == {"a": (4, 3.0, 4.0, 1.0, 4.0), "b": (2, 5.0, 5.0, 5.0, 5.0)}


def test_checks_of_nothing_and_something(spark):
    empty = {r.check_name: r.passed for r in checks.dataset_checks(conv(spark).limit(0)).collect()}
    assert not empty["distribution"] and empty["content"]
    df = conv(spark, [("system", "s"), ("user", ""), ("robot", "x")], [("user", "q"), ("assistant", "a")])
    errors = df.select("id", checks.validation_errors(F.col("messages")).alias("e")).orderBy("id").collect()
    assert errors[0].e == ["last_role", "role:2", "empty:1"] and errors[1].e == []
    assert "FAIL last_role" in checks.summary(checks.dataset_checks(df)).head().text


@pytest.mark.parametrize(
    ("text", "names", "clean"),
    [
        ('a <tool_call>{"name": "f", "arguments": {"b": 1, "a": [2]}}</tool_call> b', ["f"], "a  b"),
        ("<tool_call><function=g><parameter=x>1</parameter></function></tool_call>", ["g"], ""),
        ("pre <function=h><parameter=x>1</parameter></function></tool_call>", ["h"], "pre"),
        ("<function=h></function>", [], "<function=h></function>"),
        ('```json\n{"name": "k"}\n``` <tool_call>{"name": "f"}</tool_call>', ["f", "k"], ""),
        ("<tool_call>nothing</tool_call>x", [], "x"),
        ('```json\n[1, "name"]\n```', [], '```json\n[1, "name"]\n```'),
        (None, [], ""),
    ],
)
def test_tool_calls(text, names, clean):
    rest, calls = toolcalls.parse(text)
    assert [c["name"] for c in calls] == names and rest == clean


def test_tool_call_arguments(spark):
    row = one(spark, toolcalls.tool_calls(F.lit('<tool_call>{"name": "f", "arguments": {"b": 1, "a": {"c": null}}}</tool_call>')))
    assert row.calls[0].arguments == '{"a":{"c":null},"b":1}'


def test_parsers(spark):
    x = one(spark, parsers.type_check(F.lit('[{"file":"a","line":1,"message":"m"},{"file":"b","line":2,"severity":"warning","message":"w"}]')))
    assert (x.success, x.errors, x.warnings, x["items"][0].col, x["items"][0].code) == (False, 1, 1, 0, "unknown")
    assert one(spark, parsers.type_check(F.lit("oops"))).parse_error and one(spark, parsers.type_check(F.lit(""))).success
    x = one(spark, parsers.lint(F.lit("a.py:1:2: E501 [*] too long\nb.py:3:4: F401 unused\nFound 2 errors.")))
    assert (x.fixable, [i.code for i in x["items"]], x.parse_error) == (1, ["E501", "F401"], None)
    x = one(spark, parsers.test_run(F.lit("a::b PASSED\na::c FAILED\n=== 1 failed, 1 passed in 0.25s ===")))
    assert (x.passed, x.failed, x.seconds, x.success) == (1, 1, 0.25, False)
    assert one(spark, parsers.definitions(F.lit("null"))).success is False
    assert one(spark, parsers.definitions(F.lit('{"uri":"file:///a","range":{"start":{"line":4,"character":1}}}'))).places[0].line == 5
    assert one(spark, parsers.references(F.lit('{"uri":"x"}'))).parse_error
    assert one(spark, parsers.hover(F.lit('{"contents":["a",{"value":"b"}]}'))).content == "a\n\nb"
    files = one(spark, parsers.vcs_status(F.lit(" M f.py\nR  a.py -> b.py\n?? c.py")))
    assert [(f.file, f.state, f.staged) for f in files] == [("f.py", "modified", False), ("b.py", "renamed", True), ("c.py", "untracked", False)]
    assert one(spark, parsers.vcs_status(F.lit(" M f.py"), compat=True))[0].file == ".py"
    d = one(spark, parsers.vcs_diff(F.lit("+lost\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n-x\n+y\n+z\n--- a/g\n+++ b/g\n@@ @@\n-q")))
    assert [(f.file, f.hunks, f.added, f.deleted) for f in d] == [("f", 1, 2, 1), ("g", 1, 0, 1)]
    assert one(spark, parsers.vcs_log(F.lit("h|a|d|m | n\nshort|x")))[0].message == "m | n"
    t = one(spark, parsers.train_log(F.lit("Iter 1: Train loss 2.5, Val loss 2.0: x\nIter 2: Val loss 1.0\nIter 3: Train loss x")))
    assert [(r.iteration, r.train_loss, r.val_loss) for r in t] == [(1, 2.5, 2.0)]
    assert [r.val_loss for r in one(spark, parsers.val_losses(F.lit("Iter 2: Val loss 1.5, took\nIter 3: Train loss 1")))] == [1.5]
    assert one(spark, parsers.line_range(F.lit("a\nb\nc"), F.lit(2), F.lit(1))) == "b\n"
    assert [one(spark, parsers.frame_kind(F.lit(x))) for x in ('{"id":1,"method":"m"}', '{"method":"m"}', '{"id":1}', "{")] == ["request", "notification", "response", "malformed"]


SOURCE = '''"""Doc."""
import os
from a import Inject, injectable

@dataclass
class Card:
    name: str
    def __call__(self) -> Node:
        return html(f"<b>{self.name}</b>")

@injectable
@dataclass
class Service:
    card: Inject[Card]
    other: Inject[Gone]

def use(x: int):
    r = fetch(x)
    r.items.append(os)
    return r.status

app.add_route("home/{id", use)
'''


def test_code_facts_and_rewrites():
    f = codeintel.facts(SOURCE)
    assert f["classes"] == ["Card", "Service"] and "use" in f["functions"] and f["hints"] and f["imports"] == ["a", "os"]
    assert codeintel.facts("def (") is None
    assert codeintel.accesses(SOURCE) == ["r.items", "r.items.append", "r.status"]
    assert [m["line"] for m in codeintel.found(SOURCE, "decorator:injectable")] == [11]
    assert [m["name"] for m in codeintel.found(SOURCE, "call:append")] == ["r.items.append"]
    code, n = codeintel.renamed("r = f(r=1)\nx.r = r  # r\n", "r", "s")
    assert (code, n) == ("s = f(r=1)\nx.r = s  # r\n", 2)
    assert codeintel.renamed("x = 1", "x", "not a name") == ("x = 1", 0)
    added = codeintel.with_import(SOURCE, "import json")
    assert added.split("\n")[3] == "import json" and codeintel.with_import(added, "import json") == added
    assert [codeintel.occurrence("f", c) for c in ("g()", "# f", "'f'", "f(1)", "f = 1", "to call f, let me", "x = 1  # f")] == ["none", "comment", "string", "real_call", "code_context", "prose", "code_context"]


def test_domain_issues():
    rules = {(i["rule"], i["severity"]) for i in codeintel.issues(SOURCE)}
    assert {("no-fstring-in-html", "error"), ("component-no-fstring-in-html", "error"), ("service-cannot-depend-on-component", "error"), ("inject-type-must-be-imported", "warning"), ("route-must-start-with-slash", "error"), ("route-unbalanced-braces", "error")} <= rules
    assert codeintel.issues("def (")[0]["rule"] == "parse-error"
    bad = "@middleware\nclass M:\n    def __call__(self, x):\n        pass\n\nclass C:\n    def __call__(self):\n        return html('x')\n"
    rules = {i["rule"] for i in codeintel.issues(bad)}
    assert {"middleware-must-have-categories", "middleware-must-have-correct-signature", "component-must-have-dataclass", "component-callable-must-return-node"} <= rules


def test_symbols():
    nested = json.dumps([{"name": "A", "kind": 5, "range": {"start": {"line": 0}, "end": {"line": 9}}, "children": [{"name": "b", "kind": 6, "range": {"start": {"line": 1}, "end": {"line": 2}}}]}])
    assert [(s["path"], s["depth"], s["line"]) for s in codeintel.flat_symbols(nested)] == [("A", 0, 1), ("A/b", 1, 2)]
    assert codeintel.flat_symbols("nope") == [] and codeintel.flat_symbols(None) == []
